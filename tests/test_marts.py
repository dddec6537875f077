"""Marts kept up to date by changes against the views over the base tables."""

import random

import pytest
from helpers import CASH, COST, cash, cost, project, projects

from girder.plans import marts, views


def random_cost(rng):
    return cost(
        rng.choice(["a", "b", "c", None]), rng.choice([0, 5, 70, 900]), rng.choice(["外注費", "材料費", "労務費", "経費", "他"]),
        rng.choice(["確定請求", "現場見込み", "口頭発注", "x"]), month=rng.choice(["2024-01", "2024-02"]), due=rng.choice(["2024-02", "2024-03", None]),
    )


def random_cash(rng):
    paid = rng.random() < 0.5
    return cash(rng.choice(["a", "b"]), rng.choice([10, 300]), rng.choice(["2024-01", "2024-02", "2024-05"]), rng.choice([None, 11]) if paid else None, "入金済" if paid else "予定")


def turn(rows, rng, make):
    """Some rows go, some appear; the rows after that and the changes."""
    gone = [r for r in rows if rng.random() < 0.4]
    new = [make(rng) for _ in range(rng.randint(0, 4))]
    kept = list(rows)
    for r in gone:
        kept.remove(r)
    return kept + new, new, gone


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.mark.parametrize("seed", [1, 2])
def test_any_changes_equal_the_recomputation(spark, tmp_path, seed):
    rng = random.Random(seed)
    p = projects(spark, project("a"), project("b", contract=0), project("c"), project("none"))
    flow = marts.CashMart(spark, str(tmp_path / "cash"), buckets=2)
    spent = marts.CostMart(spark, str(tmp_path / "cost"), buckets=2)
    receipts, costs = [], []
    for batch in range(5):
        receipts, new_cash, gone_cash = turn(receipts, rng, random_cash)
        costs, new_costs, gone_costs = turn(costs, rng, random_cost)
        if batch == 3:  # everything goes
            gone_cash, gone_costs, receipts, costs = gone_cash + receipts, gone_costs + costs, [], []
        cash_changes = marts.changes(spark.createDataFrame(new_cash, CASH), spark.createDataFrame(gone_cash, CASH))
        cost_changes = marts.changes(spark.createDataFrame(new_costs, COST), spark.createDataFrame(gone_costs, COST))
        for _ in range(2):  # the second time is a batch that runs again
            flow.apply(cash_changes, cost_changes, batch)
            spent.apply(cost_changes, batch)
        r, c = spark.createDataFrame(receipts, CASH), spark.createDataFrame(costs, COST)
        assert rows_of(flow.cashflow()) == rows_of(views.cashflow_forecast(r, c))
        assert rows_of(spent.summary(p)) == rows_of(views.project_cost_summary(p, c))


def test_pages_read_marts_only(spark, tmp_path):
    """The plan of a page over a mart scans the folders of one version and no base table."""
    flow = marts.CashMart(spark, str(tmp_path / "cash"))
    path = str(tmp_path / "base")
    spark.createDataFrame([cost("a", 5)], COST).write.parquet(path)
    flow.apply(marts.changes(spark.createDataFrame([cash("a", 9, "2024-01")], CASH)), marts.changes(spark.read.parquet(path)), 0)
    files = flow.cashflow().inputFiles()
    assert files and all("/cash/data/v" in f for f in files)


def test_no_changes_is_an_error():
    with pytest.raises(ValueError, match="appear"):
        marts.changes()
