import datetime as dt

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from girder.functions import exprs as x


def one(spark, expr, schema="a double, b double", row=(1.0, 2.0)):
    return spark.createDataFrame([row], schema).select(expr.alias("v")).first()["v"]


@pytest.mark.parametrize(
    "a,b,want", [(6.0, 3.0, 2.0), (1.0, 0.0, None), (None, 2.0, None), (1.0, None, None)]
)
def test_safe_div(spark, a, b, want):
    assert one(spark, x.safe_div("a", "b"), row=(a, b)) == want


@pytest.mark.parametrize("b,only_zero,want", [(0.0, False, 6.0), (-2.0, False, 6.0), (None, False, 6.0), (-2.0, True, -3.0), (0.0, True, 6.0)])
def test_div_or_one(spark, b, only_zero, want):
    assert one(spark, x.div_or_one("a", "b", only_zero), row=(6.0, b)) == want


@pytest.mark.parametrize("v,want", [(2.5, 3), (-2.5, -3), (2.4, 2), (-0.4, 0)])
def test_to_int_rounds_half_away_from_zero(spark, v, want):
    assert one(spark, x.to_int("a"), row=(v, 0.0)) == want


@pytest.mark.parametrize("v,want", [(0.1, 0.5), (0.5, 1.0), (-0.3, 0.0), (None, None)])
def test_clip_scale_keeps_null(spark, v, want):
    assert one(spark, x.clip_scale("a", 0.0, 0.2, 5), row=(v, 0.0)) == want


@pytest.mark.parametrize("v,want", [(float("inf"), 0.0), (float("-inf"), 0.0), (float("nan"), 0.0), (None, 0.0), (1.5, 1.5)])
def test_finite_or_zero(spark, v, want):
    assert one(spark, x.finite_or_zero("a"), row=(v, 0.0)) == want


def test_month_difference_ignores_the_day(spark):
    row = (dt.date(2024, 3, 1), dt.date(2024, 2, 29))
    assert one(spark, x.month_diff("a", "b"), "a date, b date", row) == 1
    assert one(spark, x.month_start("a"), "a string, b string", ("2024-05", "")) == dt.date(2024, 5, 1)
    assert one(spark, x.fiscal_year("b"), "a date, b date", row) == 2023


@pytest.mark.parametrize("rate,want", [(75.9, "正常"), (76.0, "注意"), (80.0, "警告"), (85.0, "緊急"), (None, "正常")])
def test_cost_risk_band_edges(spark, rate, want):
    assert one(spark, x.cost_risk_level("a", "b"), row=(rate, 80.0)) == want


@pytest.mark.parametrize("net,want", [(-50001.0, "資金不足リスク"), (-50000.0, "注意"), (-1.0, "注意"), (0.0, "正常"), (None, "正常")])
def test_cashflow_risk_edges(spark, net, want):
    assert one(spark, x.cashflow_risk("a"), row=(net, 0.0)) == want


def test_first_matching_rule_wins(spark):
    rules = [(("函南", "伊豆"), "函南"), ("三島", "三島")]
    df = spark.createDataFrame([("三島伊豆",), ("三島市",), (None,), ("東京",)], "n string")
    got = [r.v for r in df.select(x.label_by_rules("n", rules, "その他").alias("v")).collect()]
    assert got == ["函南", "三島", "その他", "その他"]


def test_category_budget_unknown_category_is_zero(spark):
    df = spark.createDataFrame([("外注費",), ("他",), (None,)], "c string")
    got = [r.v for r in df.select(x.category_budget(F.lit(1000), F.lit(80.0), "c").alias("v")).collect()]
    assert got == [360.0, 0.0, 0.0]


@settings(max_examples=15, deadline=None)
@given(st.lists(st.integers(-(10**9), 10**9), min_size=1, max_size=20))
def test_exact_avg_is_the_mean(spark, values):
    df = spark.createDataFrame([(v,) for v in values], "v long")
    assert df.agg(x.exact_avg("v").alias("m")).first()["m"] == sum(values) / len(values)


def test_hash_bucket_is_stable_and_in_range(spark):
    df = spark.range(2000).select(x.hash_bucket("id", 5).alias("b"))
    counts = {r.b: r["count"] for r in df.groupBy("b").count().collect()}
    assert set(counts) == {0, 1, 2, 3, 4}
    assert min(counts.values()) > 300
    assert df.repartition(7).filter("b = 0").count() == counts[0]
