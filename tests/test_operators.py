import datetime as dt
import json

import duckdb
import numpy as np
import pytest
from helpers import by, cash, project, projects, receipts
from pyspark.sql import functions as F

from girder import schemas
from girder.operators import controls, quality, schedule, summaries, timeline
from girder.plans import operations as ops
from girder.sources import sinks, tables


def test_histogram_is_closed_and_handles_a_single_value(spark):
    df = spark.createDataFrame([("a", float(v)) for v in range(11)] + [("b", 5.0)] * 3 + [("a", None)], "g string, v double")
    got = {(r.g, r.bin): r.row_count for r in summaries.histogram(df, "v", 5, ["g"]).collect()}
    assert got == {("a", 1): 2, ("a", 2): 2, ("a", 3): 2, ("a", 4): 2, ("a", 5): 3, ("b", 1): 3}


def test_concentration(spark):
    rows = [("one", "a", 10), ("two", "a", 5), ("two", "b", 5), ("zero", "a", 0)]
    got = by(summaries.concentration(spark.createDataFrame(rows, "m string, c string, x long"), ["m"], "c", "x"), "m")
    assert (got["one"].hhi, got["two"].hhi, got["zero"].hhi) == (1.0, 0.5, 0.0)


def test_shares_add_up(spark):
    df = spark.createDataFrame([("a", 1), ("b", 2), ("b", 4)], "k string, v long")
    got = by(summaries.share_of_total(df, ["k"], F.sum("v"), "v"), "k")
    assert sum(r.share_pct for r in got.values()) == pytest.approx(100)
    assert got["b"].v == 6


def test_correlation_uses_the_rows_both_know(spark):
    df = spark.createDataFrame([(1.0, 2.0, 9.0), (2.0, 4.0, None), (3.0, 6.0, 1.0)], "a double, b double, c double")
    got = {(r.measure_a, r.measure_b): r.correlation for r in summaries.correlation_pairs(df, ["a", "b", "c"]).collect()}
    assert len(got) == 9
    assert got["a", "b"] == pytest.approx(1) and got["a", "c"] == pytest.approx(-1) and got["c", "c"] == 1


def test_top_k_skips_null_and_breaks_ties_by_id(spark):
    df = spark.createDataFrame([(1, 5.0), (2, 7.0), (3, 7.0), (4, None)], "id int, v double")
    assert [r.id for r in summaries.top_k(df, "v", 2, ["id"]).collect()] == [2, 3]


def test_window_measures(spark):
    df = spark.createDataFrame([(i, v) for i, v in enumerate([10, 20, 60, 30, 5])], "t int, v long")
    w = timeline.by_time("t")
    rows = df.select(
        "t",
        timeline.trailing_mean("v", w).alias("mean"),
        timeline.rolling_mean("v", w).alias("roll"),
        timeline.running_total("v", w).alias("run"),
        timeline.opening_balance("v", w).alias("open"),
        timeline.change("v", w).alias("chg"),
    ).orderBy("t").collect()
    assert [r["mean"] for r in rows] == [None, 10.0, 15.0, 30.0, pytest.approx(110 / 3)]
    assert [r["roll"] for r in rows][:2] == [10.0, 15.0]
    assert [r["open"] for r in rows] == [0, 10, 30, 90, 120]
    assert [r["run"] for r in rows][-1] == 125
    assert [r["chg"] for r in rows] == [0, 10, 40, -30, -25]


def test_month_axis_fills_gaps(spark):
    df = spark.createDataFrame([(dt.date(2024, 1, 1), 5), (dt.date(2024, 4, 1), 7)], "month date, v long")
    rows = timeline.on_axis(df, timeline.month_axis(df), ["v"]).orderBy("month").collect()
    assert [r.v for r in rows] == [5, 0, 0, 7]
    ahead = timeline.future_months(df, 2).orderBy("step").collect()
    assert [r.month for r in ahead] == [dt.date(2024, 5, 1), dt.date(2024, 6, 1)]


def test_same_month_last_year_needs_the_month(spark):
    df = spark.createDataFrame([(dt.date(2023, 1, 1), 5), (dt.date(2024, 1, 1), 7), (dt.date(2024, 2, 1), 1)], "month date, v long")
    got = by(timeline.same_month_last_year(df, ["v"]), "month")
    assert got[dt.date(2024, 1, 1)].v_last_year == 5 and got[dt.date(2024, 2, 1)].v_last_year is None


def test_activity_matches_pairing_every_month_with_every_project(spark, sf):
    from girder.sources import standins as src

    p = src.projects(spark, sf, ("project_id", "start_date", "end_date"))
    months = spark.createDataFrame([(dt.date(1995 + i // 12, i % 12 + 1, 1),) for i in range(120)], "month date")
    fast = {r.month: r.active_project_count for r in timeline.active_projects(p, months).collect()}
    paired = months.join(p, (F.col("start_date") <= F.col("month")) & (F.col("end_date") >= F.col("month")), "left")
    slow = {r.month: r.n for r in paired.groupBy("month").agg(F.countDistinct("project_id").alias("n")).collect()}
    assert fast == slow


def test_milestones_follow_the_contract(spark):
    p = projects(spark, project("a", contract=1001, start=dt.date(2024, 1, 31), end=dt.date(2024, 4, 30)))
    rows = {r.milestone: r for r in schedule.expand_milestones(p).collect()}
    assert [rows[m].expected_amount_kpy for m in ("前払金", "中間金", "完成金")] == [400, 200, 400]
    assert rows["前払金"].expected_date == dt.date(2024, 2, 29)
    assert [rows[m].deposit_month for m in ("前払金", "中間金", "完成金")] == ["2024-02", "2024-02", "2024-05"]


def test_delay_moves_only_open_receipts_of_the_chosen(spark):
    r = receipts(spark, cash("a", 1, "2024-11"), cash("a", 2, "2024-11", 2, "入金済"), cash("b", 3, "2024-11"))
    got = {(x.project_id, x.expected_amount_kpy): x.deposit_month for x in schedule.delay_receipts(r, 3, project_id=["a"]).collect()}
    assert got == {("a", 1): "2025-02", ("a", 2): "2024-11", ("b", 3): "2024-11"}


def test_controls_and_roles(spark):
    p = projects(spark, project("a", pm="A"), project("b", pm="B", division="土木"))
    assert controls.apply_controls(p, division=["土木"], pm_name=None).count() == 1
    assert controls.apply_controls(p, between=("start_date", dt.date(2025, 1, 1), None)).count() == 0
    assert controls.secure_view(p, "現場監督", {"pm_name": ["A"]}).count() == 1
    assert controls.secure_view(p, "現場監督").count() == 0
    assert controls.secure_view(p, "部外者").count() == 0
    assert controls.secure_view(p, "経営陣").count() == 2


def test_quality_report_counts_in_one_pass(spark):
    df = spark.createDataFrame([(1, 50.0), (None, 101.0), (3, None)], "id int, v double")
    got = {(r.column_name, r.check): r for r in quality.quality_report(df, "t", ["id"], {"v": (0, 100)}, max_null_pct=50.0).collect()}
    assert (got["id", "null"].bad_count, got["id", "null"].is_alert) == (1, 0)
    assert (got["v", "range"].bad_count, got["v", "range"].is_alert) == (1, 1)


def test_csv_mark_and_fixed_schema(spark, tmp_path):
    rows = [("三島", "2024-01", 100.0, 1, 2, 3, 4)]
    sinks.write_csv(spark.createDataFrame(rows, schemas.AREAS), str(tmp_path / "a"), byte_order_mark=True)
    raw = next((tmp_path / "a").glob("*.csv")).read_bytes()
    assert raw.startswith(b"\xef\xbb\xbf")
    back = tables.read_csv(spark, str(tmp_path / "a"), schemas.AREAS)
    assert [tuple(r) for r in back.collect()] == rows


def test_dated_table_keeps_other_days(spark, tmp_path):
    path = str(tmp_path / "t")
    for day, v in (("2024-01-01", 1), ("2024-01-02", 2), ("2024-01-01", 3)):
        df = spark.createDataFrame([(v,)], "v int").withColumn("as_of", F.lit(day).cast("date"))
        sinks.write_table(df, path, ["as_of"])
    assert sorted(r.v for r in spark.read.parquet(path).collect()) == [2, 3]


def test_bucketed_tables_join_without_a_shuffle(spark):
    left = spark.range(1000).withColumn("v", F.col("id") * 2)
    for name in ("bucketed_a", "bucketed_b"):
        sinks.write_bucketed(left, name, "id", 4)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        joined = spark.table("bucketed_a").join(spark.table("bucketed_b"), "id")
        assert "Exchange hashpartitioning" not in joined._jdf.queryExecution().executedPlan().toString()
        assert joined.count() == 1000
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_payload_keeps_nulls(spark):
    df = spark.createDataFrame([(1, None)], "a int, b string")
    assert json.loads(sinks.to_payload(df).first()["payload"]) == {"a": 1, "b": None}


def test_certainty_weights(spark):
    e = spark.createDataFrame([("a", 100, "確定請求", "低"), ("a", 100, "口頭発注", "高"), ("a", 100, "口頭発注", None)], "project_id string, amount_kpy long, status string, certainty string")
    total = spark.createDataFrame([("a", 380.0), ("b", 10.0)], "project_id string, expected_total_kpy double")
    got = by(ops.weighted_cost_rate(e, total), "project_id")
    assert got["a"].weighted_cost_rate == pytest.approx(50.0) and got["b"].weighted_cost_rate == 0.0


@pytest.mark.parametrize("rate,score,want", [(75.0, None, None), (76.0, None, "注意"), (80.0, None, "注意"), (80.1, None, "警告"), (85.0, 0.0, "警告"), (85.1, None, "緊急"), (10.0, 0.7, "警告"), (10.0, 0.9, "緊急")])
def test_alert_tiers(spark, rate, score, want):
    df = spark.createDataFrame([(rate, 80.0, score)], "r double, t double, s double")
    assert df.select(ops.cost_alert_tier("r", "t", "s").alias("v")).first()["v"] == want


GRANTS = {
    "all": {"p": controls.Grant()},
    "head": {"p": controls.Grant(controls.DETAIL, controls.SUMMARY, scope="g")},
    "site": {"p": controls.Grant(controls.SUMMARY, controls.NOTHING, company=False, scope="who")},
    "own": {"p": controls.Grant(controls.DETAIL, controls.NOTHING, company=False, scope="who")},
}


def seen(spark, role, page="p", scope=None, rows=None):
    data = [("a", 1, "x", 10), ("a", 2, "y", 20), ("b", 3, "x", 5), ("b", 3, "x", 1), (None, 4, None, 7)] if rows is None else rows
    df = spark.createDataFrame(data, "g string, k int, who string, v long")
    got = controls.role_page(df, role, page, "g", "k", ["v"], scope, grants=GRANTS)
    return sorted(((r.level, r.g, r.k, r.row_count, r.v) for r in got.collect()), key=repr)


def test_role_pages(spark):
    detail = [("detail", "a", 1, 1, 10), ("detail", "a", 2, 1, 20), ("detail", "b", 3, 2, 6), ("detail", None, 4, 1, 7)]
    groups = [("group", "a", None, 2, 30), ("group", "b", None, 2, 6), ("group", None, None, 1, 7)]
    company = [("company", None, None, 5, 43)]
    assert seen(spark, "all") == sorted(company + detail + groups, key=repr)
    assert seen(spark, "head", scope={"g": ["b"]}) == sorted([*company, detail[2], *groups], key=repr)
    assert seen(spark, "head") == sorted(company + groups, key=repr)  # nothing is own, the rest in totals
    assert seen(spark, "site", scope={"who": ["x"]}) == [("group", "a", None, 1, 10), ("group", "b", None, 2, 6)]
    assert seen(spark, "own", scope={"who": ["y", "z"]}) == [("detail", "a", 2, 1, 20), ("group", "a", None, 1, 20)]
    assert seen(spark, "site") == seen(spark, "nobody") == seen(spark, "all", "closed") == seen(spark, "all", rows=[]) == []


def test_role_matrix():
    pages = {role: set(grants) for role, grants in controls.PAGE_GRANTS.items()}
    assert controls.ENTRY_PAGE in pages["現場監督"] and all(controls.ENTRY_PAGE not in p for r, p in pages.items() if r != "現場監督")
    assert controls.COMPANY_PAGE not in pages["現場監督"] and controls.AREA_PAGE not in pages["現場監督"]
    assert controls.grant_of("事業部長", controls.RISK_PAGE).rest == controls.NOTHING
    assert controls.grant_of("DX推進室", controls.PROFIT_PAGE).own == controls.SUMMARY


def area_months(n, area, rng):
    return [(area, f"{2020 + i // 12}-{i % 12 + 1:02d}", float(rng.normal()), float(rng.normal()), float(rng.normal())) for i in range(n)]


def test_area_effects_equal_least_squares(spark):
    rng = np.random.default_rng(1)
    rows = area_months(30, "a", rng) + area_months(24, "b", rng) + area_months(4, "short", rng)
    rows += [("flat", m, 1.0, x, y) for _, m, x, y, _ in area_months(20, "", rng)] + [("same", m, x, 2 * x, y) for _, m, x, y, _ in area_months(20, "", rng)]
    rows += [("a", "2019-12", None, 1.0, 1.0)]
    measures = ["m1", "m2", "m3"]
    areas = spark.createDataFrame(rows, "area_name string, month string, m1 double, m2 double, m3 double")
    results = [(a, m, 3 + 2 * x - y + 0.1 * z + 0.01 * rng.normal(), None if m.endswith("-05") else rng.normal()) for a, m, x, y, z in rows if x is not None]
    outcomes = spark.createDataFrame(results, "area_name string, month string, t1 double, t2 double")
    got = {}
    for r in ops.area_effects(areas, outcomes, measures, ["t1", "t2"], lags=(0, 2)).collect():
        got.setdefault((r.area, r.target, r.lag), {})[r.measure] = r
    assert {k for k in got if k[0] == "a"} == {("a", t, lag) for t in ("t1", "t2") for lag in (0, 2)}
    x = {(a, m): v for a, m, *v in rows}
    for area in ("a", "b"):
        months = sorted(m for a, m in x if a == area and m >= "2020")
        for i, target in enumerate(("t1", "t2")):
            y = {m: v[i] for a, m, *v in results if a == area}
            for lag in (0, 2):
                pairs = [(x[area, months[k]], y[months[k + lag]]) for k in range(len(months) - lag) if y[months[k + lag]] is not None]
                design = np.column_stack([np.ones(len(pairs)), np.array([p[0] for p in pairs])])
                want, rest, *_ = np.linalg.lstsq(design, np.array([p[1] for p in pairs]), rcond=None)
                cell = got[area, target, lag]
                assert [cell["m1"].intercept, *(cell[m].coefficient for m in measures)] == pytest.approx(want)
                assert cell["m1"].n == len(pairs)
                total = np.var([p[1] for p in pairs]) * len(pairs)
                assert cell["m1"].r2 == pytest.approx(1 - rest[0] / total)
                assert cell["m2"].effect_ahead == pytest.approx(want @ [1, *x[area, months[-1]]])
    reasons = {a: got[a, "t1", 0]["m1"].reason for a in ("a", "short", "flat", "same")}
    assert reasons == {"a": None, "short": "too few months", "flat": "measures depend on each other", "same": "measures depend on each other"}
    assert got["flat", "t1", 0]["m1"].coefficient is None


@pytest.mark.parametrize("span", ["month", "year", "day"])
def test_asof_join_equals_duckdb(spark, span):
    rng = np.random.default_rng(2)
    day = lambda n: dt.date(2020, 1, 1) + dt.timedelta(days=int(n))
    left = [(i, str(rng.choice(["a", "b", "c"])), day(rng.integers(0, 900)), 1) for i in range(200)]
    left += [(900, None, day(5), 1), (901, "a", None, 1), (902, "d", day(5), 1)]
    right = [(str(rng.choice(["a", "b"])), day(n), int(n), None if n % 3 else "x") for n in rng.choice(900, 40, replace=False) + 20]
    right += [("a", day(300), 5, "low"), ("a", day(300), 7, "high"), (None, day(1), 1, "no key"), ("a", None, 1, "no time")]
    ldf = spark.createDataFrame(left, "id long, k string, day date, v long")
    rdf = spark.createDataFrame(right, "k string, day date, v long, w string")
    got = sorted(tuple(r) for r in timeline.asof_join(ldf, rdf, "day", ["v", "w"], by=["k"], span=span).select("id", "v", "w").collect())
    con = duckdb.connect()
    con.execute("CREATE TABLE l (id BIGINT, k VARCHAR, day DATE, v BIGINT)")
    con.execute("CREATE TABLE r (k VARCHAR, day DATE, v BIGINT, w VARCHAR)")
    con.executemany("INSERT INTO l VALUES (?, ?, ?, ?)", left)
    con.executemany("INSERT INTO r VALUES (?, ?, ?, ?)", right)
    want = con.sql("SELECT id, x.v, x.w FROM l ASOF LEFT JOIN (SELECT k, day, arg_max(w, v) AS w, max(v) AS v FROM r GROUP BY 1, 2) x ON l.k = x.k AND l.day >= x.day").fetchall()
    # Where the value itself is NULL, the latest row still counts.
    assert [g[:2] for g in got] == [w[:2] for w in sorted(want)]
    assert {g[0]: g[2] for g in got if g[1] == 7} == {g[0]: "high" for g in got if g[1] == 7}
    alone = timeline.asof_join(ldf, rdf, "day", ["w"]).filter("id = 902").first()
    assert set(alone.asDict()) == {"id", "k", "day", "v", "w"}


def test_quality_is_counted_on_the_pass_that_writes(spark, tmp_path):
    passed = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            passed.add(b.num_rows)
            yield b

    df = spark.createDataFrame([(1, 50.0), (None, 101.0), (3, None)], "id int, v double").mapInArrow(count, "id int, v double")
    checks = {"not_null": ["id"], "ranges": {"v": (0, 100)}, "max_null_pct": 50.0}
    path = str(tmp_path / "t")
    report = quality.write_checked(df, lambda d: sinks.write_table(d, path), "t", **checks)
    rows = sorted(tuple(r) for r in report.collect())
    assert passed.value == 3
    written = spark.read.parquet(path)
    assert written.count() == 3 and rows == sorted(tuple(r) for r in quality.quality_report(written, "t", **checks).collect())
    assert [r.is_alert for r in report.orderBy("column_name").collect()] == [0, 1]
    empty = quality.write_checked(written.filter("false"), lambda d: sinks.write_table(d, path + "0"), "t", **checks)
    assert {(r.row_count, r.bad_pct, r.is_alert) for r in empty.collect()} == {(0, 0.0, 0)}


def test_business_growth_and_margin(spark):
    sales = [("x", f"{y}-06-01", v) for y, v in ((2022, 100), (2023, 150), (2024, 7))] + [("new", "2023-01-01", 10)]
    profits = [("x", "2022-06-01", 90), ("x", "2023-06-01", 30)]
    frame = lambda rows, c: spark.createDataFrame(rows, f"business string, month string, {c} long").withColumn("month", F.to_date("month"))
    got = by(ops.business_growth_and_margin(frame(sales, "sales_kpy"), frame(profits, "profit_kpy"), "2023-12"), "business")
    assert (got["x"].growth_pct, got["x"].margin_pct) == (50.0, 20.0)
    assert (got["new"].growth_pct, got["new"].margin_pct) == (None, None)
