import datetime as dt

from helpers import by, cash, cost, costs, project, projects, receipts
from pyspark.sql import functions as F

from girder.plans import views


def empty(spark, name):
    from girder import schemas

    return spark.createDataFrame([], schemas.TABLES[name])


def test_cost_summary_edges(spark):
    p = projects(spark, project("zero", contract=0), project("none"), project("edge", contract=1000, target=80.0), project("third", contract=1000))
    c = costs(spark, cost("zero", 5), cost("edge", 850), cost("third", 100), cost("third", 200, "労務費", "口頭発注"))
    got = by(views.project_cost_summary(p, c), "project_id")
    assert got["zero"].effective_cost_rate is None and got["zero"].risk_level == "正常"
    assert got["zero"].gross_profit == -5
    none = got["none"]
    assert (none.total_cost_kpy, none.gross_profit, none.effective_cost_rate) == (0, 1000, 0.0)
    assert none.outsourcing_ratio is None and none.risk_level == "正常"
    assert got["edge"].risk_level == "緊急" and got["edge"].cost_rate_gap == 5.0
    third = got["third"]
    assert (third.confirmed_cost_kpy, third.forecast_cost_kpy) == (100, 200)
    assert (third.outsourcing_ratio, third.labor_ratio, third.expense_ratio) == (33.3, 66.7, 0.0)


def test_category_detail_rounds_the_difference(spark):
    p = projects(spark, project("a", contract=10, target=50.0))
    got = by(views.cost_category_detail(p, costs(spark, cost("a", 0), cost("a", 1, "他"), cost("missing", 9))), "cost_category")
    assert got["外注費"].category_budget == 2  # 2.25
    assert got["外注費"].category_variance == 2
    assert (got["他"].category_budget, got["他"].category_actual, got["他"].category_variance) == (0, 1, -1)
    assert len(got) == 2
    half = by(views.cost_category_detail(projects(spark, project("a", contract=10, target=50.0)), costs(spark, cost("a", 5))), "cost_category")
    assert half["外注費"].category_variance == -3  # 2.25 - 5 = -2.75


def test_cashflow_has_one_sided_months_and_chained_balances(spark):
    r = receipts(spark, cash("a", 100, "2024-01", 90, "入金済"), cash("a", 50, "2024-02", None, "入金済"), cash("a", 70, "2024-04"))
    c = costs(spark, cost("a", 200, due="2024-03"), cost("a", 60000, status="口頭発注", due="2024-04"))
    rows = views.cashflow_forecast(r, c).orderBy("month_str").collect()
    assert [x.month_str for x in rows] == ["2024-01", "2024-02", "2024-03", "2024-04"]
    assert [x.actual_inflow_kpy for x in rows] == [90, 50, 0, 0]
    assert [x.net_cashflow_kpy for x in rows] == [100, 50, -200, -59930]
    assert rows[0].beginning_balance_kpy == 0
    for before, after in zip(rows, rows[1:]):
        assert after.beginning_balance_kpy == before.ending_balance_kpy
    assert [x.min_cash_flag for x in rows] == [0, 0, 1, 1]
    assert [x.cashflow_risk for x in rows] == ["正常", "正常", "注意", "資金不足リスク"]
    assert (rows[3].confirmed_outflow_kpy, rows[3].forecast_outflow_kpy) == (0, 60000)


def test_dashboard_spine_trailing_mean_and_activity(spark):
    months = ["2024-01", "2024-02", "2024-03", "2024-05", "2024-06"]
    r = receipts(spark, *[cash("a", 100 * (i + 1), m) for i, m in enumerate(months)])
    c = costs(spark, cost("a", 40, month="2024-02"), cost("a", 999, month="2024-04"))
    p = projects(
        spark,
        project("day1", start=dt.date(2024, 2, 1), end=dt.date(2024, 5, 1)),
        project("day2", start=dt.date(2024, 2, 2), end=dt.date(2024, 5, 31)),
        project("inside", start=dt.date(2024, 3, 2), end=dt.date(2024, 3, 30)),
    )
    args = [p, c, r] + [empty(spark, n) for n in ("real_estate_properties", "facility_operations", "saas_metrics")]
    rows = views.company_dashboard(*args).orderBy("sales_month").collect()
    assert [x.sales_month.strftime("%Y-%m") for x in rows] == months
    assert [x.forecast_sales for x in rows] == [None, 100, 150, 200, 300]
    assert [x.active_project_count for x in rows] == [0, 1, 2, 2, 0]
    assert [x.cash_balance for x in rows] == [100, 260, 560, 960, 1460]
    assert rows[1].operating_profit_margin == 80.0
    everything = views.company_dashboard(*args, spine="all").orderBy("sales_month").collect()
    assert [x.sales_month.strftime("%Y-%m") for x in everything] == ["2024-01", "2024-02", "2024-03", "2024-04", "2024-05", "2024-06"]
    assert everything[3].total_sales == 0 and everything[3].operating_profit_margin is None


def test_area_roi_covers_areas_of_any_source(spark):
    p = projects(spark, project("a", contract=500, name="沼津市改修工事"), project("b", contract=100, name="東京"))
    prop = spark.createDataFrame(
        [("R1", "x", "土地", "三島市", dt.date(2020, 1, 1), 1000, 1200, 10, 90.0)],
        empty(spark, "real_estate_properties").schema,
    )
    fac = spark.createDataFrame([("F1", "道の駅伊豆函南", "2024-01", 5, 300, 100, 200)], empty(spark, "facility_operations").schema)
    area = spark.createDataFrame([("裾野", "2024-01", 100.0, 10, 20, 1, 1)], empty(spark, "area_indicators").schema)
    got = by(views.area_roi(p, prop, fac, area), "area")
    assert set(got) == {"沼津", "その他", "三島", "函南", "裾野"}
    assert got["三島"].annual_rental_income_kpy == 120
    assert got["三島"].roi_rate == -88.0
    assert got["沼津"].roi_rate == 0.0
    assert got["函南"].roi_rate is None and got["函南"].total_return_kpy == 300
    assert (got["裾野"].population, got["裾野"].project_count) == (10.0, 0)


def test_model_view_drops_projects_without_cost(spark):
    p = projects(spark, project("a", start=dt.date(2024, 2, 29), end=dt.date(2024, 3, 1), progress=0.0), project("b"))
    got = views.ml_features(p, costs(spark, cost("a", 400), cost("a", 100, "経費", "現場見込み"))).collect()
    assert [r.project_id for r in got] == ["a"]
    r = got[0]
    assert (r.duration_months, r.cost_progress_ratio, r.actual_cost_rate) == (1, None, 50.0)
    assert (r.confirmed_count, r.forecast_count, r.cost_record_count) == (1, 1, 2)


def test_one_project_with_most_costs_keeps_whole_results(spark):
    n = 5000
    c = spark.range(n).select(
        F.when(F.col("id") % 3 == 0, F.concat(F.lit("p"), F.col("id"))).otherwise("hot").alias("project_id"),
        F.lit("外注費").alias("category"), F.lit(1).cast("long").alias("amount_kpy"), F.lit("確定請求").alias("status"),
    )
    got = views.project_costs(c).agg(F.sum("total_cost").alias("t"), F.max("total_cost").alias("m")).first()
    assert got.t == n and got.m == n - (n + 2) // 3
