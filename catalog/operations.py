"""Alerts, KPI documents, formulas and data quality over the stand-in tables."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from catalog import views as v
from catalog.registry import query
from girder.functions.exprs import label_by_rules, zero
from girder.operators.quality import quality_report, write_checked
from girder.operators.timeline import asof_join, by_time, running_total
from girder.plans import documents, marts
from girder.plans import operations as ops
from girder.plans.views import FACILITY_AREAS, OTHER_AREA, PROPERTY_AREAS
from girder.session import scratch_path, settle
from girder.sources import standins as src
from girder.sources.sinks import write_table

def rounded(df: DataFrame, digits: int, *cols: str) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in cols})


# --- alerts ----------------------------------------------------------------


@query(
    """SELECT *, CASE alert_level WHEN '緊急' THEN '事業部長,経営陣' WHEN '警告' THEN '現場監督,事業部長' ELSE '現場監督' END AS recipients
FROM (SELECT project_id, effective_cost_rate, target_cost_rate,
  CASE WHEN rate > target_cost_rate + 5 THEN '緊急' WHEN rate > target_cost_rate THEN '警告'
    WHEN rate >= target_cost_rate * 0.95::DOUBLE THEN '注意' END AS alert_level
  FROM (SELECT *, CAST(total_cost_kpy AS DOUBLE) / NULLIF(contract_amount_kpy, 0) * 100 AS rate FROM cost_summary))
WHERE alert_level IS NOT NULL""",
    "cost_summary",
)
def cost_alerts(spark: SparkSession, sf: str) -> DataFrame:
    return ops.cost_alerts(v.cost_summary(spark, sf))


@query(
    """SELECT *, CASE alert_level WHEN '緊急' THEN '事業部長,経営陣' WHEN '警告' THEN '現場監督,事業部長' ELSE '現場監督' END AS recipients
FROM (SELECT project_id, effective_cost_rate, target_cost_rate,
  CASE WHEN rate > target_cost_rate + 5 OR progress_rate >= 90 THEN '緊急' WHEN rate > target_cost_rate OR progress_rate >= 70 THEN '警告'
    WHEN rate >= target_cost_rate * 0.95::DOUBLE THEN '注意' END AS alert_level
  FROM (SELECT *, CAST(total_cost_kpy AS DOUBLE) / NULLIF(contract_amount_kpy, 0) * 100 AS rate FROM cost_summary))
WHERE alert_level IS NOT NULL""",
    "cost_summary",
)
def scored_cost_alerts(spark: SparkSession, sf: str) -> DataFrame:
    """Alert tiers by rate or by a 0-100 score; the progress stands in for the score, so each tier is reached by either."""
    return ops.cost_alerts(v.cost_summary(spark, sf), score=F.col("progress_rate"))


@query(
    """SELECT project_id, target_cost_rate, CASE WHEN division = '土木' AND client_type = '官公庁' THEN 88.0::DOUBLE WHEN division = '土木' THEN 85.0::DOUBLE
  WHEN client_type = '官公庁' THEN 86.0::DOUBLE ELSE 82.0::DOUBLE END AS work_type_target FROM projects""",
    "projects",
)
def work_type_targets(spark: SparkSession, sf: str) -> DataFrame:
    projects = src.projects(spark, sf, ("project_id", "division", "client_type", "target_cost_rate"))
    return ops.work_type_targets(projects).select("project_id", "target_cost_rate", "work_type_target")


@query(
    """SELECT CAST(d AS INTEGER) AS days_ahead, CAST(DATE '2000-01-01' + CAST(d AS INTEGER) AS DATE) AS target_date, ending_balance_kpy,
  CASE WHEN ending_balance_kpy < 0 THEN 1 ELSE 0 END AS is_below_safety
FROM (SELECT unnest([30, 60, 90]) AS d) JOIN cashflow ON cf_date = date_trunc('month', DATE '2000-01-01' + CAST(d AS INTEGER))""",
    "cashflow",
)
def balance_outlook(spark: SparkSession, sf: str) -> DataFrame:
    return ops.balance_outlook(v.cashflow(spark, sf), src.AS_OF, safety=0)


@query(
    """SELECT schedule_id, project_id, milestone, expected_amount_kpy, expected_date,
  CAST(date_diff('day', expected_date, DATE '2000-01-01') AS INTEGER) AS days_late
FROM cash_in WHERE actual_amount_kpy IS NULL AND date_diff('day', expected_date, DATE '2000-01-01') > 7""",
    "cash_in",
)
def overdue_receipts(spark: SparkSession, sf: str) -> DataFrame:
    return ops.overdue_receipts(src.cash_in(spark, sf), src.AS_OF)


# --- company and area ------------------------------------------------------

AREA_VALUE = """area_index AS (SELECT area_name AS area, arg_min(land_price_index, month) AS first_index, arg_max(land_price_index, month) AS last_index FROM areas GROUP BY 1),
area_value AS (SELECT r.*, COALESCE(acq, 0) AS acq, property_value_kpy * COALESCE((last_index - first_index) / NULLIF(first_index, 0), 0) AS gain
  FROM roi r LEFT JOIN area_index USING (area))"""


@query(
    """SELECT area, round(gain, 2) AS value_change_kpy, total_investment_kpy AS investment_kpy,
  round((construction_revenue_kpy + annual_rental_income_kpy + facility_profit_kpy + gain) / NULLIF(total_investment_kpy, 0) * 100, 4) AS area_roi_pct
FROM area_value""",
    "roi areas",
    AREA_VALUE.replace("COALESCE(acq, 0) AS acq, ", ""),
)
def area_value_roi(spark: SparkSession, sf: str) -> DataFrame:
    return ops.area_value_roi(
        src.projects(spark, sf, ("project_name", "contract_amount_kpy")),
        src.properties(spark, sf),
        src.facilities(spark, sf),
        src.areas(spark, sf),
    )


@query(
    """SELECT property_id, property_type, current_value_kpy - acquisition_cost_kpy AS unrealised_gain_kpy,
  CAST(monthly_rental_income_kpy * 12 AS DOUBLE) / NULLIF(acquisition_cost_kpy, 0) * 100 AS gross_yield_pct,
  100.0::DOUBLE - occupancy_rate AS vacancy_pct,
  CAST(floor(date_diff('day', acquisition_date, DATE '2000-01-01') / 365.25::DOUBLE) AS INTEGER) AS age_years FROM properties""",
    "properties",
)
def property_yields(spark: SparkSession, sf: str) -> DataFrame:
    return ops.property_yields(src.properties(spark, sf), src.AS_OF)


@query(
    """SELECT facility_name, CAST(month || '-01' AS DATE) AS month, visitors, revenue_kpy, operating_profit_kpy,
  CAST(revenue_kpy AS DOUBLE) / NULLIF(visitors, 0) AS revenue_per_visitor, CAST(visitors AS DOUBLE) / 200 * 100 AS capacity_use_pct FROM facilities""",
    "facilities",
)
def facility_months(spark: SparkSession, sf: str) -> DataFrame:
    return ops.facility_months(src.facilities(spark, sf), capacity=200)


@query(
    """SELECT f.facility_name, f.month, f.revenue_kpy, l.revenue_kpy AS revenue_kpy_last_year,
  CAST(f.revenue_kpy - l.revenue_kpy AS DOUBLE) / NULLIF(l.revenue_kpy, 0) * 100 AS growth_pct,
  CAST(sum(f.revenue_kpy) OVER w AS DOUBLE) / count(*) OVER w AS mean_3m
FROM f LEFT JOIN f l ON l.facility_name = f.facility_name AND l.month + INTERVAL 12 MONTH = f.month
WINDOW w AS (PARTITION BY f.facility_name ORDER BY f.month ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)""",
    "facilities",
    "f AS (SELECT facility_name, CAST(month || '-01' AS DATE) AS month, revenue_kpy FROM facilities)",
)
def facility_season(spark: SparkSession, sf: str) -> DataFrame:
    return ops.facility_season(src.facilities(spark, sf))


BUSINESS = """business AS (SELECT business, month, CAST(sum(s) AS BIGINT) AS sales_kpy FROM (
  SELECT '建設事業' AS business, CAST(deposit_month || '-01' AS DATE) AS month, expected_amount_kpy AS s FROM cash_in
  UNION ALL SELECT '不動産事業', CAST(deposit_month || '-01' AS DATE), (SELECT CAST(sum(monthly_rental_income_kpy) AS BIGINT) FROM properties) FROM (SELECT DISTINCT deposit_month FROM cash_in)
  UNION ALL SELECT '施設運営', CAST(month || '-01' AS DATE), revenue_kpy FROM facilities
  UNION ALL SELECT 'SaaS事業', CAST(month || '-01' AS DATE), mrr_kpy FROM saas) GROUP BY ALL)"""


def business(spark: SparkSession, sf: str) -> DataFrame:
    return ops.business_sales(
        src.cash_in(spark, sf), src.properties(spark, sf), src.facilities(spark, sf), src.saas(spark, sf)
    )


@query(
    """SELECT b.business, b.month, b.sales_kpy, CAST(b.sales_kpy AS DOUBLE) / sum(b.sales_kpy) OVER (PARTITION BY b.month) * 100 AS share_pct,
  l.sales_kpy AS sales_kpy_last_year, CAST(b.sales_kpy - l.sales_kpy AS DOUBLE) / NULLIF(l.sales_kpy, 0) * 100 AS growth_pct
FROM business b LEFT JOIN business l ON l.business = b.business AND l.month + INTERVAL 12 MONTH = b.month""",
    "cash_in properties facilities saas",
    BUSINESS,
)
def segment_growth(spark: SparkSession, sf: str) -> DataFrame:
    return ops.segment_growth(business(spark, sf))


@query(
    """SELECT sales_month, total_sales, employees, CAST(total_sales AS DOUBLE) / NULLIF(employees, 0) AS sales_per_employee
FROM dashboard LEFT JOIN (SELECT CAST(date_trunc('month', o_orderdate) AS DATE) AS sales_month, count(DISTINCT o_custkey) AS employees FROM orders GROUP BY 1) USING (sales_month)""",
    "dashboard",
)
def sales_per_employee(spark: SparkSession, sf: str) -> DataFrame:
    return ops.sales_per_employee(v.dashboard(spark, sf), src.headcount(spark, sf))


@query(
    """SELECT *, CASE WHEN growth_pct >= 0 AND margin_pct >= 10 THEN '成長・高収益' WHEN growth_pct >= 0 THEN '成長・低収益'
  WHEN margin_pct >= 10 THEN '停滞・高収益' ELSE '停滞・低収益' END AS quadrant FROM (
  SELECT facility_name, round(CAST(late - early AS DOUBLE) / NULLIF(early, 0) * 100, 6) AS growth_pct, round(CAST(profit AS DOUBLE) / NULLIF(revenue, 0) * 100, 6) AS margin_pct
  FROM (SELECT facility_name, sum(CASE WHEN d < half THEN revenue_kpy ELSE 0 END) AS early, sum(CASE WHEN d >= half THEN revenue_kpy ELSE 0 END) AS late,
    sum(operating_profit_kpy) AS profit, sum(revenue_kpy) AS revenue
    FROM (SELECT *, CAST(month || '-01' AS DATE) AS d FROM facilities) JOIN (
      SELECT facility_name, lo + to_months(CAST(floor((date_diff('month', lo, hi) + 1) / 2) AS INTEGER)) AS half FROM (
        SELECT facility_name, min(CAST(month || '-01' AS DATE)) AS lo, max(CAST(month || '-01' AS DATE)) AS hi FROM facilities GROUP BY 1)) USING (facility_name)
    GROUP BY 1))""",
    "facilities",
)
def portfolio_matrix(spark: SparkSession, sf: str) -> DataFrame:
    figures = ops.facility_growth_and_margin(src.facilities(spark, sf))
    return ops.portfolio_matrix(rounded(figures, 6, "growth_pct", "margin_pct"))


PORTFOLIO_MONTH = "1998-12"


@query(
    f"""SELECT *, CASE WHEN growth_pct >= 0 AND margin_pct >= 10 THEN '成長・高収益' WHEN growth_pct >= 0 AND margin_pct < 10 THEN '成長・低収益'
  WHEN growth_pct < 0 AND margin_pct >= 10 THEN '停滞・高収益' WHEN growth_pct < 0 AND margin_pct < 10 THEN '停滞・低収益' END AS quadrant FROM (
  SELECT business, CAST(now_kpy AS BIGINT) AS sales_kpy, CAST(before_kpy AS BIGINT) AS previous_sales_kpy, CAST(profit AS BIGINT) AS profit_kpy,
    round(CAST(now_kpy - before_kpy AS DOUBLE) / NULLIF(before_kpy, 0) * 100, 6) AS growth_pct, round(CAST(profit AS DOUBLE) / NULLIF(now_kpy, 0) * 100, 6) AS margin_pct
  FROM (SELECT business, sum(CASE WHEN month > DATE '{PORTFOLIO_MONTH}-01' - INTERVAL 12 MONTH THEN sales_kpy ELSE 0 END) AS now_kpy,
    sum(CASE WHEN month <= DATE '{PORTFOLIO_MONTH}-01' - INTERVAL 12 MONTH THEN sales_kpy ELSE 0 END) AS before_kpy
    FROM business WHERE month <= DATE '{PORTFOLIO_MONTH}-01' AND month > DATE '{PORTFOLIO_MONTH}-01' - INTERVAL 24 MONTH GROUP BY 1)
  LEFT JOIN (SELECT '建設事業' AS business, (SELECT sum(expected_amount_kpy) FROM cash_in WHERE CAST(deposit_month || '-01' AS DATE) > DATE '{PORTFOLIO_MONTH}-01' - INTERVAL 12 MONTH AND deposit_month <= '{PORTFOLIO_MONTH}')
      - (SELECT sum(amount_kpy) FROM costs WHERE CAST(accrual_month || '-01' AS DATE) > DATE '{PORTFOLIO_MONTH}-01' - INTERVAL 12 MONTH AND accrual_month <= '{PORTFOLIO_MONTH}') AS profit
    UNION ALL SELECT '施設運営', (SELECT sum(operating_profit_kpy) FROM facilities WHERE CAST(month || '-01' AS DATE) > DATE '{PORTFOLIO_MONTH}-01' - INTERVAL 12 MONTH AND month <= '{PORTFOLIO_MONTH}')) USING (business))""",
    "cash_in properties facilities saas costs",
    BUSINESS,
)
def business_portfolio(spark: SparkSession, sf: str) -> DataFrame:
    """Each business by the growth of its sales over a year and its margin; two have no cost table and so no margin."""
    profits = ops.business_profits(
        src.cash_in(spark, sf), src.cost_records(spark, sf, ("accrual_month", "amount_kpy")), src.facilities(spark, sf)
    )
    figures = ops.business_growth_and_margin(business(spark, sf), profits, PORTFOLIO_MONTH)
    return ops.portfolio_matrix(rounded(figures, 6, "growth_pct", "margin_pct"))


# --- construction ----------------------------------------------------------


@query(
    """SELECT project_id, COALESCE(w, 0) AS weighted_cost_kpy, round(COALESCE(w, 0) / NULLIF(CAST(contract_amount_kpy AS DOUBLE) * target_cost_rate / 100, 0) * 100, 6) AS weighted_cost_rate
FROM projects LEFT JOIN (SELECT project_id, round(sum(CAST(amount_kpy * CAST(CASE WHEN status = '確定請求' THEN 100 WHEN certainty = '高' THEN 90 WHEN certainty = '中' THEN 65 ELSE 30 END AS BIGINT) AS BIGINT)) / 100.0, 2)::DOUBLE AS w
  FROM entries GROUP BY 1) USING (project_id)""",
    "projects",
    """entries AS (SELECT l_orderkey AS project_id, CAST(round(l_extendedprice * 100) AS BIGINT) AS amount_kpy,
  CASE l_returnflag WHEN 'A' THEN '確定請求' ELSE l_returnflag END AS status,
  CASE l_linenumber % 3 WHEN 0 THEN '高' WHEN 1 THEN '中' ELSE '低' END AS certainty FROM lineitem)""",
)
def weighted_cost_rate(spark: SparkSession, sf: str) -> DataFrame:
    entries = src.cost_records(spark, sf, ("project_id", "amount_kpy", "status", "certainty"))
    expected = src.projects(spark, sf, ("project_id", "contract_amount_kpy", "target_cost_rate")).select(
        "project_id", (F.col("contract_amount_kpy") * F.col("target_cost_rate") / 100).alias("expected_total_kpy")
    )
    rates = ops.weighted_cost_rate(entries, expected)
    return rounded(rounded(rates, 2, "weighted_cost_kpy"), 6, "weighted_cost_rate")


@query(
    """SELECT division, step, item, amount_kpy, CAST(sum(amount_kpy) OVER (PARTITION BY division ORDER BY step) AS BIGINT) AS running_kpy
FROM (SELECT division, CAST(unnest([1, 2, 3]) AS INTEGER) AS step, unnest(['当初予算', '確定原価', '予兆原価']) AS item, unnest([b, -c, -f]) AS amount_kpy
  FROM (SELECT division, CAST(round(sum(CAST(contract_amount_kpy * CAST(target_cost_rate AS BIGINT) AS DECIMAL(38, 2)) / 100)) AS BIGINT) AS b,
    CAST(sum(confirmed_cost_kpy) AS BIGINT) AS c, CAST(sum(forecast_cost_kpy) AS BIGINT) AS f FROM cost_summary GROUP BY 1))""",
    "cost_summary",
)
def cost_waterfall(spark: SparkSession, sf: str) -> DataFrame:
    return ops.cost_waterfall(v.cost_summary(spark, sf))


@query(
    """SELECT accrual_month, category, CAST(sum(amount_kpy) AS BIGINT) AS amount_kpy,
  CAST(sum(amount_kpy) AS DOUBLE) / sum(sum(amount_kpy)) OVER (PARTITION BY accrual_month) * 100 AS share_pct FROM costs GROUP BY 1, 2""",
    "costs",
)
def category_share_trend(spark: SparkSession, sf: str) -> DataFrame:
    return ops.category_share_trend(src.cost_records(spark, sf, ("accrual_month", "category", "amount_kpy")))


@query(
    """SELECT month, CAST(round(sum(revenue)) AS BIGINT) AS revenue_kpy, CAST(sum(cost) AS BIGINT) AS cost_kpy,
  CAST(round(sum(revenue) - sum(cost)) AS BIGINT) AS gross_profit_kpy
FROM (SELECT COALESCE(accrual_month, strftime(start_date, '%Y-%m')) AS month, contract_amount_kpy * progress_rate / 100 * COALESCE(CAST(cost AS DOUBLE) / NULLIF(total, 0), 1) AS revenue,
    COALESCE(cost, 0) AS cost
  FROM projects LEFT JOIN (SELECT project_id, sum(amount_kpy) AS total FROM costs GROUP BY 1) USING (project_id)
  LEFT JOIN (SELECT project_id, accrual_month, sum(amount_kpy) AS cost FROM costs GROUP BY 1, 2) USING (project_id)) GROUP BY 1""",
    "projects costs",
)
def earned_value_months(spark: SparkSession, sf: str) -> DataFrame:
    months = ops.earned_value_months(
        src.projects(spark, sf, ("project_id", "contract_amount_kpy", "progress_rate", "start_date")),
        src.cost_records(spark, sf, ("project_id", "accrual_month", "amount_kpy")),
    )
    return months.withColumns({c: F.round(c).cast("long") for c in ("revenue_kpy", "gross_profit_kpy")})


# --- subscriptions and programmes ------------------------------------------


@query(
    """SELECT product, CAST(month || '-01' AS DATE) AS month, mrr_kpy, customers, new_customers, churn_rate_pct,
  CAST(mrr_kpy AS DOUBLE) / NULLIF(customers, 0) AS arpu_kpy FROM saas""",
    "saas",
)
def saas_trend(spark: SparkSession, sf: str) -> DataFrame:
    return ops.saas_trend(src.saas(spark, sf))


@query(
    """SELECT product, CAST(month || '-01' AS DATE) AS month, p AS previous_mrr_kpy,
  round((p + expansion_mrr_kpy - p * churn_rate_pct / 100) / NULLIF(p, 0) * 100, 8) AS nrr_pct
FROM (SELECT *, lag(mrr_kpy) OVER (PARTITION BY product ORDER BY month) AS p FROM saas)""",
    "saas",
)
def net_revenue_retention(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(ops.net_revenue_retention(src.saas(spark, sf)), 8, "nrr_pct")


@query(
    """SELECT product, month, round(ltv, 6) AS ltv_kpy, cac_kpy, round(ltv / NULLIF(cac_kpy, 0), 6) AS ltv_cac
FROM (SELECT product, month, CAST(mrr_kpy AS DOUBLE) / NULLIF(customers, 0) * (100.0::DOUBLE / NULLIF(churn_rate_pct, 0)) AS ltv, expansion_mrr_kpy + 1000 AS cac_kpy FROM saas)""",
    "saas",
)
def ltv_cac(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(ops.ltv_cac(src.saas(spark, sf), src.acquisition_costs(spark, sf)), 6, "ltv_kpy", "ltv_cac")


MEASURES = """measures AS (SELECT event_type AS program, strftime(DATE '1996-01-01' + to_months(CAST(day(ts) - 1 AS INTEGER)), '%Y-%m') AS month,
  CASE WHEN value < 10 THEN 'cost' ELSE 'effect' END AS metric, user_id AS participant, CAST(round(value * 100) AS BIGINT) AS amount_kpy FROM events)"""


@query(
    """SELECT program, metric, count(*) AS entries, count(DISTINCT participant) AS participants, CAST(sum(amount_kpy) AS BIGINT) AS amount_kpy
FROM measures GROUP BY 1, 2""",
    "",
    MEASURES,
)
def program_counters(spark: SparkSession, sf: str) -> DataFrame:
    return ops.program_counters(src.program_measures(spark, sf))


@query(
    """SELECT *, CAST(running_effect_kpy - running_cost_kpy AS DOUBLE) / NULLIF(running_cost_kpy, 0) * 100 AS roi_pct FROM (
  SELECT program, month, cost_kpy, effect_kpy, CAST(sum(effect_kpy) OVER w AS BIGINT) AS running_effect_kpy, CAST(sum(cost_kpy) OVER w AS BIGINT) AS running_cost_kpy
  FROM (SELECT program, month, CAST(sum(CASE WHEN metric = 'cost' THEN amount_kpy ELSE 0 END) AS BIGINT) AS cost_kpy,
    CAST(sum(CASE WHEN metric = 'effect' THEN amount_kpy ELSE 0 END) AS BIGINT) AS effect_kpy FROM measures GROUP BY 1, 2)
  WINDOW w AS (PARTITION BY program ORDER BY month))""",
    "",
    MEASURES,
)
def program_cost_effect(spark: SparkSession, sf: str) -> DataFrame:
    return ops.cost_effect(src.program_measures(spark, sf))


# --- forecasting inputs ----------------------------------------------------


@query(
    """SELECT month, amount_kpy, rain_days, steel_index, round((steel_index - lag(steel_index) OVER w) / NULLIF(lag(steel_index) OVER w, 0) * 100, 6) AS steel_index_mom_pct,
  concrete_index, round((concrete_index - lag(concrete_index) OVER w) / NULLIF(lag(concrete_index) OVER w, 0) * 100, 6) AS concrete_index_mom_pct
FROM (SELECT accrual_month AS month, CAST(sum(amount_kpy) AS BIGINT) AS amount_kpy FROM costs GROUP BY 1) LEFT JOIN external_factors USING (month) WINDOW w AS (ORDER BY month)""",
    "costs external_factors",
)
def costs_with_external_factors(spark: SparkSession, sf: str) -> DataFrame:
    monthly = (
        src.cost_records(spark, sf, ("accrual_month", "amount_kpy"))
        .groupBy(F.col("accrual_month").alias("month"))
        .agg(F.sum("amount_kpy").alias("amount_kpy"))
    )
    joined = ops.with_external_factors(monthly, src.external_factors(spark, sf))
    return rounded(joined, 6, "steel_index_mom_pct", "concrete_index_mom_pct")


@query(
    """SELECT project_id, p.division, p.start_date, announced_on, steel_index
FROM projects p ASOF LEFT JOIN (SELECT division, start_date AS announced_on, max(contract_amount_kpy % 1000) AS steel_index FROM projects WHERE project_id % 50 = 0 GROUP BY 1, 2) a
  ON p.division = a.division AND p.start_date >= a.announced_on""",
    "projects",
)
def projects_with_latest_price(spark: SparkSession, sf: str) -> DataFrame:
    """Every project with the price announced last before it began; announcements come at irregular dates."""
    projects = src.projects(spark, sf, ("project_id", "division", "start_date", "contract_amount_kpy"))
    announced = projects.filter(F.col("project_id") % 50 == 0).select(
        "division", "start_date", F.col("start_date").alias("announced_on"), (F.col("contract_amount_kpy") % 1000).alias("steel_index")
    )
    return asof_join(projects.drop("contract_amount_kpy"), announced, "start_date", ["announced_on", "steel_index"], by=["division"])


@query(
    """SELECT project_id, greatest(0.0::DOUBLE, least(1.0::DOUBLE, CAST(date_diff('day', start_date, DATE '2000-01-01') AS DOUBLE) / NULLIF(date_diff('day', start_date, end_date), 0))) AS elapsed_share,
  total_cost_kpy / NULLIF(contract_amount_kpy * target_cost_rate / 100, 0) AS cost_burn, forecast_cost_kpy / NULLIF(contract_amount_kpy * target_cost_rate / 100, 0) AS sign_cost_rate,
  CAST(month(start_date) AS INTEGER) AS season_month, CAST(year(start_date) - CASE WHEN month(start_date) < 4 THEN 1 ELSE 0 END AS INTEGER) AS fiscal_year FROM cost_summary""",
    "cost_summary",
)
def progress_features(spark: SparkSession, sf: str) -> DataFrame:
    return ops.progress_features(v.cost_summary(spark, sf), src.AS_OF)


@query(
    """SELECT week_start, events, value_cents, CAST(events - lag(events) OVER w AS DOUBLE) / NULLIF(lag(events) OVER w, 0) * 100 AS events_change_pct,
  CAST(value_cents - lag(value_cents) OVER w AS DOUBLE) / NULLIF(lag(value_cents) OVER w, 0) * 100 AS value_cents_change_pct
FROM (SELECT CAST(date_trunc('week', ts) AS DATE) AS week_start, count(*) AS events, CAST(sum(CAST(round(value * 100) AS BIGINT)) AS BIGINT) AS value_cents FROM events GROUP BY 1)
WINDOW w AS (ORDER BY week_start)""",
)
def weekly_kpi_change(spark: SparkSession, sf: str) -> DataFrame:
    events = src.source(spark, sf, "events").select(F.to_date("ts").alias("day"), src.cents("value").alias("cents"))
    return ops.weekly_change(events, "day", {"events": F.count("*"), "value_cents": F.sum("cents")})


EFFECT_MEASURES = ("land_price_index", "foot_traffic", "event_count")


@query(
    " UNION ALL ".join(
        f"""SELECT '{m}' AS measure, round(corr(visitors, {m}), 6) AS correlation, round(regr_slope(visitors, {m}), 6) AS slope,
  round(regr_intercept(visitors, {m}), 4) AS intercept, round(regr_intercept(visitors, {m}) + regr_slope(visitors, {m}) * arg_max({m}, month), 4) AS effect_at_last_month FROM effect_months"""
        for m in EFFECT_MEASURES
    ),
    "areas facilities",
    """effect_months AS (SELECT * FROM (SELECT month, avg(land_price_index) AS land_price_index, avg(foot_traffic) AS foot_traffic, avg(event_count) AS event_count FROM areas GROUP BY 1)
  JOIN (SELECT month, CAST(sum(visitors) AS DOUBLE) AS visitors FROM facilities GROUP BY 1) USING (month))""",
)
def area_effect_on_visitors(spark: SparkSession, sf: str) -> DataFrame:
    visitors = src.facilities(spark, sf).groupBy("month").agg(F.sum("visitors").alias("visitors"))
    effect = ops.area_effect(src.areas(spark, sf), visitors, EFFECT_MEASURES, "visitors")
    return rounded(rounded(effect, 6, "correlation", "slope"), 4, "intercept", "effect_at_last_month")


LAGGED_MEASURES, LAGGED_TARGETS, LAGS = ("foot_traffic", "event_count"), ("visitors", "orders", "occupancy"), (0, 1, 3)
AREA_OUTCOMES = """area_orders AS (SELECT area_name, strftime(start_date, '%Y-%m') AS month, count(*) AS orders FROM projects GROUP BY ALL),
area_visitors AS (SELECT CASE WHEN facility_name LIKE '%函南%' OR facility_name LIKE '%伊豆%' THEN '函南' WHEN facility_name LIKE '%三島%' OR facility_name LIKE '%未来%' THEN '三島'
    WHEN facility_name LIKE '%沼津%' THEN '沼津' ELSE 'その他' END AS area_name, month, CAST(sum(visitors) AS BIGINT) AS visitors FROM facilities GROUP BY ALL),
bought AS (SELECT CASE WHEN location LIKE '%三島%' THEN '三島' WHEN location LIKE '%沼津%' THEN '沼津' WHEN location LIKE '%函南%' THEN '函南' ELSE 'その他' END AS area_name,
    strftime(acquisition_date + INTERVAL 7 YEAR, '%Y-%m') AS month, occupancy_rate FROM properties),
area_occupancy AS (SELECT a.area_name, a.month, avg(occupancy_rate) AS occupancy FROM areas a JOIN bought b ON a.area_name = b.area_name AND b.month <= a.month GROUP BY ALL),
outcomes AS (SELECT area_name, month, visitors, orders, occupancy FROM area_orders FULL JOIN area_visitors USING (area_name, month) FULL JOIN area_occupancy USING (area_name, month)),
explained AS (SELECT a.area_name, lag, target, CAST(a.foot_traffic AS DOUBLE) AS x1, CAST(a.event_count AS DOUBLE) AS x2, y FROM areas a JOIN (
    SELECT area_name, lag, strftime(CAST(month || '-01' AS DATE) - to_months(lag), '%Y-%m') AS month, target, y FROM (
      SELECT area_name, month, 'visitors' AS target, CAST(visitors AS DOUBLE) AS y FROM outcomes UNION ALL SELECT area_name, month, 'orders', CAST(orders AS DOUBLE) FROM outcomes
      UNION ALL SELECT area_name, month, 'occupancy', occupancy FROM outcomes), (SELECT unnest([0, 1, 3])::INTEGER AS lag)) o
    ON a.area_name = o.area_name AND a.month = o.month WHERE y IS NOT NULL),
crossed AS (SELECT area_name, target, lag, count(*) AS n, covar_pop(x1, x1) AS s11, covar_pop(x1, x2) AS s12, covar_pop(x2, x2) AS s22, covar_pop(x1, y) AS s1y, covar_pop(x2, y) AS s2y,
    avg(x1) AS m1, avg(x2) AS m2, avg(y) AS my, var_pop(y) AS spread FROM explained GROUP BY ALL),
solved AS (SELECT *, CASE WHEN n <= 3 THEN 'too few months' WHEN s11 * s22 - s12 * s12 <= 1e-9 * s11 * s22 THEN 'measures depend on each other' END AS reason FROM crossed),
effects AS (SELECT *, CASE WHEN reason IS NULL THEN (s1y * s22 - s2y * s12) / (s11 * s22 - s12 * s12) END AS b1, CASE WHEN reason IS NULL THEN (s2y * s11 - s1y * s12) / (s11 * s22 - s12 * s12) END AS b2 FROM solved),
latest AS (SELECT area_name, arg_max(foot_traffic, month) AS l1, arg_max(event_count, month) AS l2 FROM areas GROUP BY 1)"""


@query(
    """SELECT area_name AS area, target, lag, n, round(my - b1 * m1 - b2 * m2, 4) AS intercept, CASE WHEN spread > 0 THEN round((b1 * s1y + b2 * s2y) / spread, 6) END AS r2, reason,
  unnest(['foot_traffic', 'event_count']) AS measure, unnest([round(b1, 5), round(b2, 5)]) AS coefficient, round(my + b1 * (l1 - m1) + b2 * (l2 - m2), 4) AS effect_ahead
FROM effects JOIN latest USING (area_name)""",
    "areas facilities projects properties",
    AREA_OUTCOMES,
)
def area_effects_by_area(spark: SparkSession, sf: str) -> DataFrame:
    """What foot traffic and events of an area let expect of its visitors, orders and occupancy, now and later.

    Properties have one occupancy for good, so an area's monthly one is the mean of those bought until then.
    """
    effects = ops.area_effects(src.areas(spark, sf), area_outcomes(spark, sf), LAGGED_MEASURES, LAGGED_TARGETS, LAGS)
    return rounded(rounded(rounded(effects, 4, "intercept", "effect_ahead"), 5, "coefficient"), 6, "r2")


def area_outcomes(spark: SparkSession, sf: str) -> DataFrame:
    """Visitors, orders and occupancy of every area and month, stacked and grouped once."""
    months = src.areas(spark, sf).select("area_name", "month")
    orders = src.projects(spark, sf, ("area_name", "start_date")).select(
        "area_name", F.date_format("start_date", "yyyy-MM").alias("month"), F.lit(1).cast("long").alias("orders")
    )
    visitors = src.facilities(spark, sf).select(label_by_rules("facility_name", FACILITY_AREAS, OTHER_AREA).alias("area_name"), "month", "visitors")
    bought = src.properties(spark, sf).select(
        label_by_rules("location", PROPERTY_AREAS, OTHER_AREA).alias("area_name"),
        F.date_format(F.add_months("acquisition_date", 84), "yyyy-MM").alias("month"),
        "occupancy_rate",
    )
    sums = bought.groupBy("area_name", "month").agg(F.sum("occupancy_rate").alias("rate"), F.count("*").alias("owned"))
    w = by_time("month", ["area_name"])
    held = months.withColumn("asked", F.lit(True)).unionByName(sums, allowMissingColumns=True)
    held = held.groupBy("area_name", "month").agg(F.max("asked").alias("asked"), F.sum("rate").alias("rate"), F.sum("owned").alias("owned"))
    occupancy = held.withColumn("occupancy", running_total(zero("rate"), w) / F.nullif(running_total(zero("owned"), w), F.lit(0)))
    occupancy = occupancy.filter("asked").select("area_name", "month", "occupancy")
    rows = orders.unionByName(visitors, allowMissingColumns=True).unionByName(occupancy, allowMissingColumns=True)
    return rows.groupBy("area_name", "month").agg(*[F.sum(t).alias(t) for t in LAGGED_TARGETS])


@query(
    """SELECT CAST(month(cf_date) AS INTEGER) AS calendar_month, round(avg(expected_inflow_kpy), 2) AS month_mean,
  round(avg(expected_inflow_kpy) / (SELECT avg(expected_inflow_kpy) FROM cashflow), 8) AS season_index FROM cashflow GROUP BY 1""",
    "cashflow",
)
def inflow_season_index(spark: SparkSession, sf: str) -> DataFrame:
    index = ops.season_index(v.cashflow(spark, sf), "expected_inflow_kpy", "cf_date")
    return rounded(rounded(index, 2, "month_mean"), 8, "season_index")


# --- data quality ----------------------------------------------------------


def check_sql(column: str, check: str, bad: str, limit: float) -> str:
    return f"""SELECT 'projects_master' AS table_name, '{column}' AS column_name, '{check}' AS "check", count(*) AS row_count,
  count(CASE WHEN {bad} THEN 1 END) AS bad_count, {limit}::DOUBLE AS limit_pct,
  CAST(count(CASE WHEN {bad} THEN 1 END) AS DOUBLE) / count(*) * 100 AS bad_pct,
  CASE WHEN CAST(count(CASE WHEN {bad} THEN 1 END) AS DOUBLE) / count(*) * 100 > {limit} THEN 1 ELSE 0 END AS is_alert FROM projects"""


QUALITY = " UNION ALL ".join(
    (
        check_sql("project_id", "null", "project_id IS NULL", 0.0),
        check_sql("pm_name", "null", "pm_name IS NULL", 0.0),
        check_sql("target_cost_rate", "range", "target_cost_rate < 50 OR target_cost_rate > 88", 5.0),
        check_sql("contract_amount_kpy", "range", "contract_amount_kpy < 100000", 5.0),
        check_sql("progress_rate", "range", "progress_rate < 0 OR progress_rate > 100", 5.0),
    )
)
PROJECT_CHECKS = {
    "table": "projects_master",
    "not_null": ["project_id", "pm_name"],
    "ranges": {"target_cost_rate": (50, 88), "contract_amount_kpy": (100000, None), "progress_rate": (0, 100)},
    "max_out_pct": 5.0,
}
CHECKED = ("project_id", "pm_name", "target_cost_rate", "contract_amount_kpy", "progress_rate")


@query(QUALITY, "projects")
def project_quality_report(spark: SparkSession, sf: str) -> DataFrame:
    return quality_report(src.projects(spark, sf, CHECKED), **PROJECT_CHECKS)


@query(QUALITY, "projects")
def quality_of_written_projects(spark: SparkSession, sf: str) -> DataFrame:
    """The same report taken on the pass that writes the project mart."""
    path = scratch_path(spark, "checked-projects")
    return write_checked(src.projects(spark, sf, CHECKED), lambda df: write_table(df, path), **PROJECT_CHECKS)


# --- views kept up to date --------------------------------------------------


def corrected_batches(spark: SparkSession, sf: str) -> list[tuple[DataFrame, DataFrame]]:
    """Receipts and costs in three batches of changes; the first holds wrong amounts that the last takes back."""
    cash, costs = src.cash_in(spark, sf), src.cost_records(spark, sf)
    first, wrong = F.col("project_id") % 3 != 2, F.col("project_id") % 7 == 0
    entered = costs.filter(first).withColumn("amount_kpy", F.when(wrong, F.col("amount_kpy") * 2).otherwise(F.col("amount_kpy")))
    mistaken = costs.filter(first & wrong)
    early = cash.withColumn("deposit_month", F.when(first & wrong, "1990-01").otherwise(F.col("deposit_month")))
    return [
        (marts.changes(early.filter(first)), marts.changes(entered)),
        (marts.changes(cash.filter(~first)), marts.changes(costs.filter(~first))),
        (
            marts.changes(cash.filter(first & wrong), early.filter(first & wrong)),
            marts.changes(mistaken, mistaken.withColumn("amount_kpy", F.col("amount_kpy") * 2)),
        ),
    ]


@query("SELECT * FROM cashflow", "cashflow")
def cashflow_from_mart(spark: SparkSession, sf: str) -> DataFrame:
    """The cash-flow view from monthly sums that three batches of changes were merged into."""
    mart = marts.CashMart(spark, scratch_path(spark, "cash-mart"))
    for batch, (cash, costs) in enumerate(corrected_batches(spark, sf)):
        mart.apply(cash, costs, batch)
    return mart.cashflow()


@query("SELECT * FROM cost_summary", "cost_summary")
def cost_summary_from_mart(spark: SparkSession, sf: str) -> DataFrame:
    """The project cost summary from totals that three batches of changes were merged into."""
    mart = marts.CostMart(spark, scratch_path(spark, "cost-mart"), buckets=8)
    for batch, (_, costs) in enumerate(corrected_batches(spark, sf)):
        mart.apply(costs, batch)
    return mart.summary(src.projects(spark, sf))


# --- documents -------------------------------------------------------------

KPI_MONTH = "1997-06"
KPI_DAY = f"DATE '{KPI_MONTH}-01'"
EXCESS = {
    name: f"{cost} - contract_amount_kpy * target_cost_rate / 100 * {share}::DOUBLE"
    for name, cost, share in (
        ("外注費", "outsourcing_cost_kpy", 0.45), ("材料費", "material_cost_kpy", 0.25), ("労務費", "labor_cost_kpy", 0.2), ("経費", "expense_cost_kpy", 0.1),
    )
}
ISSUE = (
    f"CASE greatest({', '.join(EXCESS.values())}, 0) WHEN 0 THEN '' "
    + " ".join(f"WHEN {excess} THEN '{name}の予算超過'" for name, excess in EXCESS.items())
    + " END"
)
KPI = (
    BUSINESS
    + f""",
kpi AS (SELECT '{KPI_MONTH}' AS report_month, '{{"report_month":"{KPI_MONTH}","company_summary":{{"total_revenue":' || total_sales || ',"target_achievement_rate":' || round(CAST(total_sales AS DOUBLE) / forecast_sales * 100, 1)
  || '}},"revenue_by_bu":{{"建設事業":' || c || ',"不動産事業":' || r || ',"SaaS事業":' || s || ',"施設運営":' || f
  || '}},"cost_risk_summary":{{"high_risk_projects_count":' || n || ',"total_risk_amount":' || amount || '}},"notable_projects":[' || worst
  || '],"current_balance":' || balance || ',"next_months_forecast":[' || coming || '],"negative_months":' || negative || ',"warning":"' || COALESCE(warning, '')
  || '","saas_metrics":{{"mrr":' || mrr || ',"arr":' || mrr * 12 || ',"churn_rate_percent":' || churn || ',"new_acquisitions":' || fresh
  || '}},"facility_operations":{{"visitors_last_month":' || visitors || ',"revenue_last_month":' || revenue || '}},"occupancy_rate_percent":' || occupancy || '}}' AS kpi_json
FROM (SELECT total_sales, forecast_sales FROM dashboard WHERE sales_month = {KPI_DAY}),
  (SELECT sum(CASE business WHEN '建設事業' THEN sales_kpy ELSE 0 END) AS c, sum(CASE business WHEN '不動産事業' THEN sales_kpy ELSE 0 END) AS r,
    sum(CASE business WHEN 'SaaS事業' THEN sales_kpy ELSE 0 END) AS s, sum(CASE business WHEN '施設運営' THEN sales_kpy ELSE 0 END) AS f FROM business WHERE month = {KPI_DAY}),
  (SELECT count(*) AS n, sum(CAST(round(total_cost_kpy - contract_amount_kpy * target_cost_rate / 100) AS BIGINT)) AS amount FROM cost_summary WHERE risk_level = '緊急'),
  (SELECT string_agg('{{"name":"' || project_name || '","cost_rate":' || effective_cost_rate || ',"gap":' || cost_rate_gap || ',"issue":"' || issue || '"}}', ',' ORDER BY cost_rate_gap DESC, project_id) AS worst
    FROM (SELECT *, {ISSUE} AS issue FROM cost_summary ORDER BY cost_rate_gap DESC NULLS LAST, project_id LIMIT 3)),
  (SELECT ending_balance_kpy AS balance FROM cashflow WHERE cf_date = {KPI_DAY}),
  (SELECT string_agg('{{"month":"' || month_str || '","net_cashflow":' || net_cashflow_kpy || '}}', ',' ORDER BY cf_date) AS coming, count(CASE WHEN net_cashflow_kpy < 0 THEN 1 END) AS negative,
      string_agg(CASE WHEN net_cashflow_kpy < 0 THEN strftime(cf_date, '%Y年%m月') END, '、' ORDER BY cf_date) || 'は単月赤字の見込み' AS warning
    FROM cashflow WHERE cf_date > {KPI_DAY} AND cf_date <= {KPI_DAY} + INTERVAL 3 MONTH),
  (SELECT sum(mrr_kpy) AS mrr, round(avg(churn_rate_pct), 2) AS churn, sum(new_customers) AS fresh FROM saas WHERE month = '{KPI_MONTH}'),
  (SELECT sum(visitors) AS visitors, sum(revenue_kpy) AS revenue FROM facilities WHERE month = '{KPI_MONTH}'),
  (SELECT round(avg(occupancy_rate), 1) AS occupancy FROM properties WHERE monthly_rental_income_kpy > 0))"""
)
KPI_USES = "dashboard cost_summary cashflow properties facilities saas cash_in"


def kpi(spark: SparkSession, sf: str) -> DataFrame:
    # The monthly results are small and read for several blocks.
    return documents.kpi_document(
        KPI_MONTH,
        v.dashboard(spark, sf),
        business(spark, sf),
        v.cost_summary(spark, sf),
        settle(v.cashflow(spark, sf)),
        src.saas(spark, sf),
        src.facilities(spark, sf),
        src.properties(spark, sf),
    )


@query("SELECT * FROM kpi", KPI_USES, KPI)
def kpi_document(spark: SparkSession, sf: str) -> DataFrame:
    return kpi(spark, sf)


PROMPTS = """prompts AS (SELECT report_type, '{system}' || chr(10) || chr(10) || '【KPIデータ】' || chr(10) || kpi_json || chr(10) || chr(10) ||
  CASE report_type {cases} ELSE '' END AS prompt FROM kpi, (SELECT unnest(['weekly_summary', 'risk_alert', 'area_roi', 'other']) AS report_type))""".format(
    system=documents.SYSTEM_INSTRUCTION,
    cases=" ".join(f"WHEN '{k}' THEN '【指示】' || chr(10) || '{t}'" for k, t in documents.INSTRUCTIONS.items()),
)


def prompts(spark: SparkSession, sf: str) -> DataFrame:
    kinds = F.array(*[F.lit(k) for k in ("weekly_summary", "risk_alert", "area_roi", "other")])
    typed = kpi(spark, sf).select("*", F.explode(kinds).alias("report_type"))
    return documents.report_prompts(typed, "report_type")


@query("SELECT * FROM prompts", KPI_USES, KPI + ",\n" + PROMPTS)
def report_prompts(spark: SparkSession, sf: str) -> DataFrame:
    return prompts(spark, sf).select("report_type", "prompt")


BODY = """'# ' || report_type || ' ' || report_month || '\\n\\n- 売上: ' || (kpi_json ->> '$.company_summary.total_revenue') || ' 千円 (達成率 ' || (kpi_json ->> '$.company_summary.target_achievement_rate')
  || '%)\\n- 高リスク工事: ' || (kpi_json ->> '$.cost_risk_summary.high_risk_projects_count') || ' 件\\n- 資金残高: ' || (kpi_json ->> '$.current_balance')
  || ' 千円\\n- 資金見通し: ' || CASE WHEN (kpi_json ->> '$.warning') = '' THEN '赤字の月はありません' ELSE kpi_json ->> '$.warning' END || '\\n- 稼働率: ' || (kpi_json ->> '$.occupancy_rate_percent') || '%'"""


@query(
    """SELECT '{"to":"executives@example.com","subject":"' || report_type || ' 1997-06","body_markdown":"' || """
    + BODY
    + """ || '","channel":"#reports","urgency":"normal"}' AS payload FROM kpi, (SELECT unnest(['weekly_summary', 'risk_alert', 'area_roi', 'other']) AS report_type)""",
    KPI_USES,
    KPI,
)
def delivery_payloads(spark: SparkSession, sf: str) -> DataFrame:
    """Payload rows; the body is the report made of the figures themselves."""
    return documents.delivery_payloads(
        prompts(spark, sf),
        to="executives@example.com",
        channel="#reports",
        subject=F.concat_ws(" ", "report_type", "report_month"),
        body=documents.report_body("report_type"),
    )
