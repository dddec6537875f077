"""Monthly cash frame, features and rule-based alerts over the stand-in tables."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from catalog.registry import query
from girder.functions.exprs import month_start
from girder.operators import schedule, summaries, timeline
from girder.plans import cash
from girder.plans import views as plans
from girder.plans.operations import cash_horizon, compare_scenarios
from girder.session import settle
from girder.sources import standins as src


def cash_frame(spark: SparkSession, sf: str) -> DataFrame:
    return cash.monthly_cash(
        src.cash_in(spark, sf), src.cost_records(spark, sf, ("payment_due_month", "category", "amount_kpy"))
    )


CASH = """cash_parts AS (SELECT CAST(payment_due_month || '-01' AS DATE) AS month, category, CAST(sum(amount_kpy) AS BIGINT) AS part FROM costs GROUP BY ALL),
cash_frame AS (
  SELECT month, COALESCE(inflow, 0) AS inflow, COALESCE(outflow, 0) AS outflow, COALESCE(inflow, 0) - COALESCE(outflow, 0) AS net_cashflow,
    CAST(sum(COALESCE(inflow, 0) - COALESCE(outflow, 0)) OVER (ORDER BY month) AS BIGINT) AS cumulative_cashflow, round(hhi, 8) AS hhi
  FROM (SELECT CAST(deposit_month || '-01' AS DATE) AS month, CAST(sum(expected_amount_kpy) AS BIGINT) AS inflow FROM cash_in GROUP BY 1)
  FULL OUTER JOIN (SELECT month, CAST(sum(part) AS BIGINT) AS outflow,
    CASE WHEN sum(part) > 0 THEN sum(CAST(part AS DOUBLE) * CAST(part AS DOUBLE)) / (CAST(sum(part) AS DOUBLE) * CAST(sum(part) AS DOUBLE)) ELSE 0 END AS hhi
    FROM cash_parts GROUP BY 1) USING (month))"""

FEATURES = (
    CASH
    + """,
cash_features AS (
  SELECT month, inflow, outflow, net_cashflow, cumulative_cashflow, COALESCE(hhi, 0) AS hhi,
    CAST(inflow AS DOUBLE) / CASE WHEN outflow = 0 THEN 1 ELSE outflow END AS inflow_outflow_ratio,
    COALESCE(net_cashflow - lag(net_cashflow) OVER w, 0) AS mom_change,
    CAST(sum(net_cashflow) OVER r AS DOUBLE) / count(*) OVER r AS rolling_3m_avg,
    net_cashflow - CAST(sum(net_cashflow) OVER r AS DOUBLE) / count(*) OVER r AS diff_from_3m_avg
  FROM cash_frame WINDOW w AS (ORDER BY month), r AS (ORDER BY month ROWS BETWEEN 2 PRECEDING AND CURRENT ROW))"""
)

# The check of the alert rows flags months by a plain z-score in place of a fitted model.
SCORED = (
    FEATURES
    + """,
scored AS (SELECT *, round(-abs(net_cashflow - (SELECT avg(net_cashflow) FROM cash_features)) / (SELECT stddev_pop(net_cashflow) FROM cash_features), 6) AS anomaly_score,
  abs(net_cashflow - (SELECT avg(net_cashflow) FROM cash_features)) / (SELECT stddev_pop(net_cashflow) FROM cash_features) > 1.5::DOUBLE AS is_anomaly FROM cash_features)"""
)


def hhi8(df: DataFrame) -> DataFrame:
    return df.withColumn("hhi", F.round("hhi", 8))


@query("SELECT * FROM cash_frame", "cash_in costs", CASH)
def monthly_cash(spark: SparkSession, sf: str) -> DataFrame:
    return hhi8(cash_frame(spark, sf))


@query("SELECT * FROM cash_features", "cash_in costs", FEATURES)
def cash_features(spark: SparkSession, sf: str) -> DataFrame:
    return hhi8(cash.cash_features(cash_frame(spark, sf)))


@query("SELECT * FROM cash_frame WHERE cumulative_cashflow < 0", "cash_in costs", CASH)
def danger_months(spark: SparkSession, sf: str) -> DataFrame:
    return hhi8(cash.danger_months(cash_frame(spark, sf)))


@query(
    """SELECT f.month, CAST(COALESCE(sum(CASE WHEN category = '外注費' THEN part END), 0) AS BIGINT) AS "外注費",
  CAST(COALESCE(sum(CASE WHEN category = '材料費' THEN part END), 0) AS BIGINT) AS "材料費",
  CAST(COALESCE(sum(CASE WHEN category = '労務費' THEN part END), 0) AS BIGINT) AS "労務費",
  CAST(COALESCE(sum(CASE WHEN category = '経費' THEN part END), 0) AS BIGINT) AS "経費"
FROM cash_frame f LEFT JOIN cash_parts p ON f.month = p.month GROUP BY 1""",
    "cash_in costs",
    CASH,
)
def outflow_by_category(spark: SparkSession, sf: str) -> DataFrame:
    costs = src.cost_records(spark, sf, ("payment_due_month", "category", "amount_kpy"))
    return cash.outflow_by_category(cash_frame(spark, sf), costs)


def z_scored(spark: SparkSession, sf: str) -> DataFrame:
    features = settle(cash.cash_features(cash_frame(spark, sf)))
    z = F.abs("net_cashflow_z")
    return (
        summaries.standardize(features, ["net_cashflow"])
        .withColumn("anomaly_score", F.round(-z, 6))
        .withColumn("is_anomaly", z > 1.5)
    )


@query(
    """SELECT 'WARNING' AS level, '異常値検知' AS type, strftime(month, '%Y-%m') AS month,
  '通常と異なるキャッシュフロー変動を検知しました。入出金バランス(Net: ' || format('{:,}', net_cashflow) || '千円)の確認を推奨します。' AS message,
  '{"inflow":' || inflow || ',"outflow":' || outflow || ',"anomaly_score":' || round(anomaly_score, 3) || '}' AS details FROM scored WHERE is_anomaly
UNION ALL SELECT 'CRITICAL', '資金ショート警戒', strftime(month, '%Y-%m'),
  '累計キャッシュフローが警戒ライン(-50,000千円)を下回っています！至急、資金調達または支払延期の調整が必要です。',
  '{"cumulative_cashflow":' || cumulative_cashflow || '}' FROM scored WHERE cumulative_cashflow < -50000""",
    "cash_in costs",
    SCORED,
)
def cash_rule_alerts(spark: SparkSession, sf: str) -> DataFrame:
    """Alert rows when a month is flagged by its distance from the mean."""
    return cash.cash_alerts(z_scored(spark, sf))


@query(
    """SELECT month, CAST(inflow AS DOUBLE) AS inflow, CAST(outflow AS DOUBLE) AS outflow, CAST(net_cashflow AS DOUBLE) AS net_cashflow,
  CAST(mom_change AS DOUBLE) AS mom_change, round(anomaly_score, 2) AS anomaly_score FROM scored WHERE is_anomaly""",
    "cash_in costs",
    SCORED,
)
def flagged_month_details(spark: SparkSession, sf: str) -> DataFrame:
    return cash.anomaly_details(z_scored(spark, sf))


@query(
    """SELECT month, round((net_cashflow - (SELECT avg(net_cashflow) FROM cash_features)) / (SELECT stddev_pop(net_cashflow) FROM cash_features), 6) AS net_cashflow_z,
  round((mom_change - (SELECT avg(mom_change) FROM cash_features)) / (SELECT stddev_pop(mom_change) FROM cash_features), 6) AS mom_change_z FROM cash_features""",
    "cash_in costs",
    FEATURES,
)
def standardized_cash(spark: SparkSession, sf: str) -> DataFrame:
    features = settle(cash.cash_features(cash_frame(spark, sf)))
    z = summaries.standardize(features, ["net_cashflow", "mom_change"])
    return z.select("month", *[F.round(c, 6).alias(c) for c in ("net_cashflow_z", "mom_change_z")])


@query("SELECT * FROM receipts", "receipts")
def milestone_receipts(spark: SparkSession, sf: str) -> DataFrame:
    """Receipt schedule derived from the contracts."""
    return schedule.expand_milestones(
        src.projects(spark, sf, ("project_id", "contract_amount_kpy", "start_date", "end_date"))
    )


@query(
    """SELECT month, sum(amount) OVER (ORDER BY month)::BIGINT AS running_cost, amount FROM (
  SELECT m.month, CAST(COALESCE(amount, 0) AS BIGINT) AS amount
  FROM (SELECT CAST(unnest(range(min(d), max(d) + INTERVAL 1 DAY, INTERVAL 1 MONTH)) AS DATE) AS month
    FROM (SELECT CAST(accrual_month || '-01' AS DATE) AS d FROM costs WHERE status = '口頭発注' AND category = '経費')) m
  LEFT JOIN (SELECT CAST(accrual_month || '-01' AS DATE) AS month, sum(amount_kpy) AS amount FROM costs
    WHERE status = '口頭発注' AND category = '経費' GROUP BY 1) USING (month))""",
    "costs",
)
def verbal_order_expenses(spark: SparkSession, sf: str) -> DataFrame:
    """Expenses ordered verbally on a gap-free month axis with their running total."""
    costs = src.cost_records(spark, sf, ("accrual_month", "status", "category", "amount_kpy"))
    monthly = (
        costs.filter((F.col("status") == "口頭発注") & (F.col("category") == "経費"))
        .groupBy(month_start("accrual_month").alias("month"))
        .agg(F.sum("amount_kpy").alias("amount"))
    )
    full = timeline.on_axis(monthly, timeline.month_axis(monthly), ["amount"])
    return full.withColumn("running_cost", timeline.running_total("amount", timeline.by_time("month")))


DELAY = """delayed AS (SELECT * REPLACE (CASE WHEN actual_amount_kpy IS NULL AND status = '遅延'
  THEN strftime(CAST(deposit_month || '-01' AS DATE) + INTERVAL 3 MONTH, '%Y-%m') ELSE deposit_month END AS deposit_month) FROM cash_in),
both_cases AS (SELECT 'plan' AS scenario, deposit_month, expected_amount_kpy FROM cash_in UNION ALL SELECT 'delayed', deposit_month, expected_amount_kpy FROM delayed),
out_months AS (SELECT payment_due_month AS month_str, CAST(sum(amount_kpy) AS BIGINT) AS o FROM costs GROUP BY 1),
case_months AS (SELECT month_str, CAST(sum(CASE WHEN scenario = 'plan' THEN a ELSE 0 END) AS BIGINT) AS plan_in, CAST(sum(CASE WHEN scenario = 'delayed' THEN a ELSE 0 END) AS BIGINT) AS delayed_in
  FROM (SELECT scenario, deposit_month AS month_str, expected_amount_kpy AS a FROM both_cases) GROUP BY 1)"""


@query(
    """SELECT month_str, COALESCE(plan_in, 0) AS planned_inflow_kpy, COALESCE(delayed_in, 0) AS delayed_inflow_kpy,
  CAST(sum(COALESCE(plan_in, 0) - COALESCE(o, 0)) OVER w AS BIGINT) AS planned_balance_kpy,
  CAST(sum(COALESCE(delayed_in, 0) - COALESCE(o, 0)) OVER w AS BIGINT) AS delayed_balance_kpy,
  CAST(sum(COALESCE(delayed_in, 0) - COALESCE(plan_in, 0)) OVER w AS BIGINT) AS balance_impact_kpy
FROM case_months FULL OUTER JOIN out_months USING (month_str) WINDOW w AS (ORDER BY month_str)""",
    "cash_in costs",
    DELAY,
)
def delayed_receipts_scenario(spark: SparkSession, sf: str) -> DataFrame:
    """Cash balance if every overdue receipt arrives three months later than planned."""
    receipts = src.cash_in(spark, sf)
    costs = src.cost_records(spark, sf, ("amount_kpy", "status", "payment_due_month"))
    return compare_scenarios(receipts, schedule.delay_receipts(receipts, 3, status="遅延"), costs)


@query(
    """SELECT * FROM cashflow WHERE cf_date >= DATE '2000-01-01' AND cf_date < DATE '2000-07-01'""",
    "cashflow",
)
def six_month_cash_plan(spark: SparkSession, sf: str) -> DataFrame:
    flow = plans.cashflow_forecast(
        src.cash_in(spark, sf), src.cost_records(spark, sf, ("amount_kpy", "status", "payment_due_month"))
    )
    return cash_horizon(flow, src.AS_OF, 6)
