"""Exploratory tables, expressions and source checks over the stand-in tables."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from catalog.definitions import RATE, div
from catalog.registry import query
from catalog.views import cost_summary
from girder import schemas
from girder.functions import exprs as x
from girder.operators import summaries, timeline
from girder.plans import explore
from girder.session import scratch_path
from girder.sources import sinks, tables
from girder.sources import standins as src

# --- sources and sinks -----------------------------------------------------


@query(
    " UNION ALL ".join(
        f"SELECT '{name}' AS table_name, count(*) AS row_count, {cols} AS column_count FROM {cte}"
        for name, cte, cols in (
            ("projects_master", "projects", 11),
            ("cost_records", "costs", 7),
            ("cash_in_schedules", "cash_in", 9),
            ("real_estate_properties", "properties", 9),
            ("facility_operations", "facilities", 7),
            ("saas_metrics", "saas", 7),
            ("area_indicators", "areas", 7),
        )
    ),
    "projects costs cash_in properties facilities saas areas",
)
def table_profile(spark: SparkSession, sf: str) -> DataFrame:
    return tables.table_profile(src.all_tables(spark, sf))


@query(
    """SELECT CAST(project_id AS VARCHAR) AS project_id, project_name, division, client_type, contract_amount_kpy, start_date,
  end_date, target_cost_rate, progress_rate, status, pm_name FROM projects""",
    "projects",
)
def csv_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    """Projects written as CSV with a byte-order mark and read back under the fixed schema."""
    path = scratch_path(spark, "projects-csv")
    sinks.write_csv(src.projects(spark, sf), path, byte_order_mark=True)
    dates = ("start_date", "end_date")
    as_text = T.StructType([T.StructField(f.name, T.StringType()) if f.name in dates else f for f in schemas.PROJECTS])
    return x.parse_dates(tables.read_csv(spark, path, as_text), dates)


@query(
    "SELECT DATE '2000-01-01' AS as_of, project_id, total_cost FROM project_costs",
    "project_costs",
)
def dated_write_back(spark: SparkSession, sf: str) -> DataFrame:
    """Project costs written to a mart partitioned by day and read back with that day."""
    path = scratch_path(spark, "costs-by-day")
    costs = src.cost_records(spark, sf, ("project_id", "amount_kpy"))
    totals = costs.groupBy("project_id").agg(F.sum("amount_kpy").alias("total_cost"))
    sinks.write_table(totals.withColumn("as_of", F.lit("2000-01-01").cast("date")), path, ["as_of"])
    return spark.read.parquet(path).filter(F.col("as_of") == F.lit("2000-01-01").cast("date"))


@query(
    """SELECT division, risk_level, count(*) AS project_count, CAST(sum(gross_profit) AS BIGINT) AS gross_profit
FROM cost_summary GROUP BY ALL""",
    "cost_summary",
)
def registered_view_sql(spark: SparkSession, sf: str) -> DataFrame:
    """SQL over a view registered by name."""
    tables.register_views({"project_cost_summary": cost_summary(spark, sf)})
    return spark.sql(
        """SELECT division, risk_level, count(*) AS project_count, sum(gross_profit) AS gross_profit
        FROM vw_project_cost_summary GROUP BY division, risk_level"""
    )


@query(
    """SELECT '{"project_id":' || project_id || ',"total_cost":' || total_cost || ',"record_count":' || record_count || '}' AS payload
FROM project_costs""",
    "project_costs",
)
def payload_rows(spark: SparkSession, sf: str) -> DataFrame:
    costs = src.cost_records(spark, sf, ("project_id", "amount_kpy"))
    totals = costs.groupBy("project_id").agg(F.sum("amount_kpy").alias("total_cost"), F.count("*").alias("record_count"))
    return sinks.to_payload(totals)


# --- expressions -----------------------------------------------------------


@query(
    f"""SELECT project_id, date_trunc('month', start_date)::DATE AS start_month, strftime(end_date, '%Y-%m') AS end_month,
  CAST((year(end_date) - year(start_date)) * 12 + month(end_date) - month(start_date) AS BIGINT) AS months,
  (end_date - start_date) / 30.44::DOUBLE AS average_months,
  {div('total_cost', 'contract_amount_kpy')} AS cost_ratio,
  CAST(COALESCE(total_cost, 0) AS DOUBLE) / CASE WHEN contract_amount_kpy * progress_rate / 100 > 0 THEN contract_amount_kpy * progress_rate / 100 ELSE 1 END AS earned_ratio,
  CAST(round(contract_amount_kpy / 7) AS BIGINT) AS seventh,
  round({div('total_cost', 'contract_amount_kpy')} * 100, 1) AS cost_pct,
  CASE WHEN total_cost IS NOT NULL THEN greatest(0.0::DOUBLE, least({div('total_cost', 'contract_amount_kpy')} - 0.8::DOUBLE, 0.2::DOUBLE)) * 5 END AS clipped,
  COALESCE({div('total_cost', 'progress_rate')}, 0) AS finite_ratio,
  CAST(contract_amount_kpy AS DOUBLE) / 1000 AS contract_million, substring(project_name, 1, 15) AS short_name,
  CAST({RATE} > target_cost_rate AS INTEGER) AS is_over,
  CAST(year(start_date) - CASE WHEN month(start_date) < 4 THEN 1 ELSE 0 END AS INTEGER) AS fiscal_year
FROM projects LEFT JOIN project_costs USING (project_id) WHERE status <> '未着工'""",
    "projects project_costs",
)
def project_expressions(spark: SparkSession, sf: str) -> DataFrame:
    """Date, ratio, rounding, clipping and label expressions side by side."""
    costs = src.cost_records(spark, sf, ("project_id", "amount_kpy"))
    totals = costs.groupBy("project_id").agg(F.sum("amount_kpy").alias("total_cost"))
    ratio = x.safe_div("total_cost", "contract_amount_kpy")
    earned = F.col("contract_amount_kpy") * F.col("progress_rate") / 100
    infinite = F.col("total_cost") / F.when(F.col("progress_rate") > 0, F.col("progress_rate"))
    rate = x.safe_div(x.zero("total_cost"), "contract_amount_kpy") * 100
    return (
        src.projects(spark, sf)
        .filter(F.col("status") != "未着工")
        .join(totals, "project_id", "left")
        .select(
            "project_id",
            x.first_of_month("start_date").alias("start_month"),
            x.month_key("end_date").alias("end_month"),
            x.month_diff("end_date", "start_date").alias("months"),
            x.month_span("end_date", "start_date").alias("average_months"),
            ratio.alias("cost_ratio"),
            x.div_or_one(x.zero("total_cost"), earned).alias("earned_ratio"),
            x.to_int(F.col("contract_amount_kpy") / 7).alias("seventh"),
            x.pct("total_cost", "contract_amount_kpy").alias("cost_pct"),
            x.clip_scale(ratio - 0.8, 0.0, 0.2, 5).alias("clipped"),
            x.finite_or_zero(infinite).alias("finite_ratio"),
            x.thousand_to_million("contract_amount_kpy").alias("contract_million"),
            F.substring("project_name", 1, 15).alias("short_name"),
            (rate > F.col("target_cost_rate")).cast("int").alias("is_over"),
            x.fiscal_year("start_date").alias("fiscal_year"),
        )
    )


@query(
    """SELECT area_name, step, CAST(max_month + to_months(step) AS DATE) AS month
FROM (SELECT area_name, max(CAST(month || '-01' AS DATE)) AS max_month FROM areas GROUP BY 1),
  (SELECT CAST(unnest(range(1, 7)) AS INTEGER) AS step)""",
    "areas",
)
def future_month_axis(spark: SparkSession, sf: str) -> DataFrame:
    months = src.areas(spark, sf).select("area_name", x.month_start("month").alias("month"))
    return timeline.future_months(months, 6, by=["area_name"])


@query(
    """SELECT project_id, CAST(contract_amount_kpy AS DOUBLE) / (SELECT max(contract_amount_kpy) FROM projects) * 300 AS bubble_size
FROM projects""",
    "projects",
)
def bubble_sizes(spark: SparkSession, sf: str) -> DataFrame:
    projects = src.projects(spark, sf, ("project_id", "contract_amount_kpy"))
    return summaries.relative_size(projects, "contract_amount_kpy").select("project_id", "bubble_size")


@query(
    """SELECT m.area_name, m.month, count(p.project_id) AS active_project_count
FROM (SELECT DISTINCT area_name, CAST(month || '-01' AS DATE) AS month FROM areas) m
LEFT JOIN projects p ON p.area_name = m.area_name AND p.start_date <= m.month AND p.end_date >= m.month GROUP BY ALL""",
    "areas projects",
)
def active_projects_by_area(spark: SparkSession, sf: str) -> DataFrame:
    months = src.areas(spark, sf).select("area_name", x.month_start("month").alias("month"))
    projects = src.projects(spark, sf, ("area_name", "start_date", "end_date"))
    return timeline.active_projects(projects, months, by=["area_name"])


# --- portfolio -------------------------------------------------------------


@query(
    """SELECT division, count(CASE WHEN client_type = '官公庁' THEN 1 END) AS "官公庁",
  count(CASE WHEN client_type = '民間' THEN 1 END) AS "民間" FROM projects GROUP BY 1""",
    "projects",
)
def portfolio_counts(spark: SparkSession, sf: str) -> DataFrame:
    return explore.portfolio_counts(src.projects(spark, sf, ("division", "client_type")))


def histogram_sql(value: str, bins: int) -> str:
    return f"""SELECT division, bin, round(lo + (bin - 1) * width, 6) AS bin_from, round(lo + bin * width, 6) AS bin_to, count(*) AS row_count
FROM (SELECT division, lo, (hi - lo) / {bins} AS width,
    CAST(least(floor((v - lo) / NULLIF(hi - lo, 0) * {bins}) + 1, {bins}) AS INTEGER) AS bin
  FROM (SELECT division, {value} AS v, min({value}) OVER (PARTITION BY division) AS lo, max({value}) OVER (PARTITION BY division) AS hi FROM projects))
GROUP BY division, bin, lo, width"""


@query(histogram_sql("contract_amount_kpy / 1000", 15), "projects")
def contract_histogram(spark: SparkSession, sf: str) -> DataFrame:
    bins = explore.contract_histogram(src.projects(spark, sf, ("division", "contract_amount_kpy")))
    return bins.withColumns({c: F.round(c, 6) for c in ("bin_from", "bin_to")})


@query(histogram_sql("target_cost_rate", 10), "projects")
def target_rate_histogram(spark: SparkSession, sf: str) -> DataFrame:
    bins = explore.target_rate_histogram(src.projects(spark, sf, ("division", "target_cost_rate")))
    return bins.withColumns({c: F.round(c, 6) for c in ("bin_from", "bin_to")})


@query(
    """SELECT status, count(*) AS project_count, CAST(count(*) AS DOUBLE) / (SELECT count(*) FROM projects) * 100 AS share_pct
FROM projects GROUP BY 1""",
    "projects",
)
def status_shares(spark: SparkSession, sf: str) -> DataFrame:
    return explore.status_shares(src.projects(spark, sf, ("status",)))


def cost_shares_sql(key: str) -> str:
    return f"""SELECT {key}, CAST(sum(amount_kpy) AS BIGINT) AS amount_kpy,
  CAST(sum(amount_kpy) AS DOUBLE) / (SELECT sum(amount_kpy) FROM costs) * 100 AS share_pct,
  CAST(sum(amount_kpy) AS DOUBLE) / 1000 AS amount_million FROM costs GROUP BY 1"""


@query(cost_shares_sql("category"), "costs")
def category_shares(spark: SparkSession, sf: str) -> DataFrame:
    return explore.cost_shares(src.cost_records(spark, sf, ("category", "amount_kpy")), "category")


@query(cost_shares_sql("status"), "costs")
def cost_status_shares(spark: SparkSession, sf: str) -> DataFrame:
    return explore.cost_shares(src.cost_records(spark, sf, ("status", "amount_kpy")), "status")


@query(
    "SELECT division, "
    + ", ".join(
        f"CAST(COALESCE(sum(CASE WHEN category = '{c}' THEN amount_kpy END), 0) AS DOUBLE) / 1000 AS \"{c}\""
        for c in explore.CATEGORIES
    )
    + " FROM costs JOIN projects USING (project_id) GROUP BY 1",
    "costs projects",
)
def division_costs(spark: SparkSession, sf: str) -> DataFrame:
    return explore.division_costs(
        src.projects(spark, sf, ("project_id", "division")),
        src.cost_records(spark, sf, ("project_id", "category", "amount_kpy")),
    )


LOSS_RISK = f"""loss_risk AS (SELECT project_id, project_name, target_cost_rate, COALESCE(total_cost, 0) AS total_cost, confirmed_cost,
  record_count, {RATE} AS effective_cost_rate, {RATE} - target_cost_rate AS cost_rate_gap,
  CASE WHEN {RATE} - target_cost_rate >= 5 THEN '緊急' WHEN {RATE} - target_cost_rate >= 0 THEN '警告' ELSE '正常' END AS zone,
  CAST(contract_amount_kpy AS DOUBLE) / (SELECT max(contract_amount_kpy) FROM projects) * 300 AS bubble_size
FROM projects LEFT JOIN project_costs USING (project_id))"""


def risk_inputs(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    projects = src.projects(spark, sf, ("project_id", "project_name", "contract_amount_kpy", "target_cost_rate"))
    return projects, src.cost_records(spark, sf, ("project_id", "amount_kpy", "status"))


@query("SELECT * FROM loss_risk", "projects project_costs", LOSS_RISK)
def loss_risk(spark: SparkSession, sf: str) -> DataFrame:
    return explore.loss_risk(*risk_inputs(spark, sf), contracts=src.projects(spark, sf, ("contract_amount_kpy",)))


@query(
    """SELECT project_id, substring(project_name, 1, 15) AS label, cost_rate_gap, zone FROM loss_risk
WHERE cost_rate_gap IS NOT NULL ORDER BY cost_rate_gap DESC, project_id LIMIT 10""",
    "projects project_costs",
    LOSS_RISK,
)
def top_loss_risk(spark: SparkSession, sf: str) -> DataFrame:
    return explore.top_loss_risk(*risk_inputs(spark, sf), contracts=src.projects(spark, sf, ("contract_amount_kpy",)))


CROSS = """cross_months AS (
  SELECT * FROM (SELECT month, CAST(sum(visitors) AS BIGINT) AS total_visitors, CAST(sum(revenue_kpy) AS BIGINT) AS total_facility_revenue FROM facilities GROUP BY 1)
  JOIN (SELECT month, avg(land_price_index) AS avg_land_price, avg(foot_traffic) AS avg_foot_traffic, CAST(sum(population) AS BIGINT) AS total_population FROM areas GROUP BY 1) USING (month)
  LEFT JOIN (SELECT month, CAST(sum(mrr_kpy) AS BIGINT) AS total_mrr, CAST(sum(customers) AS BIGINT) AS total_customers FROM saas GROUP BY 1) USING (month))"""


@query(
    "SELECT * REPLACE (round(avg_land_price, 6) AS avg_land_price, round(avg_foot_traffic, 6) AS avg_foot_traffic) FROM cross_months",
    "facilities areas saas",
    CROSS,
)
def cross_business_months(spark: SparkSession, sf: str) -> DataFrame:
    months = explore.cross_business_months(src.facilities(spark, sf), src.areas(spark, sf), src.saas(spark, sf))
    return months.withColumns({c: F.round(c, 6) for c in ("avg_land_price", "avg_foot_traffic")})


@query(
    " UNION ALL ".join(
        f"SELECT '{a}' AS measure_a, '{b}' AS measure_b, "
        + ("max(1.0::DOUBLE)" if a == b else f"round(corr({a}, {b}), 6)")
        + " AS correlation FROM cross_months"
        for a in explore.CROSS_MEASURES
        for b in explore.CROSS_MEASURES
    ),
    "facilities areas saas",
    CROSS,
)
def cross_business_correlation(spark: SparkSession, sf: str) -> DataFrame:
    pairs = explore.cross_business_correlation(src.facilities(spark, sf), src.areas(spark, sf), src.saas(spark, sf))
    return pairs.withColumn("correlation", F.round("correlation", 6))


# --- month and category sums -----------------------------------------------


@query(
    """SELECT payment_due_month, category, CAST(sum(amount_kpy) AS BIGINT) AS amount_kpy FROM costs GROUP BY ALL""",
    "costs",
)
def monthly_category_costs(spark: SparkSession, sf: str) -> DataFrame:
    costs = src.cost_records(spark, sf, ("payment_due_month", "category", "amount_kpy"))
    return costs.groupBy("payment_due_month", "category").agg(F.sum("amount_kpy").alias("amount_kpy"))


@query(
    """SELECT division, count(*) AS project_count, count(DISTINCT pm_name) AS manager_count,
  count(CASE WHEN status = '完了' THEN 1 END) AS finished_count, round(avg(progress_rate), 6) AS progress_rate
FROM projects GROUP BY 1""",
    "projects",
)
def division_counts(spark: SparkSession, sf: str) -> DataFrame:
    return (
        src.projects(spark, sf, ("division", "pm_name", "status", "progress_rate"))
        .groupBy("division")
        .agg(
            F.count("*").alias("project_count"),
            F.countDistinct("pm_name").alias("manager_count"),
            x.count_where(F.col("status") == "完了").alias("finished_count"),
            F.round(F.avg("progress_rate"), 6).alias("progress_rate"),
        )
    )
