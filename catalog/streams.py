"""Streams over the stand-in tables, run over the files at hand and read back."""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from catalog.registry import query
from girder.session import scratch_path
from girder.sources import standins as src
from girder.streaming import entries, sinks, snapshots


def stream(spark: SparkSession, sf: str, name: str) -> DataFrame:
    schema = src.source(spark, sf, name).schema
    return entries.read_files(spark, sf, schema, name=f"{name}.parquet")


def timed_events(spark: SparkSession, sf: str) -> DataFrame:
    """The event log with its time as an instant, which watermarks need."""
    return stream(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))


def appended(spark: SparkSession, df: DataFrame, name: str) -> DataFrame:
    path = scratch_path(spark, name)
    sinks.run_append(df, path, scratch_path(spark, f"{name}-progress"))
    written = spark.read.schema(df.schema).parquet(path)
    instants = [f.name for f in df.schema if f.dataType.typeName() == "timestamp"]
    return written.withColumns({c: F.col(c).cast("timestamp_ntz") for c in instants})


@query("SELECT event_id, ts, user_id, event_type, value FROM events")
def streamed_entries(spark: SparkSession, sf: str) -> DataFrame:
    """Entries by stream, repeats of an id dropped."""
    arriving = timed_events(spark, sf).select("event_id", "ts", "user_id", "event_type", "value")
    return appended(spark, entries.unique_entries(arriving, "event_id", "ts"), "entries")


@query(
    "SELECT project_id, category, CAST(sum(amount_kpy) AS BIGINT) AS amount_kpy, count(*) AS entries FROM costs GROUP BY ALL",
    "costs",
)
def streamed_running_costs(spark: SparkSession, sf: str) -> DataFrame:
    costs = src.costs_from_lines(
        stream(spark, sf, "lineitem"), src.source(spark, sf, "part"), ("project_id", "category", "amount_kpy")
    )
    table = snapshots.SnapshotTable(spark, scratch_path(spark, "running-costs"), ["project_id", "category"], buckets=4)
    snapshots.run_merges(entries.running_costs(costs), table, scratch_path(spark, "running-costs-progress"), keep=2)
    return table.read()


def readings(spark: SparkSession, sf: str) -> DataFrame:
    return timed_events(spark, sf).select("ts", "event_type", src.cents("value").alias("cents"))


def windows_sql(offsets: str) -> str:
    """Windows of six hours at the given start offsets that the watermark has passed."""
    return f"""SELECT window_start, window_start + INTERVAL 6 HOUR AS window_end, event_type, count(*) AS readings, CAST(sum(cents) AS BIGINT) AS total,
  min(cents) AS lowest, max(cents) AS highest
FROM (SELECT time_bucket(INTERVAL 2 HOUR, ts) - to_hours(o) AS window_start, ts, event_type, CAST(round(value * 100) AS BIGINT) AS cents
  FROM events, (SELECT unnest({offsets}) AS o))
WHERE window_start + INTERVAL 6 HOUR <= (SELECT max(ts) - INTERVAL 10 MINUTE FROM events) GROUP BY 1, 2, 3"""


@query(
    """SELECT window_start, window_start + INTERVAL 6 HOUR AS window_end, event_type, count(*) AS readings, CAST(sum(cents) AS BIGINT) AS total,
  min(cents) AS lowest, max(cents) AS highest
FROM (SELECT time_bucket(INTERVAL 6 HOUR, ts) AS window_start, event_type, CAST(round(value * 100) AS BIGINT) AS cents FROM events)
WHERE window_start + INTERVAL 6 HOUR <= (SELECT max(ts) - INTERVAL 10 MINUTE FROM events) GROUP BY 1, 2, 3"""
)
def tumbling_sensor_windows(spark: SparkSession, sf: str) -> DataFrame:
    windows = entries.sensor_windows(readings(spark, sf), "ts", "cents", "event_type", "6 hours")
    return appended(spark, windows, "tumbling")


@query(windows_sql("[0, 2, 4]"))
def sliding_sensor_windows(spark: SparkSession, sf: str) -> DataFrame:
    windows = entries.sensor_windows(readings(spark, sf), "ts", "cents", "event_type", "6 hours", "2 hours")
    return appended(spark, windows, "sliding")


@query(
    """SELECT record_id, event_id, requested, CASE WHEN p >= p3 THEN '確定' WHEN p >= p2 THEN '承認' WHEN p >= p1 THEN '現場入力' END AS state,
  COALESCE(p = p1 OR p = p2 OR p = p3, FALSE) AS is_legal
FROM third""",
    "",
    """requests AS (SELECT user_id AS record_id, event_id, CASE event_type WHEN 'signup' THEN '現場入力' WHEN 'click' THEN '承認' ELSE '確定' END AS requested,
  row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS p FROM events WHERE event_type IN ('signup', 'click', 'purchase')),
first AS (SELECT *, min(CASE WHEN requested = '現場入力' THEN p END) OVER (PARTITION BY record_id) AS p1 FROM requests),
second AS (SELECT *, min(CASE WHEN requested = '承認' AND p > p1 THEN p END) OVER (PARTITION BY record_id) AS p2 FROM first),
third AS (SELECT *, min(CASE WHEN requested = '確定' AND p > p2 THEN p END) OVER (PARTITION BY record_id) AS p3 FROM second)""",
)
def approval_states(spark: SparkSession, sf: str) -> DataFrame:
    """Approval requests of each record with the state they lead to."""
    wanted = F.when(F.col("event_type") == "signup", "現場入力").when(F.col("event_type") == "click", "承認").otherwise("確定")
    requests = (
        stream(spark, sf, "events")
        .filter(F.col("event_type").isin("signup", "click", "purchase"))
        .select(F.col("user_id").alias("record_id"), "event_id", "ts", wanted.alias("requested"))
    )
    return appended(spark, entries.approval_states(requests), "approvals")


@query(
    """SELECT project_id, total_cost_kpy, cost_rate, CASE WHEN cost_rate > target_cost_rate + 5 THEN '緊急' WHEN cost_rate > target_cost_rate THEN '警告'
  WHEN cost_rate >= target_cost_rate * 0.95::DOUBLE THEN '注意' END AS alert_level
FROM (SELECT project_id, target_cost_rate, total_cost AS total_cost_kpy, CAST(total_cost AS DOUBLE) / NULLIF(contract_amount_kpy, 0) * 100 AS cost_rate
  FROM projects JOIN project_costs USING (project_id))""",
    "projects project_costs",
)
def streamed_overrun_alerts(spark: SparkSession, sf: str) -> DataFrame:
    """Alert tier per project as its cost entries stream in."""
    projects = src.projects(spark, sf, ("project_id", "contract_amount_kpy", "target_cost_rate"))
    costs = src.costs_from_lines(
        stream(spark, sf, "lineitem"), src.source(spark, sf, "part"), ("project_id", "amount_kpy")
    )
    path = scratch_path(spark, "overruns")
    sinks.run_changes(
        entries.total_costs(costs),
        path,
        scratch_path(spark, "overruns-progress"),
        shape=lambda batch: entries.overrun_alerts(batch, projects),
    )
    return sinks.latest(spark.read.parquet(path), ["project_id"])


@query(
    """SELECT record_id, event_id, requested, CASE WHEN p >= p3 THEN '確定' WHEN p >= p2 THEN '承認' WHEN p >= p1 THEN '現場入力' END AS state,
  COALESCE(p = p1 OR p = p2 OR p = p3, FALSE) AS is_legal
FROM third WHERE epoch_ms(ts) < (SELECT max(epoch_ms(ts)) FROM requests) - 86400000""",
    "",
    """requests AS (SELECT user_id AS record_id, event_id, ts, CASE event_type WHEN 'signup' THEN '現場入力' WHEN 'click' THEN '承認' ELSE '確定' END AS requested,
  row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS p FROM events WHERE event_type IN ('signup', 'click', 'purchase')),
first AS (SELECT *, min(CASE WHEN requested = '現場入力' THEN p END) OVER (PARTITION BY record_id) AS p1 FROM requests),
second AS (SELECT *, min(CASE WHEN requested = '承認' AND p > p1 THEN p END) OVER (PARTITION BY record_id) AS p2 FROM first),
third AS (SELECT *, min(CASE WHEN requested = '確定' AND p > p2 THEN p END) OVER (PARTITION BY record_id) AS p3 FROM second)""",
)
def approval_states_by_event_time(spark: SparkSession, sf: str) -> DataFrame:
    """Approval requests in the order of their time; those of the last day still wait for late ones."""
    wanted = F.when(F.col("event_type") == "signup", "現場入力").when(F.col("event_type") == "click", "承認").otherwise("確定")
    requests = (
        timed_events(spark, sf)
        .filter(F.col("event_type").isin("signup", "click", "purchase"))
        .select(F.col("user_id").alias("record_id"), "event_id", "ts", wanted.alias("requested"))
    )
    with sinks.state_in_rocksdb(spark):
        return appended(spark, entries.approvals_in_order(requests, "1 day"), "ordered-approvals")


@query(
    """SELECT project_id, total_cost_kpy, target_cost_rate, cost_rate, CASE WHEN cost_rate > target_cost_rate + 5 THEN '緊急' WHEN cost_rate > target_cost_rate THEN '警告'
  WHEN cost_rate >= target_cost_rate * 0.95::DOUBLE THEN '注意' END AS alert_level
FROM (SELECT project_id, COALESCE(total_cost, 0) AS total_cost_kpy, CASE WHEN project_id % 3 = 0 THEN target_cost_rate - 4 ELSE target_cost_rate END AS target_cost_rate,
  CAST(COALESCE(total_cost, 0) AS DOUBLE) / NULLIF(CASE WHEN project_id % 5 = 0 THEN contract_amount_kpy * 2 ELSE contract_amount_kpy END, 0) * 100 AS cost_rate
  FROM projects LEFT JOIN project_costs USING (project_id))""",
    "projects project_costs",
)
def streamed_overruns_of_changed_projects(spark: SparkSession, sf: str) -> DataFrame:
    """Alert tier per project from a stream of costs and a stream of project versions.

    Every third project gets a lower target, every fifth a larger contract, some time after it was entered.
    """
    costs = src.costs_from_lines(stream(spark, sf, "lineitem"), src.source(spark, sf, "part"), ("project_id", "amount_kpy"))
    key, contract, entered = F.col("o_orderkey"), src.cents("o_totalprice"), F.col("o_orderdate")
    target = (82 + key % 9).cast("double")

    def version(days: int, contract_: Column, target_: Column) -> Column:
        return F.struct((entered + F.make_dt_interval(F.lit(days))).alias("changed_at"), contract_.alias("contract_amount_kpy"), target_.alias("target_cost_rate"))

    later = version(30, F.when(key % 5 == 0, contract * 2).otherwise(contract), F.when(key % 3 == 0, target - 4).otherwise(target))
    versions = stream(spark, sf, "orders").select(key.alias("project_id"), F.explode(F.array(later, version(0, contract, target))).alias("v"))
    totals = entries.overrun_totals(costs, versions.select("project_id", "v.*"))
    table = snapshots.SnapshotTable(spark, scratch_path(spark, "changed-overruns"), ["project_id"], buckets=4)
    snapshots.run_merges(totals, table, scratch_path(spark, "changed-overruns-progress"), shape=entries.rated_overruns, keep=2)
    return table.read().where("cost_rate IS NOT NULL OR target_cost_rate IS NOT NULL")
