"""The seven base tables derived from an order/line-item star schema and an event log.

Used to run every plan on generated data. The shape follows the base tables,
the meaning does not. Amounts are whole cents. Each builder reads only what the
asked columns need: a join or an aggregate that feeds none of them is left out,
because Catalyst cannot drop it by itself.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from girder.functions.exprs import month_key, safe_div
from girder.operators.schedule import expand_milestones

AS_OF = "2000-01-01"

# How source codes stand for the base tables' own terms.
AREA_OF_REGION = {"AFRICA": "三島", "AMERICA": "沼津", "ASIA": "函南", "EUROPE": "清水", "MIDDLE EAST": "長泉"}
CATEGORY_OF_TYPE = {"STANDARD": "外注費", "ECONOMY": "材料費", "PROMO": "労務費", "LARGE": "経費"}
COST_STATUS_OF_FLAG = {"A": "確定請求", "N": "現場見込み", "R": "口頭発注"}
PROJECT_STATUS_OF_CODE = {"F": "完了", "O": "進行中", "P": "未着工"}
FACILITY_OF_EVENT = {"click": "伊豆 click", "view": "三島 view", "error": "沼津 error", "signup": "未来 signup"}


def recode(col: Column, codes: dict[str, str]) -> Column:
    """Mapped value, or the value itself when it has no entry."""
    chain = F
    for code, value in codes.items():
        chain = chain.when(col == code, F.lit(value))
    return chain.otherwise(col)


def cents(col: str) -> Column:
    return F.rint(F.col(col) * 100).cast("long")


# Given schemas spare the read a job of its own to look at the files.
SCHEMAS = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey long, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "supplier": "s_suppkey long, s_name string, s_nationkey int, s_acctbal double",
    "part": "p_partkey long, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
    "orders": "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, "
    "o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, "
    "l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, "
    "l_shipdate timestamp_ntz",
    "events": "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string",
}


def source(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.schema(SCHEMAS[name]).parquet(f"{folder}/{name}.parquet")


def places(spark: SparkSession, folder: str) -> DataFrame:
    """Nation key with nation and area name."""
    nation, region = source(spark, folder, "nation"), source(spark, folder, "region")
    return nation.join(region, nation.n_regionkey == region.r_regionkey).select(
        "n_nationkey", "n_name", recode(F.col("r_name"), AREA_OF_REGION).alias("area_name")
    )


PROJECT_COLUMNS = (
    "project_id",
    "project_name",
    "division",
    "client_type",
    "contract_amount_kpy",
    "start_date",
    "end_date",
    "target_cost_rate",
    "progress_rate",
    "status",
    "pm_name",
)


def projects(spark: SparkSession, folder: str, columns: Sequence[str] = PROJECT_COLUMNS) -> DataFrame:
    """One project per order. ``area_name`` can be asked for as well."""
    df = source(spark, folder, "orders")
    named = {"project_name", "pm_name", "area_name"} & set(columns)
    if named or "client_type" in columns:
        df = df.join(source(spark, folder, "customer"), F.col("o_custkey") == F.col("c_custkey"), "left")
    if named:
        df = df.join(places(spark, folder), F.col("c_nationkey") == F.col("n_nationkey"), "left")
    key, started = F.col("o_orderkey"), F.to_date("o_orderdate")
    exprs = {
        "project_id": lambda: key,
        "project_name": lambda: F.concat_ws(" ", "area_name", "c_name"),
        "division": lambda: F.when(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH"), "土木").otherwise("建築"),
        "client_type": lambda: F.when(F.col("c_mktsegment").isin("BUILDING", "MACHINERY"), "官公庁").otherwise("民間"),
        "contract_amount_kpy": lambda: cents("o_totalprice"),
        "start_date": lambda: started,
        "end_date": lambda: F.add_months(started, (6 + key % 19).cast("int")),
        "target_cost_rate": lambda: (82 + key % 9).cast("double"),
        "progress_rate": lambda: F.when(F.col("o_orderstatus") == "F", 100.0)
        .when(F.col("o_orderstatus") == "P", (25 + key % 70).cast("double"))
        .otherwise((key % 25).cast("double")),
        "status": lambda: recode(F.col("o_orderstatus"), PROJECT_STATUS_OF_CODE),
        "pm_name": lambda: F.col("n_name"),
        "area_name": lambda: F.col("area_name"),
    }
    return df.select(*[exprs[c]().alias(c) for c in columns])


COST_COLUMNS = (
    "project_id",
    "category",
    "amount_kpy",
    "status",
    "accrual_month",
    "payment_due_month",
    "vendor_name",
)


def cost_records(spark: SparkSession, folder: str, columns: Sequence[str] = COST_COLUMNS) -> DataFrame:
    """One cost entry per line item."""
    return costs_from_lines(source(spark, folder, "lineitem"), source(spark, folder, "part"), columns)


def costs_from_lines(lines: DataFrame, part: DataFrame, columns: Sequence[str] = COST_COLUMNS) -> DataFrame:
    """Cost entries of any line-item frame, batch or stream."""
    df = lines
    if "category" in columns:
        df = df.join(part.select("p_partkey", "p_type"), F.col("l_partkey") == F.col("p_partkey"), "left")
    day = F.to_date("l_shipdate")
    exprs = {
        "project_id": lambda: F.col("l_orderkey"),
        "category": lambda: recode(F.col("p_type"), CATEGORY_OF_TYPE),
        "amount_kpy": lambda: cents("l_extendedprice"),
        "status": lambda: recode(F.col("l_returnflag"), COST_STATUS_OF_FLAG),
        "accrual_month": lambda: month_key(day),
        "payment_due_month": lambda: month_key(F.add_months(day, 1)),
        "vendor_name": lambda: F.concat(F.lit("Supplier "), F.col("l_suppkey").cast("string")),
        "input_timestamp": lambda: F.col("l_shipdate").cast("timestamp_ntz"),
        "certainty": lambda: F.when(F.col("l_linenumber") % 3 == 0, "高").when(F.col("l_linenumber") % 3 == 1, "中").otherwise("低"),
    }
    return df.select(*[exprs[c]().alias(c) for c in columns])


def cash_in(spark: SparkSession, folder: str, as_of: str = AS_OF) -> DataFrame:
    """Three receipts per project; one project in ten pays its later ones late."""
    base = projects(spark, folder, ("project_id", "contract_amount_kpy", "start_date", "end_date"))
    df = expand_milestones(base)
    key, due = F.col("project_id"), F.col("expected_date")
    past = due < F.lit(as_of).cast("date")
    slow = (key % 10 == 0) & (F.col("milestone") != "前払金")
    overdue = past & slow & (key % 20 == 0)
    paid = past & ~overdue
    paid_on = F.when(slow, F.date_add(F.add_months(due, 1), (1 + key % 15).cast("int"))).otherwise(
        F.date_add(due, (key % 11 - 5).cast("int"))
    )
    return df.select(
        F.concat_ws("-", F.col("project_id").cast("string"), "milestone").alias("schedule_id"),
        "project_id",
        "milestone",
        "expected_amount_kpy",
        F.when(paid, F.col("expected_amount_kpy")).alias("actual_amount_kpy"),
        "deposit_month",
        F.when(paid, paid_on).alias("actual_deposit_date"),
        F.when(overdue, "遅延").when(paid, "入金済").otherwise("予定").alias("status"),
        "expected_date",
    )


def properties(spark: SparkSession, folder: str) -> DataFrame:
    """One property per supplier; one in four is land without rent."""
    df = source(spark, folder, "supplier").join(
        places(spark, folder), F.col("s_nationkey") == F.col("n_nationkey")
    )
    key = F.col("s_suppkey")
    land = key % 4 == 3
    worth = F.greatest(cents("s_acctbal"), F.lit(0))
    cost = worth * 150
    return df.select(
        key.alias("property_id"),
        F.col("s_name").alias("property_name"),
        F.when(key % 4 == 0, "賃貸マンション").when(key % 4 == 1, "商業施設").when(key % 4 == 2, "オフィス")
        .otherwise("土地").alias("property_type"),
        F.concat(F.col("area_name"), F.lit("市")).alias("location"),
        F.date_add(F.lit("1985-01-01").cast("date"), (key * 37 % 3650).cast("int")).alias("acquisition_date"),
        cost.alias("acquisition_cost_kpy"),
        F.floor(cost * (9 + key % 5) / 10).cast("long").alias("current_value_kpy"),
        F.when(land, F.lit(0).cast("long")).otherwise(worth).alias("monthly_rental_income_kpy"),
        F.when(land, 0.0).otherwise((70 + key % 31).cast("double")).alias("occupancy_rate"),
    )


def _event_month(first: str) -> Column:
    """Each day of the event log stands for a month from ``first`` on."""
    return month_key(F.add_months(F.lit(first).cast("date"), F.day("ts") - 1))


def facilities(spark: SparkSession, folder: str) -> DataFrame:
    """One row per event type and event day, the day standing for a month."""
    revenue = F.sum(cents("value"))
    cost = F.lit(40000) + F.floor(F.col("revenue_kpy") / 2).cast("long")
    return (
        source(spark, folder, "events")
        .groupBy(F.col("event_type").alias("facility_id"), _event_month("1996-01-01").alias("month"))
        .agg(F.countDistinct("user_id").alias("visitors"), revenue.alias("revenue_kpy"))
        .withColumn("operating_cost_kpy", cost)
        .select(
            "facility_id",
            recode(F.col("facility_id"), FACILITY_OF_EVENT).alias("facility_name"),
            "month",
            "visitors",
            "revenue_kpy",
            "operating_cost_kpy",
            (F.col("revenue_kpy") - F.col("operating_cost_kpy")).alias("operating_profit_kpy"),
        )
    )


def saas(spark: SparkSession, folder: str) -> DataFrame:
    """Two products with one row per event day, the day standing for a month."""
    small = F.col("value") < 10
    return (
        source(spark, folder, "events")
        .filter(F.col("event_type").isin("signup", "purchase"))
        .groupBy(_event_month("1997-01-01").alias("month"), F.col("event_type").alias("product"))
        .agg(
            F.sum(cents("value")).alias("mrr_kpy"),
            F.countDistinct("user_id").alias("customers"),
            F.count(F.when(small, 1)).alias("new_customers"),
            F.sum(F.when(small, cents("value")).otherwise(0)).alias("expansion_mrr_kpy"),
        )
        .select(
            "month",
            "product",
            "mrr_kpy",
            "customers",
            (1 + F.col("customers") % 5).cast("double").alias("churn_rate_pct"),
            "new_customers",
            "expansion_mrr_kpy",
        )
    )


def areas(spark: SparkSession, folder: str) -> DataFrame:
    """One row per region and order month."""
    df = (
        source(spark, folder, "orders")
        .join(source(spark, folder, "customer"), F.col("o_custkey") == F.col("c_custkey"), "left")
        .join(places(spark, folder), F.col("c_nationkey") == F.col("n_nationkey"))
    )
    index = F.round(safe_div(F.sum(cents("o_totalprice")), F.count("*")) / 250000, 1)
    urgency = F.col("o_orderpriority")
    return df.groupBy("area_name", month_key(F.to_date("o_orderdate")).alias("month")).agg(
        index.alias("land_price_index"),
        F.countDistinct("o_custkey").alias("population"),
        F.count("*").alias("foot_traffic"),
        F.count(F.when(urgency == "1-URGENT", 1)).alias("new_business_count"),
        F.count(F.when(urgency == "2-HIGH", 1)).alias("event_count"),
    )


def external_factors(spark: SparkSession, folder: str) -> DataFrame:
    """Rain days and two material price indexes per month, from the line items."""
    day = F.to_date("l_shipdate")
    return (
        source(spark, folder, "lineitem")
        .groupBy(month_key(day).alias("month"))
        .agg(
            F.countDistinct(F.when(F.col("l_discount") > 0.05, day)).alias("rain_days"),
            F.round(safe_div(F.sum(F.col("l_quantity").cast("long")), F.count("*")) * 4, 2).alias("steel_index"),
            F.round(safe_div(F.sum(cents("l_extendedprice")), F.count("*")) / 40000, 2).alias("concrete_index"),
        )
    )


def headcount(spark: SparkSession, folder: str) -> DataFrame:
    """Employees per month: the customers ordering in it."""
    orders = source(spark, folder, "orders")
    return orders.groupBy(F.to_date(F.date_trunc("month", "o_orderdate")).alias("sales_month")).agg(
        F.countDistinct("o_custkey").alias("employees")
    )


def acquisition_costs(spark: SparkSession, folder: str) -> DataFrame:
    return saas(spark, folder).select("product", "month", (F.col("expansion_mrr_kpy") + 1000).alias("cac_kpy"))


def program_measures(spark: SparkSession, folder: str) -> DataFrame:
    """Cost and effect entries of programmes, one per event."""
    return source(spark, folder, "events").select(
        F.col("event_type").alias("program"),
        _event_month("1996-01-01").alias("month"),
        F.when(F.col("value") < 10, "cost").otherwise("effect").alias("metric"),
        F.col("user_id").alias("participant"),
        cents("value").alias("amount_kpy"),
    )


def all_tables(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    return {
        "projects_master": projects(spark, folder),
        "cost_records": cost_records(spark, folder),
        "cash_in_schedules": cash_in(spark, folder),
        "real_estate_properties": properties(spark, folder),
        "facility_operations": facilities(spark, folder),
        "saas_metrics": saas(spark, folder),
        "area_indicators": areas(spark, folder),
    }
