"""Exploratory tables: portfolio, cost structure, loss risk, cross-business correlation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from girder.functions.exprs import gap_zone, safe_div, sum_where, thousand_to_million, zero
from girder.operators.summaries import (
    correlation_pairs,
    histogram,
    pivot_count,
    pivot_sum,
    share_of_total,
    top_k,
)

CLIENT_TYPES = ("官公庁", "民間")
CATEGORIES = ("外注費", "材料費", "労務費", "経費")


def portfolio_counts(projects: DataFrame, client_types: Sequence[str] = CLIENT_TYPES) -> DataFrame:
    """Projects per division with one column per client type."""
    return pivot_count(projects, ["division"], "client_type", client_types)


def contract_histogram(projects: DataFrame, bins: int = 15) -> DataFrame:
    """Contract amounts in millions, binned per division."""
    amounts = projects.select("division", thousand_to_million("contract_amount_kpy").alias("amount"))
    return histogram(amounts, "amount", bins, ["division"])


def target_rate_histogram(projects: DataFrame, bins: int = 10) -> DataFrame:
    return histogram(projects, "target_cost_rate", bins, ["division"])


def status_shares(projects: DataFrame) -> DataFrame:
    return share_of_total(projects, ["status"], F.count("*"), "project_count")


def cost_shares(costs: DataFrame, key: str) -> DataFrame:
    """Cost per category or status with its share of all costs, in millions too."""
    shares = share_of_total(costs, [key], F.sum("amount_kpy"), "amount_kpy")
    return shares.withColumn("amount_million", thousand_to_million("amount_kpy"))


def division_costs(projects: DataFrame, costs: DataFrame, categories: Sequence[str] = CATEGORIES) -> DataFrame:
    """Cost in millions per division, one column per category.

    Costs are summed per project before they meet the project table, so the
    join carries a few rows per project and no single project can weigh on it.
    """
    per_project = costs.groupBy("project_id", "category").agg(F.sum("amount_kpy").alias("amount_kpy"))
    joined = per_project.join(projects.select("project_id", "division"), "project_id", "left")
    wide = pivot_sum(joined.filter(F.col("division").isNotNull()), ["division"], "category", categories, "amount_kpy")
    return wide.select("division", *[thousand_to_million(c).alias(c) for c in categories])


def loss_risk(
    projects: DataFrame, costs: DataFrame, confirmed: Sequence[str] = ("確定請求",), contracts: DataFrame | None = None
) -> DataFrame:
    """Effective cost rate, gap to target, zone and bubble size per project, unrounded.

    ``contracts`` has the contract amounts alone, where they cost less to read than the projects.
    """
    amount = F.col("amount_kpy")
    per_project = costs.groupBy("project_id").agg(
        F.sum(amount).alias("total_cost"),
        sum_where(F.col("status").isin(list(confirmed)), amount).alias("confirmed_cost"),
        F.count(amount).alias("record_count"),
    )
    joined = projects.join(per_project, "project_id", "left").withColumn("total_cost", zero("total_cost"))
    rated = joined.withColumn(
        "effective_cost_rate", safe_div("total_cost", "contract_amount_kpy") * 100
    ).withColumn("cost_rate_gap", F.col("effective_cost_rate") - F.col("target_cost_rate"))
    largest = (projects if contracts is None else contracts).agg(F.max("contract_amount_kpy")).scalar()
    return rated.select(
        "project_id",
        "project_name",
        "target_cost_rate",
        "total_cost",
        "confirmed_cost",
        "record_count",
        "effective_cost_rate",
        "cost_rate_gap",
        gap_zone("cost_rate_gap").alias("zone"),
        (safe_div("contract_amount_kpy", largest) * 300).alias("bubble_size"),
    )


def top_loss_risk(projects: DataFrame, costs: DataFrame, k: int = 10, contracts: DataFrame | None = None) -> DataFrame:
    """The k projects furthest over their target rate."""
    ranked = top_k(loss_risk(projects, costs, contracts=contracts), "cost_rate_gap", k, ["project_id"])
    return ranked.select(
        "project_id", F.substring("project_name", 1, 15).alias("label"), "cost_rate_gap", "zone"
    )


CROSS_MEASURES = (
    "total_visitors",
    "total_facility_revenue",
    "avg_land_price",
    "avg_foot_traffic",
    "total_mrr",
    "total_customers",
)


def cross_business_months(facilities: DataFrame, areas: DataFrame, saas: DataFrame) -> DataFrame:
    """Facility, area and subscription measures side by side per month."""
    by_facility = facilities.groupBy("month").agg(
        F.sum("visitors").alias("total_visitors"), F.sum("revenue_kpy").alias("total_facility_revenue")
    )
    by_area = areas.groupBy("month").agg(
        F.avg("land_price_index").alias("avg_land_price"),
        F.avg("foot_traffic").alias("avg_foot_traffic"),
        F.sum("population").alias("total_population"),
    )
    by_product = saas.groupBy("month").agg(
        F.sum("mrr_kpy").alias("total_mrr"), F.sum("customers").alias("total_customers")
    )
    return by_facility.join(by_area, "month").join(by_product, "month", "left")


def cross_business_correlation(facilities: DataFrame, areas: DataFrame, saas: DataFrame) -> DataFrame:
    return correlation_pairs(cross_business_months(facilities, areas, saas), CROSS_MEASURES)
