"""The seven analytic views as functions from base tables to a result."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from girder.functions.exprs import (
    STANDARD_SHARES,
    Rule,
    cashflow_risk,
    category_budget,
    cost_risk_level,
    count_where,
    label_by_rules,
    month_diff,
    month_key,
    month_start,
    pct,
    safe_div,
    shortfall_flag,
    sum_where,
    to_int,
    zero,
)
from girder.operators.timeline import activity_changes, by_time, opening_balance, running_total, trailing_mean


@dataclass(frozen=True)
class CostTerms:
    """Status and category values of the cost table."""

    confirmed: tuple[str, ...] = ("確定請求",)
    forecast: tuple[str, ...] = ("現場見込み", "口頭発注")
    outsourcing: str = "外注費"
    material: str = "材料費"
    labor: str = "労務費"
    expense: str = "経費"


TERMS = CostTerms()


def project_costs(costs: DataFrame, terms: CostTerms = TERMS, sign: Column | None = None) -> DataFrame:
    """Cost totals per project, split by status and by category, in one aggregate.

    With a ``sign`` of 1 or -1 rows are added or taken back, and the totals are changes.
    """
    amount = F.col("amount_kpy") if sign is None else F.col("amount_kpy") * sign
    count = count_where if sign is None else lambda cond: sum_where(cond, sign)
    confirmed = F.col("status").isin(list(terms.confirmed))
    forecast = F.col("status").isin(list(terms.forecast))
    category = F.col("category")
    return costs.groupBy("project_id").agg(
        F.sum(amount).alias("total_cost"),
        sum_where(confirmed, amount).alias("confirmed_cost"),
        sum_where(forecast, amount).alias("forecast_cost"),
        sum_where(category == terms.outsourcing, amount).alias("outsourcing_cost"),
        sum_where(category == terms.material, amount).alias("material_cost"),
        sum_where(category == terms.labor, amount).alias("labor_cost"),
        sum_where(category == terms.expense, amount).alias("expense_cost"),
        count(F.lit(True)).alias("record_count"),
        count(confirmed).alias("confirmed_count"),
        count(forecast).alias("forecast_count"),
    )


def _monthly(df: DataFrame, month: str, **measures: Column) -> DataFrame:
    """Rows reduced to a ``YYYY-MM`` month and the measures they feed; a NULL month joins nothing."""
    return df.select(F.col(month).alias("month"), *[m.alias(k) for k, m in measures.items()]).filter(
        F.col("month").isNotNull()
    )


def company_dashboard(
    projects: DataFrame,
    costs: DataFrame,
    cash_in: DataFrame,
    properties: DataFrame,
    facilities: DataFrame,
    saas: DataFrame,
    cost_month: str = "accrual_month",
    spine: str = "cash",
) -> DataFrame:
    """Company sales, forecast, margin, running projects and cash by month.

    All sources are stacked and grouped once, so each row meets one shuffle of
    partial sums instead of a chain of joins. Months stay text until they are
    grouped. The rows are the months with receipts; ``spine="all"`` keeps every
    month any source has.
    """
    moves = activity_changes(projects).groupBy("month").agg(F.sum("delta").alias("delta"))
    stacked = [
        _monthly(cash_in, "deposit_month", inflow=F.col("expected_amount_kpy"), is_cash=F.lit(1)),
        _monthly(costs, cost_month, outflow=F.col("amount_kpy")),
        _monthly(facilities, "month", facility=F.col("revenue_kpy")),
        _monthly(saas, "month", mrr=F.col("mrr_kpy")),
        moves.select(month_key("month").alias("month"), "delta"),
    ]
    rows = stacked[0]
    for part in stacked[1:]:
        rows = rows.unionByName(part, allowMissingColumns=True)
    monthly = rows.groupBy("month").agg(
        *[F.sum(c).alias(c) for c in ("inflow", "outflow", "facility", "mrr", "delta")],
        F.max("is_cash").alias("is_cash"),
        F.count(F.coalesce("inflow", "outflow", "facility", "mrr")).alias("entries"),
    )
    w = by_time("month")
    monthly = monthly.withColumn("active_project_count", zero(running_total("delta", w)))
    monthly = monthly.filter(F.col("is_cash") == 1 if spine == "cash" else F.col("entries") > 0)
    rent = properties.agg(F.sum("monthly_rental_income_kpy")).scalar()
    sales = zero("inflow") + zero(rent) + zero("facility") + zero("mrr")
    return (
        monthly.withColumn("total_sales", sales)
        .withColumn("total_cost", zero("outflow"))
        .select(
            month_start("month").alias("sales_month"),
            "total_sales",
            zero("inflow").alias("actual_sales"),
            to_int(trailing_mean("total_sales", w)).alias("forecast_sales"),
            pct(F.col("total_sales") - F.col("total_cost"), "total_sales").alias("operating_profit_margin"),
            "active_project_count",
            running_total(F.col("total_sales") - F.col("total_cost"), w).alias("cash_balance"),
        )
    )


# Area names looked for in project, property and facility names.
OTHER_AREA = "その他"
PROJECT_AREAS: tuple[Rule, ...] = (
    ("三島", "三島"),
    ("沼津", "沼津"),
    ("函南", "函南"),
    ("清水", "清水"),
    ("長泉", "長泉"),
    ("伊豆の国", "伊豆の国"),
    ("伊豆市", "伊豆"),
)
PROPERTY_AREAS: tuple[Rule, ...] = (("三島", "三島"), ("沼津", "沼津"), ("函南", "函南"))
FACILITY_AREAS: tuple[Rule, ...] = (
    (("函南", "伊豆"), "函南"),
    (("三島", "未来"), "三島"),
    ("沼津", "沼津"),
)


def area_totals(
    projects: DataFrame,
    properties: DataFrame,
    facilities: DataFrame,
    areas: DataFrame,
    project_rules: Sequence[Rule] = PROJECT_AREAS,
    property_rules: Sequence[Rule] = PROPERTY_AREAS,
    facility_rules: Sequence[Rule] = FACILITY_AREAS,
    other: str = OTHER_AREA,
) -> DataFrame:
    """Unfilled sums and means per area over the four sources.

    Stands for a chain of full outer joins: the labelled rows are stacked and
    grouped once, and a measure a source lacks stays NULL.
    """
    stacked = [
        projects.select(
            label_by_rules("project_name", project_rules, other).alias("area"),
            F.col("contract_amount_kpy").alias("construction"),
            F.lit(1).alias("project"),
        ),
        properties.select(
            label_by_rules("location", property_rules, other).alias("area"),
            F.col("monthly_rental_income_kpy").alias("rent"),
            F.col("acquisition_cost_kpy").alias("acquisition"),
            F.col("current_value_kpy").alias("property_value"),
            "occupancy_rate",
        ),
        facilities.select(
            label_by_rules("facility_name", facility_rules, other).alias("area"),
            F.col("revenue_kpy").alias("facility_revenue"),
            F.col("operating_profit_kpy").alias("facility_profit"),
            "visitors",
        ),
        areas.select(
            F.col("area_name").alias("area"),
            "land_price_index",
            "population",
            "foot_traffic",
            F.struct("month", "land_price_index").alias("dated_index"),
        ),
    ]
    rows = stacked[0]
    for part in stacked[1:]:
        rows = rows.unionByName(part, allowMissingColumns=True)
    first, last = F.min("dated_index"), F.max("dated_index")
    return rows.groupBy("area").agg(
        F.sum("construction").alias("construction"),
        F.count("project").alias("project_count"),
        (F.sum("rent") * 12).alias("annual_rent"),
        F.sum("acquisition").alias("acquisition"),
        F.sum("property_value").alias("property_value"),
        F.avg("occupancy_rate").alias("occupancy_rate"),
        F.sum("facility_revenue").alias("facility_revenue"),
        F.sum("facility_profit").alias("facility_profit"),
        F.sum("visitors").alias("visitors"),
        F.avg("land_price_index").alias("land_price_index"),
        F.avg("population").alias("population"),
        F.avg("foot_traffic").alias("foot_traffic"),
        first["land_price_index"].alias("first_index"),
        last["land_price_index"].alias("last_index"),
    )


def area_roi(projects: DataFrame, properties: DataFrame, facilities: DataFrame, areas: DataFrame, **rules) -> DataFrame:
    """Revenue by business, investment, return on it and indicators per area."""
    t = area_totals(projects, properties, facilities, areas, **rules)
    returned = zero("construction") + zero("annual_rent") + zero("facility_revenue")
    invested = zero("construction") + zero("acquisition")
    return t.select(
        "area",
        zero("construction").alias("construction_revenue_kpy"),
        "project_count",
        zero("annual_rent").alias("annual_rental_income_kpy"),
        zero("property_value").alias("property_value_kpy"),
        zero("occupancy_rate").alias("avg_occupancy_rate"),
        zero("facility_revenue").alias("facility_revenue_kpy"),
        zero("facility_profit").alias("facility_profit_kpy"),
        zero("visitors").alias("total_visitors"),
        returned.alias("total_return_kpy"),
        invested.alias("total_investment_kpy"),
        pct(returned - invested, invested).alias("roi_rate"),
        zero("land_price_index").alias("land_price_index"),
        zero("population").alias("population"),
        zero("foot_traffic").alias("foot_traffic"),
    )


def area_indicators(areas: DataFrame) -> DataFrame:
    return areas.select(
        "area_name",
        month_start("month").alias("indicator_month"),
        "land_price_index",
        "population",
        "foot_traffic",
        "new_business_count",
        "event_count",
    )


def project_cost_summary(projects: DataFrame, costs: DataFrame, terms: CostTerms = TERMS) -> DataFrame:
    """Cost, profit, cost rate and overrun risk per project.

    Costs are grouped before the join, so the fact table is shuffled once as
    partial sums and the join finds it already partitioned by project.
    """
    return cost_summary_of(projects, project_costs(costs, terms))


def cost_summary_of(projects: DataFrame, sums: DataFrame) -> DataFrame:
    """The summary from cost totals that are already one row per project."""
    joined = projects.join(sums, "project_id", "left")
    total = zero("total_cost")
    rate = safe_div(total, "contract_amount_kpy") * 100
    parts = ("outsourcing", "material", "labor", "expense")
    return joined.select(
        "project_id",
        "project_name",
        "division",
        "client_type",
        "pm_name",
        "contract_amount_kpy",
        "target_cost_rate",
        "progress_rate",
        F.col("status").alias("project_status"),
        "start_date",
        "end_date",
        zero("confirmed_cost").alias("confirmed_cost_kpy"),
        zero("forecast_cost").alias("forecast_cost_kpy"),
        total.alias("total_cost_kpy"),
        (F.col("contract_amount_kpy") - total).alias("gross_profit"),
        F.round(rate, 1).alias("effective_cost_rate"),
        F.round(rate - F.col("target_cost_rate"), 1).alias("cost_rate_gap"),
        *[zero(f"{p}_cost").alias(f"{p}_cost_kpy") for p in parts],
        *[pct(f"{p}_cost", "total_cost").alias(f"{p}_ratio") for p in parts],
        cost_risk_level(rate, "target_cost_rate").alias("risk_level"),
    )


def cost_category_detail(
    projects: DataFrame, costs: DataFrame, shares: Mapping[str, float] = STANDARD_SHARES
) -> DataFrame:
    """Budget, actual and variance per project and cost category."""
    spent = costs.groupBy("project_id", "category").agg(F.sum("amount_kpy").alias("spent"))
    budget = category_budget("contract_amount_kpy", "target_cost_rate", "category", shares)
    return spent.join(projects, "project_id").select(
        "project_id",
        "project_name",
        "division",
        F.col("category").alias("cost_category"),
        to_int(budget).alias("category_budget"),
        F.col("spent").alias("category_actual"),
        to_int(budget - F.col("spent")).alias("category_variance"),
    )


def cashflow_forecast(cash_in: DataFrame, costs: DataFrame, terms: CostTerms = TERMS) -> DataFrame:
    """Inflow, outflow, balances, shortfall flag and risk per month.

    Receipts and payments are stacked and grouped once in place of a full outer
    join of two aggregates.
    """
    return cashflow_of(monthly_cash_sums(cash_in, costs, terms))


CASH_SUMS = {
    "expected": "expected_inflow_kpy",
    "received": "actual_inflow_kpy",
    "paid": "total_outflow_kpy",
    "confirmed": "confirmed_outflow_kpy",
    "forecast": "forecast_outflow_kpy",
}


def monthly_cash_sums(cash_in: DataFrame, costs: DataFrame, terms: CostTerms = TERMS, sign: Column | None = None) -> DataFrame:
    """Receipts and payments per month; with a ``sign`` of 1 or -1, their changes and the rows they come from."""
    one = F.lit(1) if sign is None else sign
    expected = F.col("expected_amount_kpy") * one
    received = F.when(F.col("status") == "入金済", F.coalesce(F.col("actual_amount_kpy") * one, expected)).otherwise(F.lit(0))
    amount = F.col("amount_kpy") * one
    confirmed = F.col("status").isin(list(terms.confirmed))
    forecast = F.col("status").isin(list(terms.forecast))
    rows = cash_in.select(
        F.col("deposit_month").alias("month_str"), expected.alias("expected"), received.alias("received"), one.alias("entries")
    ).unionByName(
        costs.select(
            F.col("payment_due_month").alias("month_str"),
            amount.alias("paid"),
            F.when(confirmed, amount).alias("confirmed"),
            F.when(forecast, amount).alias("forecast"),
            one.alias("entries"),
        ),
        allowMissingColumns=True,
    )
    counted = [] if sign is None else [F.sum("entries").alias("entries")]
    return rows.groupBy("month_str").agg(*[zero(F.sum(c)).alias(name) for c, name in CASH_SUMS.items()], *counted)


def cashflow_of(sums: DataFrame) -> DataFrame:
    """The view from sums that are already one row per month."""
    net = F.col("net_cashflow_kpy")
    w = by_time("month_str")
    return (
        sums.withColumn("net_cashflow_kpy", F.col("expected_inflow_kpy") - F.col("total_outflow_kpy"))
        .withColumn("beginning_balance_kpy", opening_balance(net, w))
        .withColumn("ending_balance_kpy", F.col("beginning_balance_kpy") + net)
        .select(
            month_start("month_str").alias("cf_date"),
            "month_str",
            *CASH_SUMS.values(),
            "net_cashflow_kpy",
            "beginning_balance_kpy",
            "ending_balance_kpy",
            shortfall_flag("ending_balance_kpy").alias("min_cash_flag"),
            cashflow_risk(net).alias("cashflow_risk"),
        )
    )


def ml_features(projects: DataFrame, costs: DataFrame, terms: CostTerms = TERMS) -> DataFrame:
    """Model features of every project that has costs; percentages unrounded."""
    joined = projects.join(project_costs(costs, terms), "project_id").filter(F.col("total_cost").isNotNull())

    def share(a: str, b: str) -> Column:
        return safe_div(a, b) * 100

    return joined.select(
        "project_id",
        share("total_cost", "contract_amount_kpy").alias("actual_cost_rate"),
        "division",
        "client_type",
        "contract_amount_kpy",
        month_diff("end_date", "start_date").alias("duration_months"),
        "target_cost_rate",
        "progress_rate",
        F.col("status").alias("project_status"),
        share("confirmed_cost", "contract_amount_kpy").alias("confirmed_cost_rate"),
        share("forecast_cost", "contract_amount_kpy").alias("forecast_cost_rate"),
        share("confirmed_cost", "total_cost").alias("confirmed_ratio"),
        share("outsourcing_cost", "total_cost").alias("outsourcing_pct"),
        share("material_cost", "total_cost").alias("material_pct"),
        share("labor_cost", "total_cost").alias("labor_pct"),
        share("expense_cost", "total_cost").alias("expense_pct"),
        safe_div(safe_div("total_cost", "contract_amount_kpy"), F.col("progress_rate") / 100).alias(
            "cost_progress_ratio"
        ),
        F.col("record_count").alias("cost_record_count"),
        "confirmed_count",
        "forecast_count",
    )
