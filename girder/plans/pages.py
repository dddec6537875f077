"""Dashboard pages: score cards, chart series and tables over the views.

Filters from ``apply_controls`` go on a view before it is handed over; Catalyst
moves them below the aggregates where the column allows it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from girder.functions.exprs import safe_div
from girder.operators.summaries import cards, chart, share_of_total, top_k
from girder.operators.timeline import by_time, previous

# Page 1 over the company dashboard.


def company_cards(dashboard: DataFrame) -> DataFrame:
    return cards(
        dashboard,
        {
            "total_sales": ("sum", "total_sales"),
            "operating_profit_margin": ("avg", "operating_profit_margin"),
            "active_project_count": ("max", "active_project_count"),
            "cash_balance": ("max", "cash_balance"),
        },
    )


def sales_series(dashboard: DataFrame) -> DataFrame:
    return chart(
        dashboard,
        ["sales_month"],
        {
            "actual_sales": ("sum", "actual_sales"),
            "forecast_sales": ("sum", "forecast_sales"),
            "total_sales": ("sum", "total_sales"),
            "operating_profit_margin": ("avg", "operating_profit_margin"),
            "cash_balance": ("sum", "cash_balance"),
        },
    )


def sales_against_previous(dashboard: DataFrame) -> DataFrame:
    """Total sales of each month with the previous month and the change."""
    w = by_time("sales_month")
    return (
        dashboard.select("sales_month", "total_sales")
        .withColumn("previous_sales", previous("total_sales", w))
        .withColumn("change_pct", safe_div(F.col("total_sales") - F.col("previous_sales"), "previous_sales") * 100)
    )


# Page 2 over area ROI and the area indicators.


def area_cards(roi: DataFrame) -> DataFrame:
    return cards(roi, {"roi_rate": ("avg", "roi_rate"), "total_investment_kpy": ("sum", "total_investment_kpy")})


def area_portfolio(roi: DataFrame) -> DataFrame:
    """Revenue by business and area, largest total return first."""
    parts = ("construction_revenue_kpy", "annual_rental_income_kpy", "facility_revenue_kpy", "total_return_kpy")
    return chart(roi, ["area"], {p: ("sum", p) for p in parts}).orderBy(F.desc("total_return_kpy"), "area")


def area_roi_bars(roi: DataFrame) -> DataFrame:
    return chart(roi, ["area"], {"roi_rate": ("sum", "roi_rate")}).orderBy(F.desc("roi_rate"), "area")


def area_table(roi: DataFrame, rows: int = 10) -> DataFrame:
    sums = (
        "project_count",
        "construction_revenue_kpy",
        "annual_rental_income_kpy",
        "facility_revenue_kpy",
        "total_return_kpy",
        "total_investment_kpy",
    )
    table = chart(
        roi, ["area"], {c: ("sum", c) for c in sums} | {c: ("avg", c) for c in ("roi_rate", "avg_occupancy_rate")}
    )
    return top_k(table, "total_return_kpy", rows, ["area"])


def indicator_series(indicators: DataFrame) -> DataFrame:
    return chart(
        indicators,
        ["indicator_month", "area_name"],
        {c: ("avg", c) for c in ("land_price_index", "population", "foot_traffic")},
    )


# Page 3 over the project cost summary and the category detail.


def project_cards(summary: DataFrame) -> DataFrame:
    return cards(
        summary,
        {
            "project_count": ("count", "project_id"),
            "gross_profit": ("sum", "gross_profit"),
            "effective_cost_rate": ("avg", "effective_cost_rate"),
        },
    )


def project_table(summary: DataFrame, rows: int | None = 15) -> DataFrame:
    """Projects furthest over target first; ``rows=None`` is the whole table."""
    table = summary.select(
        "project_id",
        "project_name",
        "division",
        "pm_name",
        "project_status",
        "risk_level",
        "contract_amount_kpy",
        "total_cost_kpy",
        "gross_profit",
        "target_cost_rate",
        "effective_cost_rate",
        "cost_rate_gap",
        "progress_rate",
    )
    if rows is None:
        return table.orderBy(F.col("cost_rate_gap").desc_nulls_last(), "project_id")
    return top_k(table, "cost_rate_gap", rows, ["project_id"])


def progress_scatter(summary: DataFrame) -> DataFrame:
    """Progress against cost rate by project name, with the mean target as reference line."""
    points = chart(
        summary,
        ["project_name", "risk_level"],
        {
            "progress_rate": ("avg", "progress_rate"),
            "effective_cost_rate": ("avg", "effective_cost_rate"),
            "contract_amount_kpy": ("sum", "contract_amount_kpy"),
            "_targets": ("sum", "target_cost_rate"),
            "_known": ("count", "target_cost_rate"),
        },
    )
    # Read off the grouped points, whose shuffle Spark reuses, and not off the view again.
    reference = points.agg(safe_div(F.sum("_targets"), F.sum("_known"))).scalar()
    return points.withColumn("target_reference", reference).drop("_targets", "_known")


def category_donut(detail: DataFrame) -> DataFrame:
    return share_of_total(detail, ["cost_category"], F.sum("category_actual"), "category_actual")


def budget_against_actual(detail: DataFrame) -> DataFrame:
    return chart(
        detail,
        ["cost_category"],
        {"category_budget": ("sum", "category_budget"), "category_actual": ("sum", "category_actual")},
    )


def manager_ranking(summary: DataFrame) -> DataFrame:
    """Gross profit per project manager, the largest first."""
    return chart(summary, ["pm_name"], {"gross_profit": ("sum", "gross_profit")}).orderBy(
        F.desc("gross_profit"), "pm_name"
    )


# Page 4 over the cash-flow forecast.


def cash_cards(cashflow: DataFrame) -> DataFrame:
    return cards(
        cashflow,
        {
            "ending_balance_kpy": ("max", "ending_balance_kpy"),
            "shortage_months": ("sum", "min_cash_flag"),
            "net_cashflow_kpy": ("avg", "net_cashflow_kpy"),
        },
    )


def cash_series(cashflow: DataFrame) -> DataFrame:
    cols = (
        "expected_inflow_kpy",
        "total_outflow_kpy",
        "beginning_balance_kpy",
        "ending_balance_kpy",
        "confirmed_outflow_kpy",
        "forecast_outflow_kpy",
    )
    return chart(cashflow, ["cf_date"], {c: ("sum", c) for c in cols})


def cash_table(cashflow: DataFrame, rows: int = 12) -> DataFrame:
    """The first ``rows`` months; filter the view first to page through it."""
    return top_k(cashflow.drop("cf_date", "min_cash_flag"), "month_str", rows, [], descending=False)


def latest_balance(cashflow: DataFrame) -> DataFrame:
    """Closing balance of the last month, which the MAX card does not show."""
    return cashflow.agg(
        F.max("cf_date").alias("cf_date"),
        F.max_by("ending_balance_kpy", "cf_date").alias("latest_balance_kpy"),
    )


def shortage_months(cashflow: DataFrame) -> DataFrame:
    return cashflow.filter(F.col("min_cash_flag") == 1).select("cf_date", "ending_balance_kpy", "cashflow_risk")
