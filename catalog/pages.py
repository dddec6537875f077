"""Dashboard cards, charts, tables and filters over the stand-in tables."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from catalog import views as v
from catalog.registry import query
from girder.operators.controls import (
    AREA_PAGE,
    COMPANY_PAGE,
    DETAIL,
    NOTHING,
    PAGE_GRANTS,
    PROFIT_PAGE,
    PROGRAM_PAGE,
    RISK_PAGE,
    apply_controls,
    role_page,
    secure_view,
)
from girder.plans import pages
from girder.plans import views as plans
from girder.sources import standins as src


def rounded(df: DataFrame, *cols: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in cols})


@query(
    """SELECT CAST(sum(total_sales) AS BIGINT) AS total_sales, round(avg(operating_profit_margin), 6) AS operating_profit_margin,
  max(active_project_count) AS active_project_count, max(cash_balance) AS cash_balance FROM dashboard""",
    "dashboard",
)
def company_cards(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(pages.company_cards(v.dashboard(spark, sf)), "operating_profit_margin")


@query("SELECT sales_month, actual_sales, forecast_sales, total_sales, operating_profit_margin, cash_balance FROM dashboard", "dashboard")
def sales_series(spark: SparkSession, sf: str) -> DataFrame:
    return pages.sales_series(v.dashboard(spark, sf))


@query(
    """SELECT sales_month, total_sales, lag(total_sales) OVER w AS previous_sales,
  CAST(total_sales - lag(total_sales) OVER w AS DOUBLE) / NULLIF(lag(total_sales) OVER w, 0) * 100 AS change_pct
FROM dashboard WINDOW w AS (ORDER BY sales_month)""",
    "dashboard",
)
def sales_against_previous(spark: SparkSession, sf: str) -> DataFrame:
    return pages.sales_against_previous(v.dashboard(spark, sf))


@query("SELECT round(avg(roi_rate), 6) AS roi_rate, CAST(sum(total_investment_kpy) AS BIGINT) AS total_investment_kpy FROM roi", "roi")
def area_cards(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(pages.area_cards(v.roi(spark, sf)), "roi_rate")


@query(
    """SELECT area, construction_revenue_kpy, annual_rental_income_kpy, facility_revenue_kpy, total_return_kpy FROM roi""",
    "roi",
)
def area_portfolio(spark: SparkSession, sf: str) -> DataFrame:
    return pages.area_portfolio(v.roi(spark, sf))


@query("SELECT area, roi_rate FROM roi", "roi")
def area_roi_bars(spark: SparkSession, sf: str) -> DataFrame:
    return pages.area_roi_bars(v.roi(spark, sf))


@query(
    """SELECT area, project_count, construction_revenue_kpy, annual_rental_income_kpy, facility_revenue_kpy, total_return_kpy,
  total_investment_kpy, roi_rate, avg_occupancy_rate FROM roi ORDER BY total_return_kpy DESC, area LIMIT 10""",
    "roi",
)
def area_table(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(pages.area_table(v.roi(spark, sf)), "avg_occupancy_rate")


@query(
    """SELECT CAST(month || '-01' AS DATE) AS indicator_month, area_name, land_price_index,
  CAST(population AS DOUBLE) AS population, CAST(foot_traffic AS DOUBLE) AS foot_traffic FROM areas""",
    "areas",
)
def indicator_series(spark: SparkSession, sf: str) -> DataFrame:
    return pages.indicator_series(plans.area_indicators(src.areas(spark, sf)))


@query(
    """SELECT count(project_id) AS project_count, CAST(sum(gross_profit) AS BIGINT) AS gross_profit,
  round(avg(effective_cost_rate), 6) AS effective_cost_rate FROM cost_summary""",
    "cost_summary",
)
def project_cards(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(pages.project_cards(v.cost_summary(spark, sf)), "effective_cost_rate")


TABLE_COLUMNS = """project_id, project_name, division, pm_name, project_status, risk_level, contract_amount_kpy, total_cost_kpy,
  gross_profit, target_cost_rate, effective_cost_rate, cost_rate_gap, progress_rate"""


@query(
    f"""SELECT {TABLE_COLUMNS} FROM cost_summary WHERE cost_rate_gap IS NOT NULL ORDER BY cost_rate_gap DESC, project_id LIMIT 15""",
    "cost_summary",
)
def project_table_top(spark: SparkSession, sf: str) -> DataFrame:
    return pages.project_table(v.cost_summary(spark, sf))


@query(
    f"""SELECT {TABLE_COLUMNS} FROM cost_summary WHERE division = '土木' AND project_status IN ('進行中', '未着工')
  AND start_date >= DATE '1997-01-01' AND start_date <= DATE '1999-12-31'""",
    "cost_summary",
)
def project_table_filtered(spark: SparkSession, sf: str) -> DataFrame:
    """The project table under a date range and drop-down filters."""
    chosen = apply_controls(
        v.cost_summary(spark, sf),
        between=("start_date", F.lit("1997-01-01").cast("date"), F.lit("1999-12-31").cast("date")),
        division="土木",
        project_status=["進行中", "未着工"],
        pm_name=None,
    )
    return pages.project_table(chosen, rows=None)


@query(
    """SELECT project_name, risk_level, round(avg(progress_rate), 6) AS progress_rate, round(avg(effective_cost_rate), 6) AS effective_cost_rate,
  CAST(sum(contract_amount_kpy) AS BIGINT) AS contract_amount_kpy, (SELECT round(avg(target_cost_rate), 6) FROM cost_summary) AS target_reference
FROM cost_summary GROUP BY ALL""",
    "cost_summary",
)
def progress_scatter(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(
        pages.progress_scatter(v.cost_summary(spark, sf)), "progress_rate", "effective_cost_rate", "target_reference"
    )


@query(
    """SELECT cost_category, CAST(sum(category_actual) AS BIGINT) AS category_actual,
  CAST(sum(category_actual) AS DOUBLE) / (SELECT sum(category_actual) FROM category_detail) * 100 AS share_pct
FROM category_detail GROUP BY 1""",
    "category_detail",
)
def category_donut(spark: SparkSession, sf: str) -> DataFrame:
    return pages.category_donut(v.category_detail(spark, sf))


@query(
    """SELECT cost_category, CAST(sum(category_budget) AS BIGINT) AS category_budget, CAST(sum(category_actual) AS BIGINT) AS category_actual
FROM category_detail GROUP BY 1""",
    "category_detail",
)
def budget_against_actual(spark: SparkSession, sf: str) -> DataFrame:
    return pages.budget_against_actual(v.category_detail(spark, sf))


@query(
    "SELECT pm_name, CAST(sum(gross_profit) AS BIGINT) AS gross_profit FROM cost_summary GROUP BY 1",
    "cost_summary",
)
def manager_ranking(spark: SparkSession, sf: str) -> DataFrame:
    return pages.manager_ranking(v.cost_summary(spark, sf))


@query(
    """SELECT max(ending_balance_kpy) AS ending_balance_kpy, CAST(sum(min_cash_flag) AS BIGINT) AS shortage_months,
  round(avg(net_cashflow_kpy), 4) AS net_cashflow_kpy FROM cashflow""",
    "cashflow",
)
def cash_cards(spark: SparkSession, sf: str) -> DataFrame:
    return pages.cash_cards(v.cashflow(spark, sf)).withColumn("net_cashflow_kpy", F.round("net_cashflow_kpy", 4))


@query(
    """SELECT cf_date, expected_inflow_kpy, total_outflow_kpy, beginning_balance_kpy, ending_balance_kpy, confirmed_outflow_kpy,
  forecast_outflow_kpy FROM cashflow""",
    "cashflow",
)
def cash_series(spark: SparkSession, sf: str) -> DataFrame:
    return pages.cash_series(v.cashflow(spark, sf))


@query("SELECT * EXCLUDE (cf_date, min_cash_flag) FROM cashflow ORDER BY month_str LIMIT 12", "cashflow")
def cash_table(spark: SparkSession, sf: str) -> DataFrame:
    return pages.cash_table(v.cashflow(spark, sf))


@query("SELECT max(cf_date) AS cf_date, arg_max(ending_balance_kpy, cf_date) AS latest_balance_kpy FROM cashflow", "cashflow")
def latest_balance(spark: SparkSession, sf: str) -> DataFrame:
    return pages.latest_balance(v.cashflow(spark, sf))


@query("SELECT cf_date, ending_balance_kpy, cashflow_risk FROM cashflow WHERE min_cash_flag = 1", "cashflow")
def shortage_months(spark: SparkSession, sf: str) -> DataFrame:
    return pages.shortage_months(v.cashflow(spark, sf))


@query(
    """SELECT * REPLACE (NULL::BIGINT AS outsourcing_cost_kpy, NULL::BIGINT AS material_cost_kpy, NULL::BIGINT AS labor_cost_kpy,
  NULL::BIGINT AS expense_cost_kpy, NULL::DOUBLE AS outsourcing_ratio, NULL::DOUBLE AS material_ratio, NULL::DOUBLE AS labor_ratio,
  NULL::DOUBLE AS expense_ratio) FROM cost_summary WHERE pm_name IN ('NATION_3', 'NATION_4')""",
    "cost_summary",
)
def site_manager_view(spark: SparkSession, sf: str) -> DataFrame:
    """What a site manager sees: own projects, details masked."""
    return secure_view(v.cost_summary(spark, sf), "現場監督", {"pm_name": ["NATION_3", "NATION_4"]})


# --- pages by role ---------------------------------------------------------

OWN = {"division": ["土木"], "pm_name": ["NATION_3", "NATION_4"]}
# page -> (group, key, two measures, rows in SQL)
ROLE_PAGES = {
    COMPANY_PAGE: ("year", "month", "total_sales", "actual_sales", "(SELECT *, strftime(sales_month, '%Y') AS year, strftime(sales_month, '%Y-%m') AS month FROM dashboard)"),
    PROFIT_PAGE: ("division", "project_id", "contract_amount_kpy", "total_cost_kpy", "cost_summary"),
    AREA_PAGE: ("area", "area", "total_return_kpy", "total_investment_kpy", "roi"),
    PROGRAM_PAGE: ("program", "month", "effect_kpy", "cost_kpy", "programs"),
    RISK_PAGE: ("division", "project_id", "contract_amount_kpy", "forecast_cost_kpy", "cost_summary"),
}
PROGRAMS = """programs AS (SELECT event_type AS program, strftime(DATE '1996-01-01' + to_months(CAST(day(ts) - 1 AS INTEGER)), '%Y-%m') AS month,
  CASE WHEN value < 10 THEN 0 ELSE CAST(round(value * 100) AS BIGINT) END AS effect_kpy, CASE WHEN value < 10 THEN CAST(round(value * 100) AS BIGINT) ELSE 0 END AS cost_kpy FROM events)"""


def page_rows(spark: SparkSession, sf: str, page: str) -> DataFrame:
    if page == COMPANY_PAGE:
        month = F.date_format("sales_month", "yyyy-MM")
        return v.dashboard(spark, sf).withColumns({"month": month, "year": F.substring(month, 1, 4)})
    if page == AREA_PAGE:
        return v.roi(spark, sf)
    if page == PROGRAM_PAGE:
        spent = F.col("metric") == "cost"
        amounts = {"effect_kpy": F.when(spent, 0).otherwise(F.col("amount_kpy")), "cost_kpy": F.when(spent, F.col("amount_kpy")).otherwise(0)}
        return src.program_measures(spark, sf).withColumns(amounts)
    return v.cost_summary(spark, sf)


def role_sql(role: str) -> str:
    """Rows in detail, totals of groups and the grand total, each by a plain GROUP BY of the rows that are open."""
    parts = []
    for page, (group, key, first, second, rows) in ROLE_PAGES.items():
        grant = PAGE_GRANTS[role].get(page)
        if not grant:
            continue
        own = f"COALESCE({grant.scope} IN ({', '.join(repr(x) for x in OWN[grant.scope])}), FALSE)" if grant.scope else "TRUE"
        sums = f"count(*) AS row_count, CAST(sum({first}) AS BIGINT) AS first_kpy, CAST(sum({second}) AS BIGINT) AS second_kpy FROM {rows}"
        levels = [("detail", f"CAST({group} AS VARCHAR)", f"CAST({key} AS VARCHAR)", [DETAIL]), ("group", f"CAST({group} AS VARCHAR)", "CAST(NULL AS VARCHAR)", None)]
        for level, unit, item, needed in levels:
            seen = [side for side, what in ((own, grant.own), (f"NOT {own}", grant.rest)) if (what in needed if needed else what != NOTHING)]
            if seen:
                parts.append(f"SELECT '{page}' AS page, '{level}' AS level, {unit} AS unit, {item} AS item, {sums} WHERE {' OR '.join(seen)} GROUP BY {own}, {group}" + (f", {key}" if needed else ""))
        if grant.company:
            parts.append(f"SELECT '{page}', 'company', NULL, NULL, {sums} HAVING count(*) > 0")
    return " UNION ALL ".join(parts)


def role_query(name: str, role: str) -> None:
    def run(spark: SparkSession, sf: str) -> DataFrame:
        out = None
        for page, (group, key, first, second, _) in ROLE_PAGES.items():
            if page not in PAGE_GRANTS[role]:
                continue
            rows = page_rows(spark, sf, page).withColumn("_item", F.col(key).cast("string"))
            seen = role_page(rows, role, page, group, "_item", [first, second], OWN)
            part = seen.select(
                F.lit(page).alias("page"), "level", F.col(group).alias("unit"), F.col("_item").alias("item"), "row_count",
                F.col(first).alias("first_kpy"), F.col(second).alias("second_kpy"),
            )
            out = part if out is None else out.unionByName(part)
        return out

    run.__name__ = name
    run.__doc__ = f"What the role {role} sees of every page: detail, totals of groups, grand total."
    query(role_sql(role), "dashboard cost_summary roi", PROGRAMS)(run)


for _name, _role in (
    ("pages_of_management", "経営陣"),
    ("pages_of_planning", "経営企画"),
    ("pages_of_division_head", "事業部長"),
    ("pages_of_transformation_office", "DX推進室"),
    ("pages_of_site_manager", "現場監督"),
):
    role_query(_name, _role)
