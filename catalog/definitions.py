"""SQL definitions of the base tables and views, as used by the checks."""

AREA = """CASE r_name WHEN 'AFRICA' THEN '三島' WHEN 'AMERICA' THEN '沼津' WHEN 'ASIA' THEN '函南'
 WHEN 'EUROPE' THEN '清水' WHEN 'MIDDLE EAST' THEN '長泉' ELSE r_name END"""


def month_key(day: str) -> str:
    return f"strftime({day}, '%Y-%m')"


def cents(col: str) -> str:
    return f"CAST(round({col} * 100) AS BIGINT)"


# name -> (definitions it builds on, SQL)
DEFINITIONS: dict[str, tuple[str, str]] = {}

DEFINITIONS["places"] = (
    "",
    f"SELECT n_nationkey, n_name, {AREA} AS area_name FROM nation JOIN region ON n_regionkey = r_regionkey",
)

DEFINITIONS["projects"] = (
    "places",
    f"""
SELECT o_orderkey AS project_id, area_name || ' ' || c_name AS project_name,
  CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN '土木' ELSE '建築' END AS division,
  CASE WHEN c_mktsegment IN ('BUILDING', 'MACHINERY') THEN '官公庁' ELSE '民間' END AS client_type,
  {cents('o_totalprice')} AS contract_amount_kpy,
  CAST(o_orderdate AS DATE) AS start_date,
  CAST(CAST(o_orderdate AS DATE) + to_months(CAST(6 + o_orderkey % 19 AS INTEGER)) AS DATE) AS end_date,
  CAST(82 + o_orderkey % 9 AS DOUBLE) AS target_cost_rate,
  CASE o_orderstatus WHEN 'F' THEN 100.0::DOUBLE WHEN 'P' THEN CAST(25 + o_orderkey % 70 AS DOUBLE)
    ELSE CAST(o_orderkey % 25 AS DOUBLE) END AS progress_rate,
  CASE o_orderstatus WHEN 'F' THEN '完了' WHEN 'O' THEN '進行中' WHEN 'P' THEN '未着工' ELSE o_orderstatus END AS status,
  n_name AS pm_name, area_name
FROM orders JOIN customer ON o_custkey = c_custkey JOIN places ON c_nationkey = n_nationkey
""",
)

DEFINITIONS["costs"] = (
    "",
    f"""
SELECT l_orderkey AS project_id,
  CASE p_type WHEN 'STANDARD' THEN '外注費' WHEN 'ECONOMY' THEN '材料費' WHEN 'PROMO' THEN '労務費'
    WHEN 'LARGE' THEN '経費' ELSE p_type END AS category,
  {cents('l_extendedprice')} AS amount_kpy,
  CASE l_returnflag WHEN 'A' THEN '確定請求' WHEN 'N' THEN '現場見込み' WHEN 'R' THEN '口頭発注' ELSE l_returnflag END AS status,
  {month_key('CAST(l_shipdate AS DATE)')} AS accrual_month,
  {month_key('CAST(l_shipdate AS DATE) + INTERVAL 1 MONTH')} AS payment_due_month,
  'Supplier ' || l_suppkey AS vendor_name
FROM lineitem JOIN part ON l_partkey = p_partkey
""",
)

DEFINITIONS["receipts"] = (
    "projects",
    """
SELECT project_id, milestone, CAST(trunc(contract_amount_kpy * part) AS BIGINT) AS expected_amount_kpy,
  CAST(due AS DATE) AS expected_date, strftime(due, '%Y-%m') AS deposit_month
FROM (
  SELECT project_id, contract_amount_kpy, '前払金' AS milestone, 0.4::DOUBLE AS part, start_date + INTERVAL 1 MONTH AS due FROM projects
  UNION ALL
  SELECT project_id, contract_amount_kpy, '中間金', 0.2::DOUBLE,
    start_date + to_months(CAST(greatest(1, (year(end_date) - year(start_date)) * 12 + month(end_date) - month(start_date)) // 2 AS INTEGER)) FROM projects
  UNION ALL
  SELECT project_id, contract_amount_kpy, '完成金', 0.4::DOUBLE, end_date + INTERVAL 1 MONTH FROM projects)
""",
)

DEFINITIONS["cash_in"] = (
    "receipts",
    """
SELECT project_id || '-' || milestone AS schedule_id, project_id, milestone, expected_amount_kpy,
  CASE WHEN paid THEN expected_amount_kpy END AS actual_amount_kpy, deposit_month,
  CASE WHEN paid THEN CASE WHEN slow THEN CAST(expected_date + INTERVAL 1 MONTH AS DATE) + CAST(1 + project_id % 15 AS INTEGER)
    ELSE expected_date + CAST(project_id % 11 - 5 AS INTEGER) END END AS actual_deposit_date,
  CASE WHEN overdue THEN '遅延' WHEN paid THEN '入金済' ELSE '予定' END AS status, expected_date
FROM (SELECT *, past AND NOT overdue AS paid FROM (
  SELECT *, past AND slow AND project_id % 20 = 0 AS overdue FROM (
    SELECT *, expected_date < DATE '2000-01-01' AS past, project_id % 10 = 0 AND milestone <> '前払金' AS slow FROM receipts)))
""",
)

DEFINITIONS["properties"] = (
    "places",
    f"""
SELECT s_suppkey AS property_id, s_name AS property_name,
  CASE s_suppkey % 4 WHEN 0 THEN '賃貸マンション' WHEN 1 THEN '商業施設' WHEN 2 THEN 'オフィス' ELSE '土地' END AS property_type,
  area_name || '市' AS location,
  DATE '1985-01-01' + CAST(s_suppkey * 37 % 3650 AS INTEGER) AS acquisition_date,
  worth * 150 AS acquisition_cost_kpy,
  CAST(floor(worth * 150 * (9 + s_suppkey % 5) / 10) AS BIGINT) AS current_value_kpy,
  CASE WHEN s_suppkey % 4 = 3 THEN 0 ELSE worth END AS monthly_rental_income_kpy,
  CASE WHEN s_suppkey % 4 = 3 THEN 0.0::DOUBLE ELSE CAST(70 + s_suppkey % 31 AS DOUBLE) END AS occupancy_rate
FROM (SELECT *, greatest({cents('s_acctbal')}, 0) AS worth FROM supplier) JOIN places ON s_nationkey = n_nationkey
""",
)

DEFINITIONS["facilities"] = (
    "",
    f"""
SELECT *, revenue_kpy - operating_cost_kpy AS operating_profit_kpy FROM (
  SELECT event_type AS facility_id,
    CASE event_type WHEN 'click' THEN '伊豆 click' WHEN 'view' THEN '三島 view' WHEN 'error' THEN '沼津 error'
      WHEN 'signup' THEN '未来 signup' ELSE event_type END AS facility_name,
    strftime(DATE '1996-01-01' + to_months(CAST(day(ts) - 1 AS INTEGER)), '%Y-%m') AS month,
    count(DISTINCT user_id) AS visitors, CAST(sum({cents('value')}) AS BIGINT) AS revenue_kpy,
    40000 + CAST(floor(sum({cents('value')}) / 2) AS BIGINT) AS operating_cost_kpy
  FROM events GROUP BY ALL)
""",
)

DEFINITIONS["saas"] = (
    "",
    f"""
SELECT month, product, mrr_kpy, customers, CAST(1 + customers % 5 AS DOUBLE) AS churn_rate_pct, new_customers, expansion_mrr_kpy
FROM (
  SELECT strftime(DATE '1997-01-01' + to_months(CAST(day(ts) - 1 AS INTEGER)), '%Y-%m') AS month, event_type AS product,
    CAST(sum({cents('value')}) AS BIGINT) AS mrr_kpy, count(DISTINCT user_id) AS customers,
    count(CASE WHEN value < 10 THEN 1 END) AS new_customers,
    CAST(sum(CASE WHEN value < 10 THEN {cents('value')} ELSE 0 END) AS BIGINT) AS expansion_mrr_kpy
  FROM events WHERE event_type IN ('signup', 'purchase') GROUP BY ALL)
""",
)

DEFINITIONS["areas"] = (
    "places",
    f"""
SELECT area_name, {month_key('CAST(o_orderdate AS DATE)')} AS month,
  round(CAST(sum({cents('o_totalprice')}) AS DOUBLE) / count(*) / 250000, 1) AS land_price_index,
  count(DISTINCT o_custkey) AS population, count(*) AS foot_traffic,
  count(CASE WHEN o_orderpriority = '1-URGENT' THEN 1 END) AS new_business_count,
  count(CASE WHEN o_orderpriority = '2-HIGH' THEN 1 END) AS event_count
FROM orders JOIN customer ON o_custkey = c_custkey JOIN places ON c_nationkey = n_nationkey GROUP BY ALL
""",
)

DEFINITIONS["external_factors"] = (
    "",
    f"""
SELECT {month_key('CAST(l_shipdate AS DATE)')} AS month,
  count(DISTINCT CASE WHEN l_discount > 0.05::DOUBLE THEN CAST(l_shipdate AS DATE) END) AS rain_days,
  round(CAST(sum(CAST(l_quantity AS BIGINT)) AS DOUBLE) / count(*) * 4, 2) AS steel_index,
  round(CAST(sum({cents('l_extendedprice')}) AS DOUBLE) / count(*) / 40000, 2) AS concrete_index
FROM lineitem GROUP BY ALL
""",
)

PROJECT_COSTS = """
SELECT project_id, CAST(sum(amount_kpy) AS BIGINT) AS total_cost,
  CAST(sum(CASE WHEN status = '確定請求' THEN amount_kpy ELSE 0 END) AS BIGINT) AS confirmed_cost,
  CAST(sum(CASE WHEN status IN ('現場見込み', '口頭発注') THEN amount_kpy ELSE 0 END) AS BIGINT) AS forecast_cost,
  CAST(sum(CASE WHEN category = '外注費' THEN amount_kpy ELSE 0 END) AS BIGINT) AS outsourcing_cost,
  CAST(sum(CASE WHEN category = '材料費' THEN amount_kpy ELSE 0 END) AS BIGINT) AS material_cost,
  CAST(sum(CASE WHEN category = '労務費' THEN amount_kpy ELSE 0 END) AS BIGINT) AS labor_cost,
  CAST(sum(CASE WHEN category = '経費' THEN amount_kpy ELSE 0 END) AS BIGINT) AS expense_cost,
  count(*) AS record_count,
  count(CASE WHEN status = '確定請求' THEN 1 END) AS confirmed_count,
  count(CASE WHEN status IN ('現場見込み', '口頭発注') THEN 1 END) AS forecast_count
FROM costs GROUP BY project_id
"""
DEFINITIONS["project_costs"] = ("costs", PROJECT_COSTS)


def div(a: str, b: str) -> str:
    return f"(CAST({a} AS DOUBLE) / NULLIF({b}, 0))"


RATE = div("COALESCE(total_cost, 0)", "contract_amount_kpy") + " * 100"

DEFINITIONS["cost_summary"] = (
    "projects project_costs",
    f"""
SELECT project_id, project_name, division, client_type, pm_name, contract_amount_kpy, target_cost_rate, progress_rate,
  status AS project_status, start_date, end_date,
  COALESCE(confirmed_cost, 0) AS confirmed_cost_kpy, COALESCE(forecast_cost, 0) AS forecast_cost_kpy,
  COALESCE(total_cost, 0) AS total_cost_kpy, contract_amount_kpy - COALESCE(total_cost, 0) AS gross_profit,
  round({RATE}, 1) AS effective_cost_rate, round({RATE} - target_cost_rate, 1) AS cost_rate_gap,
  COALESCE(outsourcing_cost, 0) AS outsourcing_cost_kpy, COALESCE(material_cost, 0) AS material_cost_kpy,
  COALESCE(labor_cost, 0) AS labor_cost_kpy, COALESCE(expense_cost, 0) AS expense_cost_kpy,
  round({div('outsourcing_cost', 'total_cost')} * 100, 1) AS outsourcing_ratio,
  round({div('material_cost', 'total_cost')} * 100, 1) AS material_ratio,
  round({div('labor_cost', 'total_cost')} * 100, 1) AS labor_ratio,
  round({div('expense_cost', 'total_cost')} * 100, 1) AS expense_ratio,
  CASE WHEN {RATE} >= target_cost_rate + 5 THEN '緊急' WHEN {RATE} >= target_cost_rate THEN '警告'
    WHEN {RATE} >= target_cost_rate * 0.95::DOUBLE THEN '注意' ELSE '正常' END AS risk_level
FROM projects LEFT JOIN project_costs USING (project_id)
""",
)

BUDGET = """CASE category WHEN '外注費' THEN contract_amount_kpy * target_cost_rate / 100 * 0.45::DOUBLE
  WHEN '材料費' THEN contract_amount_kpy * target_cost_rate / 100 * 0.25::DOUBLE
  WHEN '労務費' THEN contract_amount_kpy * target_cost_rate / 100 * 0.2::DOUBLE
  WHEN '経費' THEN contract_amount_kpy * target_cost_rate / 100 * 0.1::DOUBLE ELSE 0.0::DOUBLE END"""

DEFINITIONS["category_detail"] = (
    "projects costs",
    f"""
SELECT project_id, project_name, division, category AS cost_category,
  CAST(round({BUDGET}) AS BIGINT) AS category_budget, CAST(sum(amount_kpy) AS BIGINT) AS category_actual,
  CAST(round({BUDGET} - sum(amount_kpy)) AS BIGINT) AS category_variance
FROM costs JOIN projects USING (project_id)
GROUP BY project_id, project_name, division, category, contract_amount_kpy, target_cost_rate
""",
)

DEFINITIONS["cashflow"] = (
    "cash_in costs",
    """
SELECT CAST(month_str || '-01' AS DATE) AS cf_date, month_str, expected_inflow_kpy, actual_inflow_kpy, total_outflow_kpy,
  confirmed_outflow_kpy, forecast_outflow_kpy, net_cashflow_kpy,
  CAST(COALESCE(sum(net_cashflow_kpy) OVER (ORDER BY month_str ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS beginning_balance_kpy,
  CAST(sum(net_cashflow_kpy) OVER (ORDER BY month_str) AS BIGINT) AS ending_balance_kpy,
  CASE WHEN sum(net_cashflow_kpy) OVER (ORDER BY month_str) < 0 THEN 1 ELSE 0 END AS min_cash_flag,
  CASE WHEN net_cashflow_kpy < -50000 THEN '資金不足リスク' WHEN net_cashflow_kpy < 0 THEN '注意' ELSE '正常' END AS cashflow_risk
FROM (
  SELECT month_str, COALESCE(ei, 0) AS expected_inflow_kpy, COALESCE(ai, 0) AS actual_inflow_kpy, COALESCE(o, 0) AS total_outflow_kpy,
    COALESCE(co, 0) AS confirmed_outflow_kpy, COALESCE(fo, 0) AS forecast_outflow_kpy, COALESCE(ei, 0) - COALESCE(o, 0) AS net_cashflow_kpy
  FROM (SELECT deposit_month AS month_str, CAST(sum(expected_amount_kpy) AS BIGINT) AS ei,
      CAST(sum(CASE WHEN status = '入金済' THEN COALESCE(actual_amount_kpy, expected_amount_kpy) ELSE 0 END) AS BIGINT) AS ai
    FROM cash_in GROUP BY 1) i
  FULL OUTER JOIN (SELECT payment_due_month AS month_str, CAST(sum(amount_kpy) AS BIGINT) AS o,
      CAST(sum(CASE WHEN status = '確定請求' THEN amount_kpy ELSE 0 END) AS BIGINT) AS co,
      CAST(sum(CASE WHEN status IN ('現場見込み', '口頭発注') THEN amount_kpy ELSE 0 END) AS BIGINT) AS fo
    FROM costs GROUP BY 1) o USING (month_str))
""",
)

DEFINITIONS["dashboard"] = (
    "projects costs cash_in properties facilities saas",
    """
SELECT sales_month, total_sales, actual_sales,
  CAST(round(CAST(sum(total_sales) OVER w AS DOUBLE) / NULLIF(count(total_sales) OVER w, 0)) AS BIGINT) AS forecast_sales,
  round(CAST(total_sales - total_cost AS DOUBLE) / NULLIF(total_sales, 0) * 100, 1) AS operating_profit_margin,
  active_project_count, CAST(sum(total_sales - total_cost) OVER (ORDER BY sales_month) AS BIGINT) AS cash_balance
FROM (
  SELECT i.sales_month, CAST(inflow + COALESCE(rent, 0) + COALESCE(facility, 0) + COALESCE(mrr, 0) AS BIGINT) AS total_sales,
    inflow AS actual_sales, CAST(COALESCE(outflow, 0) AS BIGINT) AS total_cost, COALESCE(active, 0) AS active_project_count
  FROM (SELECT CAST(deposit_month || '-01' AS DATE) AS sales_month, CAST(sum(expected_amount_kpy) AS BIGINT) AS inflow FROM cash_in GROUP BY 1) i
  LEFT JOIN (SELECT CAST(accrual_month || '-01' AS DATE) AS sales_month, sum(amount_kpy) AS outflow FROM costs GROUP BY 1) o USING (sales_month)
  LEFT JOIN (SELECT CAST(month || '-01' AS DATE) AS sales_month, sum(revenue_kpy) AS facility FROM facilities GROUP BY 1) f USING (sales_month)
  LEFT JOIN (SELECT CAST(month || '-01' AS DATE) AS sales_month, sum(mrr_kpy) AS mrr FROM saas GROUP BY 1) s USING (sales_month)
  LEFT JOIN (SELECT m.sales_month, count(DISTINCT project_id) AS active
    FROM (SELECT DISTINCT CAST(deposit_month || '-01' AS DATE) AS sales_month FROM cash_in) m
    JOIN projects p ON p.start_date <= m.sales_month AND p.end_date >= m.sales_month GROUP BY 1) a USING (sales_month)
  CROSS JOIN (SELECT sum(monthly_rental_income_kpy) AS rent FROM properties) r)
WINDOW w AS (ORDER BY sales_month ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING)
""",
)

DEFINITIONS["roi"] = (
    "projects properties facilities areas",
    """
SELECT area, construction_revenue_kpy, project_count, annual_rental_income_kpy, property_value_kpy, avg_occupancy_rate,
  facility_revenue_kpy, facility_profit_kpy, total_visitors, total_return_kpy, total_investment_kpy,
  round(CAST(total_return_kpy - total_investment_kpy AS DOUBLE) / NULLIF(total_investment_kpy, 0) * 100, 1) AS roi_rate,
  land_price_index, population, foot_traffic
FROM (
  SELECT area, CAST(COALESCE(construction, 0) AS BIGINT) AS construction_revenue_kpy, COALESCE(projects_n, 0) AS project_count,
    CAST(COALESCE(rent, 0) AS BIGINT) AS annual_rental_income_kpy, CAST(COALESCE(worth, 0) AS BIGINT) AS property_value_kpy,
    round(COALESCE(occupancy, 0), 6) AS avg_occupancy_rate, CAST(COALESCE(f_rev, 0) AS BIGINT) AS facility_revenue_kpy,
    CAST(COALESCE(f_profit, 0) AS BIGINT) AS facility_profit_kpy, CAST(COALESCE(visitors, 0) AS BIGINT) AS total_visitors,
    CAST(COALESCE(construction, 0) + COALESCE(rent, 0) + COALESCE(f_rev, 0) AS BIGINT) AS total_return_kpy,
    CAST(COALESCE(construction, 0) + COALESCE(acquisition, 0) AS BIGINT) AS total_investment_kpy,
    round(COALESCE(land, 0), 6) AS land_price_index, round(COALESCE(pop, 0), 6) AS population, round(COALESCE(foot, 0), 6) AS foot_traffic
  FROM (SELECT CASE WHEN project_name LIKE '%三島%' THEN '三島' WHEN project_name LIKE '%沼津%' THEN '沼津'
      WHEN project_name LIKE '%函南%' THEN '函南' WHEN project_name LIKE '%清水%' THEN '清水' WHEN project_name LIKE '%長泉%' THEN '長泉'
      WHEN project_name LIKE '%伊豆の国%' THEN '伊豆の国' WHEN project_name LIKE '%伊豆市%' THEN '伊豆' ELSE 'その他' END AS area,
      sum(contract_amount_kpy) AS construction, count(*) AS projects_n FROM projects GROUP BY 1)
  FULL OUTER JOIN (SELECT CASE WHEN location LIKE '%三島%' THEN '三島' WHEN location LIKE '%沼津%' THEN '沼津'
      WHEN location LIKE '%函南%' THEN '函南' ELSE 'その他' END AS area, sum(monthly_rental_income_kpy) * 12 AS rent,
      sum(acquisition_cost_kpy) AS acquisition, sum(current_value_kpy) AS worth, avg(occupancy_rate) AS occupancy FROM properties GROUP BY 1) USING (area)
  FULL OUTER JOIN (SELECT CASE WHEN facility_name LIKE '%函南%' OR facility_name LIKE '%伊豆%' THEN '函南'
      WHEN facility_name LIKE '%三島%' OR facility_name LIKE '%未来%' THEN '三島' WHEN facility_name LIKE '%沼津%' THEN '沼津' ELSE 'その他' END AS area,
      sum(revenue_kpy) AS f_rev, sum(operating_profit_kpy) AS f_profit, sum(visitors) AS visitors FROM facilities GROUP BY 1) USING (area)
  FULL OUTER JOIN (SELECT area_name AS area, avg(land_price_index) AS land, avg(population) AS pop, avg(foot_traffic) AS foot FROM areas GROUP BY 1) USING (area))
""",
)

DEFINITIONS["features"] = (
    "projects project_costs",
    f"""
SELECT project_id, {div('total_cost', 'contract_amount_kpy')} * 100 AS actual_cost_rate, division, client_type, contract_amount_kpy,
  CAST((year(end_date) - year(start_date)) * 12 + month(end_date) - month(start_date) AS BIGINT) AS duration_months,
  target_cost_rate, progress_rate, status AS project_status,
  {div('confirmed_cost', 'contract_amount_kpy')} * 100 AS confirmed_cost_rate,
  {div('forecast_cost', 'contract_amount_kpy')} * 100 AS forecast_cost_rate,
  {div('confirmed_cost', 'total_cost')} * 100 AS confirmed_ratio,
  {div('outsourcing_cost', 'total_cost')} * 100 AS outsourcing_pct, {div('material_cost', 'total_cost')} * 100 AS material_pct,
  {div('labor_cost', 'total_cost')} * 100 AS labor_pct, {div('expense_cost', 'total_cost')} * 100 AS expense_pct,
  {div(div('total_cost', 'contract_amount_kpy'), '(progress_rate / 100)')} AS cost_progress_ratio,
  record_count AS cost_record_count, confirmed_count, forecast_count
FROM projects JOIN project_costs USING (project_id)
""",
)
