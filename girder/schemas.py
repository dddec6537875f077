"""Schemas of the seven base tables. Money columns (``_kpy``) are whole units."""

from __future__ import annotations

from pyspark.sql import types as T


def _schema(*fields: tuple[str, T.DataType] | tuple[str, T.DataType, bool]) -> T.StructType:
    return T.StructType([T.StructField(f[0], f[1], f[2] if len(f) > 2 else False) for f in fields])


S, L, D = T.StringType(), T.LongType(), T.DoubleType()
DATE, TS = T.DateType(), T.TimestampType()

PROJECTS = _schema(
    ("project_id", S),
    ("project_name", S),
    ("division", S),
    ("client_type", S),
    ("contract_amount_kpy", L),
    ("start_date", DATE),
    ("end_date", DATE),
    ("target_cost_rate", D),
    ("progress_rate", D),
    ("status", S),
    ("pm_name", S),
)

COST_RECORDS = _schema(
    ("record_id", S),
    ("project_id", S),
    ("category", S),
    ("amount_kpy", L),
    ("status", S),
    ("accrual_month", S),
    ("payment_due_month", S),
    ("input_timestamp", TS),
    ("confirmed_timestamp", TS, True),
    ("vendor_name", S),
)

CASH_IN = _schema(
    ("schedule_id", S),
    ("project_id", S),
    ("milestone", S),
    ("expected_amount_kpy", L),
    ("actual_amount_kpy", L, True),
    ("deposit_month", S),
    ("actual_deposit_date", DATE, True),
    ("status", S),
)

PROPERTIES = _schema(
    ("property_id", S),
    ("property_name", S),
    ("property_type", S),
    ("location", S),
    ("acquisition_date", DATE),
    ("acquisition_cost_kpy", L),
    ("current_value_kpy", L),
    ("monthly_rental_income_kpy", L),
    ("occupancy_rate", D),
)

FACILITIES = _schema(
    ("facility_id", S),
    ("facility_name", S),
    ("month", S),
    ("visitors", L),
    ("revenue_kpy", L),
    ("operating_cost_kpy", L),
    ("operating_profit_kpy", L),
)

SAAS = _schema(
    ("month", S),
    ("product", S),
    ("mrr_kpy", L),
    ("customers", L),
    ("churn_rate_pct", D),
    ("new_customers", L),
    ("expansion_mrr_kpy", L),
)

AREAS = _schema(
    ("area_name", S),
    ("month", S),
    ("land_price_index", D),
    ("population", L),
    ("foot_traffic", L),
    ("new_business_count", L),
    ("event_count", L),
)

TABLES = {
    "projects_master": PROJECTS,
    "cost_records": COST_RECORDS,
    "cash_in_schedules": CASH_IN,
    "real_estate_properties": PROPERTIES,
    "facility_operations": FACILITIES,
    "saas_metrics": SAAS,
    "area_indicators": AREAS,
}
