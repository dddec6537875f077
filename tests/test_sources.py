import pytest
from pyspark.sql import functions as F

from girder import schemas
from girder.operators.controls import apply_controls
from girder.plans import views
from girder.sources import standins as src
from girder.sources.tables import load_tables, register_views, table_profile


@pytest.fixture(scope="module", params=["parquet", "csv"])
def base(request, spark, sf, tmp_path_factory):
    """The seven base tables on disk, as a user would have them."""
    folder = str(tmp_path_factory.mktemp(f"marts-{request.param}"))
    extra = {
        "cost_records": {
            "record_id": F.monotonically_increasing_id().cast("string"),
            "input_timestamp": F.lit("2024-01-01T00:00:00").cast("timestamp"),
            "confirmed_timestamp": F.lit(None).cast("timestamp"),
        }
    }
    for name, df in src.all_tables(spark, sf).items():
        schema = schemas.TABLES[name]
        df = df.withColumns(extra.get(name, {})).select(*[F.col(f.name).cast(f.dataType) for f in schema])
        writer = df.write.option("header", True) if request.param == "csv" else df.write
        getattr(writer, request.param)(f"{folder}/{name}.{request.param}")
    return load_tables(spark, folder, fmt=request.param)


def test_tables_keep_their_schema_and_rows(spark, sf, base):
    for name, df in base.items():
        assert [(f.name, f.dataType) for f in df.schema] == [(f.name, f.dataType) for f in schemas.TABLES[name]]
    stored = {r.table_name: r.row_count for r in table_profile(base).collect()}
    derived = {r.table_name: r.row_count for r in table_profile(src.all_tables(spark, sf)).collect()}
    assert stored == derived


def test_views_run_from_stored_tables(spark, base):
    projects, costs, cash_in = (base[n] for n in ("projects_master", "cost_records", "cash_in_schedules"))
    properties, facilities, saas, areas = (
        base[n] for n in ("real_estate_properties", "facility_operations", "saas_metrics", "area_indicators")
    )
    names = register_views(
        {
            "company_dashboard": views.company_dashboard(projects, costs, cash_in, properties, facilities, saas),
            "area_roi": lambda: views.area_roi(projects, properties, facilities, areas),
            "area_indicators": lambda: views.area_indicators(areas),
            "project_cost_summary": lambda: views.project_cost_summary(projects, costs),
            "cost_category_detail": lambda: views.cost_category_detail(projects, costs),
            "cashflow_forecast": lambda: views.cashflow_forecast(cash_in, costs),
            "ml_features": lambda: views.ml_features(projects, costs),
        }
    )
    assert len(names) == 7
    for name in names:
        assert spark.sql(f"SELECT count(*) AS n FROM {name}").first()["n"] > 0
    total = costs.agg(F.sum("amount_kpy")).first()[0]
    assert spark.sql("SELECT sum(category_actual) AS v FROM vw_cost_category_detail").first()["v"] == total
    assert spark.sql("SELECT sum(total_cost_kpy) AS v FROM vw_project_cost_summary").first()["v"] == total


def test_page_filters_and_columns_reach_the_scan(base):
    summary = views.project_cost_summary(base["projects_master"], base["cost_records"])
    chosen = apply_controls(summary, division="土木", pm_name=["NATION_1"]).select("project_id", "gross_profit")
    plan = chosen._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(division,土木)" in plan
    scans = [line for line in plan.splitlines() if "ReadSchema" in line]
    costs_scan = next(line for line in scans if "amount_kpy" in line)
    assert "vendor_name" not in costs_scan and "category" not in costs_scan.split("ReadSchema")[1]
