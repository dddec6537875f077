"""The seven views over the stand-in tables."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from catalog.registry import query
from girder.plans import views
from girder.sources import standins as src


@query("SELECT * FROM dashboard", "dashboard")
def company_dashboard(spark: SparkSession, sf: str) -> DataFrame:
    return dashboard(spark, sf)


def dashboard(spark: SparkSession, sf: str, **options) -> DataFrame:
    return views.company_dashboard(
        src.projects(spark, sf, ("project_id", "start_date", "end_date")),
        src.cost_records(spark, sf, ("amount_kpy", "accrual_month", "payment_due_month")),
        src.cash_in(spark, sf),
        src.properties(spark, sf),
        src.facilities(spark, sf),
        src.saas(spark, sf),
        **options,
    )


def roi(spark: SparkSession, sf: str) -> DataFrame:
    return views.area_roi(
        src.projects(spark, sf, ("project_name", "contract_amount_kpy")),
        src.properties(spark, sf),
        src.facilities(spark, sf),
        src.areas(spark, sf),
    )


@query("SELECT * FROM roi", "roi")
def area_roi(spark: SparkSession, sf: str) -> DataFrame:
    means = ("avg_occupancy_rate", "land_price_index", "population", "foot_traffic")
    return roi(spark, sf).withColumns({c: F.round(c, 6) for c in means})


@query(
    """SELECT area_name, CAST(month || '-01' AS DATE) AS indicator_month, land_price_index, population, foot_traffic,
  new_business_count, event_count FROM areas""",
    "areas",
)
def area_indicators(spark: SparkSession, sf: str) -> DataFrame:
    return views.area_indicators(src.areas(spark, sf))


def cost_summary(spark: SparkSession, sf: str) -> DataFrame:
    return views.project_cost_summary(
        src.projects(spark, sf), src.cost_records(spark, sf, ("project_id", "category", "amount_kpy", "status"))
    )


@query("SELECT * FROM cost_summary", "cost_summary")
def project_cost_summary(spark: SparkSession, sf: str) -> DataFrame:
    return cost_summary(spark, sf)


def category_detail(spark: SparkSession, sf: str) -> DataFrame:
    return views.cost_category_detail(
        src.projects(
            spark, sf, ("project_id", "project_name", "division", "contract_amount_kpy", "target_cost_rate")
        ),
        src.cost_records(spark, sf, ("project_id", "category", "amount_kpy")),
    )


@query("SELECT * FROM category_detail", "category_detail")
def cost_category_detail(spark: SparkSession, sf: str) -> DataFrame:
    return category_detail(spark, sf)


def cashflow(spark: SparkSession, sf: str) -> DataFrame:
    return views.cashflow_forecast(
        src.cash_in(spark, sf), src.cost_records(spark, sf, ("amount_kpy", "status", "payment_due_month"))
    )


@query("SELECT * FROM cashflow", "cashflow")
def cashflow_forecast(spark: SparkSession, sf: str) -> DataFrame:
    return cashflow(spark, sf)


@query("SELECT * FROM features", "features")
def project_features(spark: SparkSession, sf: str) -> DataFrame:
    return views.ml_features(
        src.projects(
            spark,
            sf,
            (
                "project_id",
                "division",
                "client_type",
                "contract_amount_kpy",
                "start_date",
                "end_date",
                "target_cost_rate",
                "progress_rate",
                "status",
            ),
        ),
        src.cost_records(spark, sf, ("project_id", "category", "amount_kpy", "status")),
    )
