"""Model features of the cost-rate forecast, encoding and the train/test split."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import OneHotEncoder, StringIndexer, VectorAssembler
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from girder.functions.exprs import div_or_one, finite_or_zero, hash_number, month_span, safe_div
from girder.plans.views import CostTerms, project_costs

NUMERIC = (
    "contract_amount_kpy",
    "duration_months",
    "target_cost_rate",
    "progress_rate",
    "outsourcing_pct",
    "material_pct",
    "labor_pct",
    "expense_pct",
    "confirmed_ratio",
    "cost_progress_ratio",
)
CATEGORICAL = ("division", "client_type")


def cost_rate_features(
    projects: DataFrame,
    costs: DataFrame,
    confirmed: Sequence[str] = ("確定請求",),
    exclude_status: str = "計画",
) -> DataFrame:
    """Cost shares, cost rate on earned revenue, burn pace and the over-budget label.

    A project without cost, or without progress, divides by 1. Unknown and
    infinite figures become 0. Projects in ``exclude_status`` or without a status
    are left out.
    """
    totals = project_costs(costs, CostTerms(confirmed=tuple(confirmed)))
    joined = projects.filter(F.col("status") != exclude_status).join(totals, "project_id", "left")
    costs_filled = {c: F.coalesce(c, F.lit(0)) for c in totals.columns if c.endswith("_cost")}
    earned = F.col("contract_amount_kpy") * (F.col("progress_rate") / 100)
    progress = F.col("progress_rate") / 100

    def share(c: str) -> Column:
        return finite_or_zero(div_or_one(c, "total_cost"))

    rated = joined.withColumns(costs_filled).withColumn(
        "actual_cost_rate", finite_or_zero(div_or_one("total_cost", earned) * 100)
    )
    pace = safe_div("actual_cost_rate", "target_cost_rate") * progress
    return rated.select(
        "project_id",
        "project_name",
        *CATEGORICAL,
        F.col("status").alias("project_status"),
        finite_or_zero("contract_amount_kpy").alias("contract_amount_kpy"),
        finite_or_zero(month_span("end_date", "start_date")).alias("duration_months"),
        finite_or_zero("target_cost_rate").alias("target_cost_rate"),
        finite_or_zero("progress_rate").alias("progress_rate"),
        share("outsourcing_cost").alias("outsourcing_pct"),
        share("material_cost").alias("material_pct"),
        share("labor_cost").alias("labor_pct"),
        share("expense_cost").alias("expense_pct"),
        share("confirmed_cost").alias("confirmed_ratio"),
        finite_or_zero(pace).alias("cost_progress_ratio"),
        "actual_cost_rate",
        (F.col("actual_cost_rate") > F.col("target_cost_rate")).cast("int").alias("is_over_budget"),
    )


def encoder(numeric: Sequence[str] = NUMERIC, categorical: Sequence[str] = CATEGORICAL) -> Pipeline:
    """Numeric columns plus one-hot categories, the alphabetically first one dropped.

    Labels are indexed in descending order, so the last index, which the one-hot
    step drops, is the first label.
    """
    index = StringIndexer(
        inputCols=list(categorical),
        outputCols=[f"{c}_index" for c in categorical],
        stringOrderType="alphabetDesc",
    )
    one_hot = OneHotEncoder(
        inputCols=[f"{c}_index" for c in categorical],
        outputCols=[f"{c}_onehot" for c in categorical],
        dropLast=True,
    )
    assemble = VectorAssembler(
        inputCols=[*numeric, *[f"{c}_onehot" for c in categorical]], outputCol="features"
    )
    return Pipeline(stages=[index, one_hot, assemble])


def feature_names(fitted: PipelineModel, numeric: Sequence[str] = NUMERIC) -> list[str]:
    """Names of the positions of the assembled vector."""
    index = fitted.stages[0]
    names = list(numeric)
    for column, labels in zip(index.getInputCols(), index.labelsArray):
        names += [f"{column}_{label}" for label in labels[:-1]]
    return names


SPLIT_CELLS = 4096


def test_keys(df: DataFrame, label: str, test_pct: int = 20, key: str = "project_id", seed: int = 42) -> DataFrame:
    """Keys of the test rows: in each class the share ``test_pct`` with the smallest seeded hashes, rounded half up.

    Classes are counted by cells of the hash; only the one cell of a class that
    holds the cut is put in order, so no task sees a whole class.
    """
    draw = hash_number(key, seed)
    rows = df.select(F.col(key), F.col(label).alias("_class"), draw.alias("_draw"), F.floor(draw / (2**32 // SPLIT_CELLS)).alias("_cell"))
    cells = rows.groupBy("_class", "_cell").agg(F.count("*").alias("_in"))
    of_class = Window.partitionBy("_class")
    upto = F.sum("_in").over(of_class.orderBy("_cell"))
    wanted = F.floor((F.sum("_in").over(of_class) * test_pct + 50) / 100)
    room = cells.select(
        F.col("_class").alias("_of"), F.col("_cell").alias("_at"), "_in", (wanted - upto + F.col("_in")).alias("_room")
    ).filter(F.col("_room") > 0)
    placed = rows.join(room, F.col("_class").eqNullSafe(F.col("_of")) & (F.col("_cell") == F.col("_at")))
    whole = placed.filter(F.col("_room") >= F.col("_in")).select(key)
    cut = placed.filter(F.col("_room") < F.col("_in"))
    order = F.row_number().over(Window.partitionBy("_class", "_cell").orderBy("_draw", key))
    return whole.unionByName(cut.withColumn("_place", order).filter(F.col("_place") <= F.col("_room")).select(key))


def split(
    df: DataFrame, test_pct: int = 20, key: str = "project_id", seed: int = 42, label: str = "is_over_budget"
) -> tuple[DataFrame, DataFrame]:
    """Train and test rows, each class divided in the same proportion by a seeded hash of the key.

    Rows keep their side however the data is partitioned.
    """
    tested = test_keys(df, label, test_pct, key, seed)
    return df.join(tested, key, "left_anti"), df.join(tested, key, "left_semi")


def class_balance(df: DataFrame, label: str = "is_over_budget", key: str = "project_id", test_pct: int = 20, seed: int = 42) -> DataFrame:
    """Rows per class and side of the split."""
    train, test = split(df, test_pct, key, seed, label)
    sides = train.withColumn("side", F.lit("train")).unionByName(test.withColumn("side", F.lit("test")))
    return sides.groupBy(label, "side").agg(F.count("*").alias("row_count"))
