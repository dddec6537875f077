"""Model features, fitted models, anomalies and forecasts over the stand-in tables."""

from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from catalog.cash import CASH, cash_frame
from catalog.registry import query
from girder.models import arima, attribution, boosted, features, forest, newton
from girder.operators.timeline import active_projects, month_axis, on_axis
from girder.plans import cash, documents
from girder.plans.operations import season_index
from girder.session import scratch_path, settle
from girder.sources import sinks
from girder.sources import standins as src

COST_RATE = """m AS (SELECT p.*, COALESCE(total_cost, 0) AS total, COALESCE(confirmed_cost, 0) AS confirmed, COALESCE(outsourcing_cost, 0) AS o,
    COALESCE(material_cost, 0) AS mt, COALESCE(labor_cost, 0) AS l, COALESCE(expense_cost, 0) AS x
  FROM projects p LEFT JOIN project_costs USING (project_id) WHERE status <> '計画'),
n AS (SELECT *, CASE WHEN total > 0 THEN total ELSE 1 END AS safe,
  CAST(total AS DOUBLE) / CASE WHEN contract_amount_kpy * (progress_rate / 100) > 0 THEN contract_amount_kpy * (progress_rate / 100) ELSE 1 END * 100 AS actual_cost_rate FROM m),
model_features AS (SELECT project_id, project_name, division, client_type, status AS project_status, CAST(contract_amount_kpy AS DOUBLE) AS contract_amount_kpy,
  (end_date - start_date) / 30.44::DOUBLE AS duration_months, target_cost_rate, progress_rate, CAST(o AS DOUBLE) / safe AS outsourcing_pct,
  CAST(mt AS DOUBLE) / safe AS material_pct, CAST(l AS DOUBLE) / safe AS labor_pct, CAST(x AS DOUBLE) / safe AS expense_pct,
  CAST(confirmed AS DOUBLE) / safe AS confirmed_ratio, actual_cost_rate / target_cost_rate * (progress_rate / 100) AS cost_progress_ratio,
  actual_cost_rate, CAST(actual_cost_rate > target_cost_rate AS INTEGER) AS is_over_budget FROM n)"""
USES = "projects project_costs"
PLACED = """SELECT project_id, is_over_budget, count(*) OVER (PARTITION BY is_over_budget) AS of_class,
  row_number() OVER (PARTITION BY is_over_budget ORDER BY ('0x' || substr(md5(project_id || '-42'), 1, 8))::BIGINT, project_id) AS place FROM model_features"""
TESTED = "place <= (of_class * 20 + 50) // 100"


_fitted: dict[tuple, object] = {}  # what the queries of one session share


def model_rows(spark: SparkSession, sf: str) -> DataFrame:
    return features.cost_rate_features(
        src.projects(spark, sf), src.cost_records(spark, sf, ("project_id", "category", "amount_kpy", "status"))
    )


def settled_rows(spark: SparkSession, sf: str) -> DataFrame:
    """The feature rows, written once for a session: a split, a fit and a judgement each read them several times."""
    key = ("rows", spark.sparkContext.applicationId, sf)
    if key not in _fitted:
        _fitted[key] = settle(model_rows(spark, sf))
    return _fitted[key]


def settled_split(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Train and test rows, placed and written once for a session; the train rows are those that are not among the test rows."""
    key = ("split", spark.sparkContext.applicationId, sf)
    if key not in _fitted:
        rows = settled_rows(spark, sf)
        test = settle(features.split(rows)[1])
        _fitted[key] = settle(rows.join(test.select("project_id"), "project_id", "left_anti")), test
    return _fitted[key]


@query("SELECT * FROM model_features", USES, COST_RATE)
def cost_rate_features(spark: SparkSession, sf: str) -> DataFrame:
    return model_rows(spark, sf)


@query(
    """SELECT project_id, CAST(division = '建築' AS INTEGER)::DOUBLE AS "division_建築", CAST(client_type = '民間' AS INTEGER)::DOUBLE AS "client_type_民間" FROM model_features""",
    USES,
    COST_RATE,
)
def one_hot_columns(spark: SparkSession, sf: str) -> DataFrame:
    rows = model_rows(spark, sf)
    fitted = features.encoder().fit(rows)
    names = features.feature_names(fitted)
    values = vector_to_array("features")
    tail = range(len(features.NUMERIC), len(names))
    return fitted.transform(rows).select("project_id", *[values[i].alias(names[i]) for i in tail])


@query(
    f"""SELECT is_over_budget, CASE WHEN {TESTED} THEN 'test' ELSE 'train' END AS side, count(*) AS row_count FROM ({PLACED}) GROUP BY ALL""",
    USES,
    COST_RATE,
)
def split_balance(spark: SparkSession, sf: str) -> DataFrame:
    return features.class_balance(model_rows(spark, sf))


@query(f"SELECT project_id FROM ({PLACED}) WHERE {TESTED}", USES, COST_RATE)
def test_split(spark: SparkSession, sf: str) -> DataFrame:
    return features.split(model_rows(spark, sf))[1].select("project_id")


# A rule of thumb stands in for a fitted model where the metric formulas and the
# risk score themselves are checked against SQL.
NAIVE = (
    COST_RATE
    + """,
naive AS (SELECT *, target_cost_rate * 1.05::DOUBLE AS predicted_cost_rate, CAST(progress_rate > 50 AS INTEGER) AS predicted_over_budget,
  progress_rate / 100 AS over_budget_prob FROM model_features)"""
)


def naive_predictions(spark: SparkSession, sf: str) -> DataFrame:
    return model_rows(spark, sf).withColumns(
        {
            "predicted_cost_rate": F.col("target_cost_rate") * 1.05,
            "predicted_over_budget": (F.col("progress_rate") > 50).cast("int"),
            "over_budget_prob": F.col("progress_rate") / 100,
        }
    )


@query(
    """SELECT round(log10(sqrt(avg((actual_cost_rate - predicted_cost_rate) ** 2))), 6) AS log_rmse, round(log10(avg(abs(actual_cost_rate - predicted_cost_rate))), 6) AS log_mae,
  round(avg(abs((actual_cost_rate - predicted_cost_rate) / CASE WHEN actual_cost_rate <> 0 THEN actual_cost_rate ELSE 1 END)) * 100, 6) AS mape, count(*) AS row_count FROM naive""",
    USES,
    NAIVE,
)
def regression_metric_formulas(spark: SparkSession, sf: str) -> DataFrame:
    """The metrics on a naive forecast; the large ones on a log scale to compare them."""
    return boosted.regression_metrics(naive_predictions(spark, sf)).select(
        F.round(F.log10("rmse"), 6).alias("log_rmse"),
        F.round(F.log10("mae"), 6).alias("log_mae"),
        F.round("mape", 6).alias("mape"),
        "row_count",
    )


@query(
    """SELECT *, CAST(true_positive + true_negative AS DOUBLE) / (true_negative + false_positive + false_negative + true_positive) AS accuracy,
  COALESCE(CAST(true_positive AS DOUBLE) / NULLIF(true_positive + false_positive, 0), 0) AS precision,
  COALESCE(CAST(true_positive AS DOUBLE) / NULLIF(true_positive + false_negative, 0), 0) AS recall,
  COALESCE(CAST(2 * true_positive AS DOUBLE) / NULLIF(2 * true_positive + false_positive + false_negative, 0), 0) AS f1 FROM (
  SELECT count(CASE WHEN is_over_budget = 0 AND predicted_over_budget = 0 THEN 1 END) AS true_negative, count(CASE WHEN is_over_budget = 0 AND predicted_over_budget = 1 THEN 1 END) AS false_positive,
    count(CASE WHEN is_over_budget = 1 AND predicted_over_budget = 0 THEN 1 END) AS false_negative, count(CASE WHEN is_over_budget = 1 AND predicted_over_budget = 1 THEN 1 END) AS true_positive FROM naive)""",
    USES,
    NAIVE,
)
def classification_metric_formulas(spark: SparkSession, sf: str) -> DataFrame:
    return boosted.classification_metrics(naive_predictions(spark, sf))


@query(
    """SELECT project_id, round(risk_score, 6) AS risk_score, CASE WHEN risk_score >= 75 THEN '🔴 高リスク' WHEN risk_score >= 40 THEN '🟠 中リスク' ELSE '🟢 低リスク' END AS risk_level
FROM (SELECT project_id, (over_budget_prob * 0.7::DOUBLE + greatest(0.0::DOUBLE, least((predicted_cost_rate - target_cost_rate) / target_cost_rate, 0.2::DOUBLE)) * 5 * 0.3::DOUBLE) * 100 AS risk_score FROM naive)""",
    USES,
    NAIVE,
)
def risk_score_formula(spark: SparkSession, sf: str) -> DataFrame:
    scored = boosted.risk_scores(naive_predictions(spark, sf))
    return scored.select("project_id", F.round("risk_score", 6).alias("risk_score"), "risk_level")


# --- fitted models ---------------------------------------------------------
# A fit takes far longer than anything read off it, so the queries of one
# session share the models of one folder.

def fitted(kind: str, spark: SparkSession, sf: str):
    key = (kind, spark.sparkContext.applicationId, sf)
    if key not in _fitted:
        train, test = settled_split(spark, sf)
        if kind == "rmse":
            held_out = fitted("reg", spark, sf).transform(test)
            _fitted[key] = boosted.regression_metrics(held_out).first()["rmse"]
        else:
            _fitted[key] = boosted.fit(train, boosted.regressor() if kind == "reg" else boosted.classifier())
    return _fitted[key]


def scored_projects(spark: SparkSession, sf: str) -> DataFrame:
    keys = [(k, spark.sparkContext.applicationId, sf) for k in ("reg", "clf")]
    if not any(k in _fitted for k in keys):  # side by side, unless one is there already
        train, _ = settled_split(spark, sf)
        _fitted.update(zip(keys, boosted.fit_all(train, boosted.regressor(), boosted.classifier())))
    reg, clf, rmse = (fitted(k, spark, sf) for k in ("reg", "clf", "rmse"))
    return boosted.score(settled_rows(spark, sf), reg, clf, rmse)


@query()
def cost_rate_model_metrics(spark: SparkSession, sf: str) -> DataFrame:
    _, test = settled_split(spark, sf)
    return boosted.regression_metrics(fitted("reg", spark, sf).transform(test))


@query()
def cost_rate_cross_validation(spark: SparkSession, sf: str) -> DataFrame:
    key = ("folds", spark.sparkContext.applicationId, sf)
    if key not in _fitted:
        train, _ = settled_split(spark, sf)
        _fitted[key] = boosted.cross_validate(train, boosted.regressor())
    return _fitted[key]


@query()
def over_budget_model_metrics(spark: SparkSession, sf: str) -> DataFrame:
    _, test = settled_split(spark, sf)
    return boosted.classification_metrics(fitted("clf", spark, sf).transform(test))


@query()
def cost_rate_feature_importance(spark: SparkSession, sf: str) -> DataFrame:
    return boosted.feature_importance(fitted("reg", spark, sf), spark).limit(10)


@query()
def over_budget_probability_histogram(spark: SparkSession, sf: str) -> DataFrame:
    _, test = settled_split(spark, sf)
    clf = fitted("clf", spark, sf)
    scored = clf.transform(test).withColumn("over_budget_prob", vector_to_array("over_budget_vector")[1])
    return boosted.probability_histogram(settle(scored.select("over_budget_prob", "is_over_budget")))


@query()
def project_risk_ranking(spark: SparkSession, sf: str) -> DataFrame:
    """Scored once: the sort reads its rows twice, for the bounds of its ranges and to deal them out."""
    return boosted.result_table(settle(scored_projects(spark, sf).select(*boosted.RESULT_COLUMNS)))


@query()
def top_risk_projects(spark: SparkSession, sf: str) -> DataFrame:
    return boosted.result_table(scored_projects(spark, sf), rows=20)


def attributed(spark: SparkSession, sf: str) -> tuple[DataFrame, list[str]]:
    reg = fitted("reg", spark, sf)
    names = features.feature_names(reg)
    return attribution.contributions(reg.transform(settled_rows(spark, sf)), reg, names), names


@query()
def mean_feature_contributions(spark: SparkSession, sf: str) -> DataFrame:
    rows, names = attributed(spark, sf)
    return attribution.mean_contributions(rows, names)


PREDICTED_AT = f"{src.AS_OF}T09:00:00+09:00"


@query()
def prediction_documents(spark: SparkSession, sf: str) -> DataFrame:
    scored = scored_projects(spark, sf)  # first, so that both models are fitted side by side
    rows, names = attributed(spark, sf)
    factors = attribution.top_factors(rows, names)
    return documents.prediction_documents(scored, factors, PREDICTED_AT)


@query()
def nightly_active_scores(spark: SparkSession, sf: str) -> DataFrame:
    """Trained on finished projects, scored on running ones, written by day and read back."""
    return nightly_scores(spark, sf)[0]


def nightly_scores(spark: SparkSession, sf: str) -> tuple[DataFrame, float]:
    """The day's partition of the score table, and the error that its intervals are made of."""
    rows = settled_rows(spark, sf)
    key = ("nightly", spark.sparkContext.applicationId, sf)
    if key not in _fitted:
        train, test = features.split(rows.filter(F.col("project_status") == "完了"))
        reg, clf = boosted.fit_all(train, boosted.regressor(), boosted.classifier())
        _fitted[key] = reg, clf, boosted.regression_metrics(reg.transform(test)).first()["rmse"]
    reg, clf, rmse = _fitted[key]
    scored = boosted.score(rows.filter(F.col("project_status") == "進行中"), reg, clf, rmse)
    path = scratch_path(spark, "nightly-scores")
    day = F.lit(src.AS_OF).cast("date")
    result = scored.select(*boosted.RESULT_COLUMNS, "over_budget_prob", day.cast("timestamp_ntz").alias("scored_at"), day.alias("as_of"))
    sinks.write_table(result, path, ["as_of"])
    return spark.read.parquet(path).filter(F.col("as_of") == day), rmse


def score_violations(scored: DataFrame, rmse: float) -> DataFrame:
    """Rows, and how many of them break the rules of a score row."""
    close = lambda a, b: F.abs(a - b) <= 1e-9 * (1 + F.abs(b))
    low, high, mid = (F.col(c) for c in ("prediction_interval_lower", "prediction_interval_upper", "predicted_cost_rate"))
    excess = F.greatest(F.lit(0.0), F.least((mid - F.col("target_cost_rate")) / F.col("target_cost_rate"), F.lit(0.2))) * 5
    score = F.col("risk_score")
    level = F.when(score >= 75, "🔴 高リスク").when(score >= 40, "🟠 中リスク").otherwise("🟢 低リスク")
    rules = {
        "interval": close(high, mid + 1.96 * rmse) & close(low, mid - 1.96 * rmse),
        "probability": F.col("over_budget_prob").between(0, 1),
        "score": close(score, (F.col("over_budget_prob") * 0.7 + excess * 0.3) * 100) & score.between(0, 100),
        "level": F.col("risk_level") == level,
    }
    broken = [F.count_if(~F.coalesce(rule, F.lit(False))).alias(f"{name}_violations") for name, rule in rules.items()]
    return scored.agg(F.count("*").alias("row_count"), F.count_distinct("project_id").alias("projects"), *broken)


SCORE_RULES = """SELECT count(*) AS row_count, count(DISTINCT project_id) AS projects, 0::BIGINT AS interval_violations, 0::BIGINT AS probability_violations,
  0::BIGINT AS score_violations, 0::BIGINT AS level_violations FROM model_features"""


@query(SCORE_RULES + " WHERE project_status = '進行中'", USES, COST_RATE)
def nightly_score_rules(spark: SparkSession, sf: str) -> DataFrame:
    """Every running project has one score row, and each row keeps the rules."""
    return score_violations(*nightly_scores(spark, sf))


@query(SCORE_RULES, USES, COST_RATE)
def risk_score_rules(spark: SparkSession, sf: str) -> DataFrame:
    """The same for all projects with the models fitted on the training rows."""
    return score_violations(scored_projects(spark, sf), fitted("rmse", spark, sf))


def contribution_violations(rows: DataFrame, width: int) -> DataFrame:
    """Rows, and how many of them break the rules of Shapley values.

    The sum is compared relative to the size of its terms, which may cancel.
    """
    total = F.aggregate("contributions", F.col("base_value"), lambda a, c: a + c)
    size = F.aggregate("contributions", F.abs("base_value"), lambda a, c: a + F.abs(c))
    rules = {
        "sum": F.abs(total - F.col("predicted_cost_rate")) <= 1e-9 * (1 + size),
        "width": F.size("contributions") == width,
    }
    broken = [F.count_if(~F.coalesce(rule, F.lit(False))).alias(f"{name}_violations") for name, rule in rules.items()]
    return rows.agg(F.count("*").alias("row_count"), *broken)


@query(
    "SELECT count(*) AS row_count, 0::BIGINT AS sum_violations, 0::BIGINT AS width_violations FROM model_features",
    USES,
    COST_RATE,
)
def contribution_rules(spark: SparkSession, sf: str) -> DataFrame:
    """A row's Shapley values and the base value add up to its prediction, one for each feature."""
    rows, names = attributed(spark, sf)
    return contribution_violations(rows, len(names))


# What must hold for every row of a fitted result: counts from the SQL side, broken rules, of which there are none.


def broken(**rules) -> list:
    return [F.count_if(~F.coalesce(rule, F.lit(False))).alias(f"{name}_violations") for name, rule in rules.items()]


TEST_ROWS = f"SELECT *, {TESTED} AS tested FROM ({PLACED.replace('SELECT ', 'SELECT actual_cost_rate, ', 1)})"


@query(
    f"SELECT count(*) AS row_count, 0::BIGINT AS mean_violations, 0::BIGINT AS order_violations FROM ({TEST_ROWS}) WHERE tested",
    USES,
    COST_RATE,
)
def cost_rate_metric_rules(spark: SparkSession, sf: str) -> DataFrame:
    """The test rows are judged, better than by the mean of the training rows, and MAE is not above RMSE."""
    train, test = settled_split(spark, sf)
    mean = train.agg(F.avg(boosted.TARGET)).first()[0]
    plain = boosted.regression_metrics(test.withColumn("predicted_cost_rate", F.lit(mean))).select(F.col("rmse").alias("plain_rmse"))
    found = cost_rate_model_metrics(spark, sf).select("*", plain.scalar().alias("plain_rmse"))
    return found.groupBy("row_count").agg(*broken(mean=F.col("rmse") <= F.col("plain_rmse"), order=F.col("mae") <= F.col("rmse")))


@query(
    f"""SELECT count(*) AS row_count, CAST(sum(is_over_budget) AS BIGINT) AS over_budget, 0::BIGINT AS majority_violations, 0::BIGINT AS range_violations
FROM ({TEST_ROWS}) WHERE tested""",
    USES,
    COST_RATE,
)
def over_budget_metric_rules(spark: SparkSession, sf: str) -> DataFrame:
    """The confusion matrix holds every test row once, and accuracy is not below always naming the larger class."""
    m = over_budget_model_metrics(spark, sf)
    over = F.col("true_positive") + F.col("false_negative")
    rows = over + F.col("true_negative") + F.col("false_positive")
    larger = F.greatest(over, rows - over) / rows
    ranged = F.least("precision", "recall", "f1") >= 0
    ranged = ranged & (F.greatest("precision", "recall", "f1") <= 1)
    return m.groupBy(rows.alias("row_count"), over.alias("over_budget")).agg(*broken(majority=F.col("accuracy") >= larger, range=ranged))


@query(
    f"SELECT count(*) AS row_count, 0::BIGINT AS loss_violations, 0::BIGINT AS range_violations FROM ({TEST_ROWS}) WHERE tested",
    USES,
    COST_RATE,
)
def second_order_model_rules(spark: SparkSession, sf: str) -> DataFrame:
    """Trees by gradient and curvature judge the test rows, with a lower log loss than the share of the training rows."""
    train, test = settled_split(spark, sf)
    settings = newton.Settings(iterations=10, step=0.3, depth=3, loss="logistic")
    model = newton.fit(train, list(features.NUMERIC), boosted.LABEL, settings)
    share = train.agg(F.avg(boosted.LABEL)).first()[0]
    label = F.col(boosted.LABEL)
    lost = lambda p: F.avg(-(label * F.log(p) + (1 - label) * F.log(1 - p)))
    judged = newton.predict(test, model, "p").agg(
        F.count("*").alias("row_count"), lost(F.col("p")).alias("loss"), lost(F.lit(share)).alias("plain"), *broken(range=F.col("p").between(0, 1))
    )
    return judged.groupBy("row_count", "range_violations").agg(*broken(loss=F.col("loss") <= F.col("plain"))).select("row_count", "loss_violations", "range_violations")


@query("SELECT 5::BIGINT AS row_count, 5::BIGINT AS folds, 0::BIGINT AS mean_violations, 0::BIGINT AS spread_violations, 0::BIGINT AS rmse_violations")
def cross_validation_rules(spark: SparkSession, sf: str) -> DataFrame:
    """Five folds, whose mean and deviation stand beside them."""
    folds = cost_rate_cross_validation(spark, sf)
    own = folds.agg(F.avg("rmse").alias("m"), F.stddev_pop("rmse").alias("s"))
    close = lambda a, b: F.abs(F.col(a) - F.col(b)) <= 1e-9 * (1 + F.abs(F.col(b)))
    rows = folds.select("*", own.select("m").scalar().alias("m"), own.select("s").scalar().alias("s"))
    rules = broken(mean=close("mean_rmse", "m"), spread=close("std_rmse", "s"), rmse=F.col("rmse") > 0)
    return rows.agg(F.count("*").alias("row_count"), F.count_distinct("fold").alias("folds"), *rules)


@query("SELECT 10::BIGINT AS row_count, 0::BIGINT AS order_violations, 0::BIGINT AS range_violations, 0::BIGINT AS total_violations")
def feature_importance_rules(spark: SparkSession, sf: str) -> DataFrame:
    """Ten features by falling importance; those of all features are shares of one."""
    every = boosted.feature_importance(fitted("reg", spark, sf), spark).agg(F.sum("importance"))
    listed = cost_rate_feature_importance(spark, sf).select("*", F.monotonically_increasing_id().alias("place"), every.scalar().alias("every"))
    before = F.lag("importance").over(Window.orderBy("place"))
    rows = listed.withColumn("before", before)
    rules = broken(
        order=F.col("before").isNull() | (F.col("importance") <= F.col("before")),
        range=F.col("importance").between(0, 1),
        total=F.abs(F.col("every") - 1) < 1e-9,
    )
    return rows.agg(F.count("*").alias("row_count"), *rules)


def order_violations(ranking: DataFrame, score: str) -> DataFrame:
    """Rows of a ranking, and how many have a higher score than the row before.

    A row is compared within its partition, the first of one with the last of
    the partition before, so no task sees the whole ranking.
    """
    placed = settle(ranking.select(F.col(score).alias("score"), F.monotonically_increasing_id().alias("place")))
    placed = placed.withColumn("part", F.shiftright("place", 33))
    ends = placed.groupBy("part").agg(F.max_by("score", "place").alias("end"))
    ends = ends.select("part", F.lag("end").over(Window.orderBy("part")).alias("end"))
    before = F.lag(F.struct("score")).over(Window.partitionBy("part").orderBy("place"))
    rows = placed.withColumn("row_before", before).join(F.broadcast(ends), "part")
    rows = rows.withColumn("before", F.when(F.col("row_before").isNull(), F.col("end")).otherwise(F.col("row_before")["score"]))
    return rows.agg(F.count("*").alias("ranked"), *broken(order=F.col("before").isNull() | (F.col("score") <= F.col("before"))))


@query(
    """SELECT least(count(*), 20) AS row_count, count(*) AS ranked, 0::BIGINT AS order_violations, 0::BIGINT AS better_left_out FROM model_features""",
    USES,
    COST_RATE,
)
def top_risk_rules(spark: SparkSession, sf: str) -> DataFrame:
    """The ranking holds every project by falling score; the twenty listed are its first."""
    scored = settle(scored_projects(spark, sf).select(*boosted.RESULT_COLUMNS))
    order = order_violations(boosted.result_table(scored), "risk_score")
    top = boosted.result_table(scored, rows=20)
    last = top.agg(F.min(F.struct("risk_score", (-F.col("project_id")).alias("p"))))
    better = scored.join(top, "project_id", "left_anti").filter(F.struct("risk_score", (-F.col("project_id")).alias("p")) > last.scalar())
    return order.select(top.agg(F.count("*")).scalar().alias("row_count"), "*", better.agg(F.count("*")).scalar().alias("better_left_out"))


@query(
    f"""SELECT CAST(sum(CASE WHEN tested THEN 1 ELSE 0 END) AS BIGINT) AS row_count, count(DISTINCT CASE WHEN tested THEN is_over_budget END) AS classes,
  0::BIGINT AS bin_violations FROM ({TEST_ROWS})""",
    USES,
    COST_RATE,
)
def probability_histogram_rules(spark: SparkSession, sf: str) -> DataFrame:
    """Every test row is in one of the fifteen bins of its class."""
    bins = over_budget_probability_histogram(spark, sf)
    number = next(c for c in bins.columns if c.startswith("bin") and dict(bins.dtypes)[c] in ("int", "bigint"))
    return bins.agg(
        F.sum("row_count").alias("row_count"),
        F.count_distinct(boosted.LABEL).alias("classes"),
        *broken(bin=F.col(number).between(0, 15) & (F.col("row_count") >= 0)),
    )


@query(
    """SELECT count(*) AS row_count, 0::BIGINT AS json_violations, 0::BIGINT AS interval_violations, 0::BIGINT AS factor_violations, 0::BIGINT AS time_violations FROM model_features""",
    USES,
    COST_RATE,
)
def prediction_document_rules(spark: SparkSession, sf: str) -> DataFrame:
    """A document for every project: its own id, an interval around the forecast, up to three raising factors, the time."""
    schema = """project_id long, predicted_final_cost_rate double, prediction_interval_lower double, prediction_interval_upper double, risk_score double,
      risk_level string, top_risk_factors array<struct<factor: string, contribution: double>>, prediction_timestamp string"""
    rows = prediction_documents(spark, sf).withColumn("d", F.from_json("document", schema))
    d = F.col("d")
    factors = F.coalesce(d["top_risk_factors"], F.array())
    rules = broken(
        json=(d["project_id"] == F.col("project_id")) & d["risk_score"].between(0, 100) & d["risk_level"].isNotNull(),
        interval=d["predicted_final_cost_rate"].between(d["prediction_interval_lower"], d["prediction_interval_upper"]),
        factor=(F.size(factors) <= 3) & F.forall(factors, lambda f: (f["contribution"] >= 0) & (f["contribution"] <= 1)),
        time=d["prediction_timestamp"] == PREDICTED_AT,
    )
    return rows.agg(F.count("*").alias("row_count"), *rules)


# --- anomalies and forecasts -----------------------------------------------


def company_anomalies(spark: SparkSession, sf: str) -> DataFrame:
    return forest.detect(cash.cash_features(cash_frame(spark, sf)), ["month"], cash.CASH_FEATURES)


@query()
def cash_anomalies(spark: SparkSession, sf: str) -> DataFrame:
    return company_anomalies(spark, sf)


@query("SELECT count(*) AS row_count, 0::BIGINT AS flag_violations, 0::BIGINT AS range_violations FROM cash_frame", "cash_in costs", CASH)
def anomaly_flag_rules(spark: SparkSession, sf: str) -> DataFrame:
    """Flagged are exactly the months whose score is below the exact quantile of all scores."""
    scored = settle(company_anomalies(spark, sf))
    cut = scored.agg(F.percentile("anomaly_score", F.lit(0.1))).first()[0]
    score = F.col("anomaly_score")
    return scored.agg(
        F.count("*").alias("row_count"),
        F.count_if(F.col("is_anomaly") != (score < cut)).alias("flag_violations"),
        F.count_if(~score.between(-1, 0)).alias("range_violations"),
    )


@query()
def cash_alerts(spark: SparkSession, sf: str) -> DataFrame:
    return cash.cash_alerts(company_anomalies(spark, sf))


def area_cash(spark: SparkSession, sf: str) -> DataFrame:
    """Monthly cash frame of every area.

    Costs are summed per project, month and category before they meet the project
    table, so no single project weighs on the join. Receipts are a few per project.
    """
    area = src.projects(spark, sf, ("project_id", "area_name"))
    receipts = src.cash_in(spark, sf)
    costs = src.cost_records(spark, sf, ("project_id", "payment_due_month", "category", "amount_kpy"))
    paid = costs.groupBy("project_id", "payment_due_month", "category").agg(F.sum("amount_kpy").alias("amount_kpy"))
    return cash.monthly_cash(receipts.join(area, "project_id"), paid.join(area, "project_id"), by=["area_name"])


AREA_CASH = """paid AS (SELECT area_name, CAST(payment_due_month || '-01' AS DATE) AS month, category, CAST(sum(amount_kpy) AS BIGINT) AS part
  FROM costs JOIN projects USING (project_id) GROUP BY ALL)"""


@query(
    """SELECT area_name, month, COALESCE(inflow, 0) AS inflow, COALESCE(outflow, 0) AS outflow, COALESCE(inflow, 0) - COALESCE(outflow, 0) AS net_cashflow,
  CAST(sum(COALESCE(inflow, 0) - COALESCE(outflow, 0)) OVER (PARTITION BY area_name ORDER BY month) AS BIGINT) AS cumulative_cashflow, round(hhi, 8) AS hhi
FROM (SELECT area_name, CAST(deposit_month || '-01' AS DATE) AS month, CAST(sum(expected_amount_kpy) AS BIGINT) AS inflow FROM cash_in JOIN projects USING (project_id) GROUP BY ALL)
FULL OUTER JOIN (SELECT area_name, month, CAST(sum(part) AS BIGINT) AS outflow, sum(CAST(part AS DOUBLE) ** 2) / CAST(sum(part) AS DOUBLE) ** 2 AS hhi FROM paid GROUP BY ALL) USING (area_name, month)""",
    "cash_in costs projects",
    AREA_CASH,
)
def area_monthly_cash(spark: SparkSession, sf: str) -> DataFrame:
    return area_cash(spark, sf).withColumn("hhi", F.round("hhi", 8))


@query()
def area_cash_anomalies(spark: SparkSession, sf: str) -> DataFrame:
    """Anomalies over the months of all areas, with season and activity as features."""
    by = ["area_name"]
    frame = settle(area_cash(spark, sf))
    running = active_projects(
        src.projects(spark, sf, ("project_id", "area_name", "start_date", "end_date")), frame.select("area_name", "month"), by=by
    )
    season = season_index(frame, "inflow").select("calendar_month", "season_index")
    rows = (
        cash.cash_features(frame, by)
        .join(running, [*by, "month"], "left")
        .withColumn("calendar_month", F.month("month"))
        .join(season, "calendar_month", "left")
        .drop("calendar_month")
    )
    cols = ("inflow", "outflow", "inflow_outflow_ratio", "season_index", "active_project_count")
    return forest.rescale_scores(forest.detect(rows, [*by, "month"], cols))


@query(
    """SELECT (SELECT count(*) FROM (SELECT DISTINCT area_name, month FROM (
    SELECT area_name, CAST(deposit_month || '-01' AS DATE) AS month FROM cash_in JOIN projects USING (project_id) UNION ALL SELECT area_name, month FROM paid))) AS row_count,
  0::BIGINT AS range_violations, 0::BIGINT AS unit_violations, 0::BIGINT AS flag_violations""",
    "cash_in costs projects",
    AREA_CASH,
)
def area_anomaly_rules(spark: SparkSession, sf: str) -> DataFrame:
    """A score for every month of every area; rescaled to 0-1 so that the lowest is 0 and the highest 1, flags by the exact quantile."""
    scored = settle(area_cash_anomalies(spark, sf))
    cut = scored.agg(F.percentile("anomaly_score", F.lit(0.1))).first()[0]
    ends = scored.agg(F.min("unit_score").alias("low"), F.max("unit_score").alias("high")).first()
    rules = broken(
        range=F.col("anomaly_score").between(-1, 0),
        unit=F.col("unit_score").between(0, 1) & F.lit((ends.low, ends.high) == (0.0, 1.0)),
        flag=F.col("is_anomaly") == (F.col("anomaly_score") < cut),
    )
    return scored.agg(F.count("*").alias("row_count"), *rules)


COMPANY = "全社"


def net_cash_series(spark: SparkSession, sf: str) -> DataFrame:
    """Net cash per month of every area and of the company, each on a gap-free month axis."""
    by = ["area_name"]
    areas = settle(area_cash(spark, sf).select("area_name", "month", "net_cashflow"))
    company = areas.groupBy("month").agg(F.sum("net_cashflow").alias("net_cashflow")).withColumn("area_name", F.lit(COMPANY))
    frame = areas.unionByName(company)
    return settle(on_axis(frame, month_axis(frame, by=by), ["net_cashflow"], by=by))


def net_cash_outlook(spark: SparkSession, sf: str) -> DataFrame:
    return arima.forecast(net_cash_series(spark, sf), "net_cashflow", by=["area_name"])


@query()
def cash_flow_outlook(spark: SparkSession, sf: str) -> DataFrame:
    """Six-month outlook of the company."""
    return net_cash_outlook(spark, sf).filter(F.col("area_name") == COMPANY).drop("area_name")


@query()
def area_cash_outlook(spark: SparkSession, sf: str) -> DataFrame:
    """Six-month outlook of each area."""
    return net_cash_outlook(spark, sf).filter(F.col("area_name") != COMPANY)


@query()
def danger_outlook_months(spark: SparkSession, sf: str) -> DataFrame:
    """Months whose net cash, of an area or the company, is forecast below the danger line."""
    return arima.months_under(net_cash_outlook(spark, sf))


NET_CASH = """monthly AS (SELECT area_name, month, CAST(sum(x) AS BIGINT) AS net FROM (
    SELECT area_name, CAST(deposit_month || '-01' AS DATE) AS month, expected_amount_kpy AS x FROM cash_in JOIN projects USING (project_id)
    UNION ALL SELECT area_name, CAST(payment_due_month || '-01' AS DATE), -amount_kpy FROM costs JOIN projects USING (project_id)) GROUP BY ALL),
series AS (SELECT * FROM monthly UNION ALL SELECT '全社', month, CAST(sum(net) AS BIGINT) FROM monthly GROUP BY month),
axis AS (SELECT area_name, CAST(unnest(generate_series(min(month), max(month), INTERVAL 1 MONTH)) AS DATE) AS month FROM series GROUP BY area_name),
full_series AS (SELECT a.area_name, a.month, COALESCE(net, 0) AS net FROM axis a LEFT JOIN series s ON a.area_name = s.area_name AND a.month = s.month)"""


@query(
    """SELECT area_name, count(*) AS months, CAST(sum(net) AS BIGINT) AS net_cashflow, min(month) AS first_month, max(month) AS last_month FROM full_series GROUP BY area_name""",
    "cash_in costs projects",
    NET_CASH,
)
def net_cash_axis(spark: SparkSession, sf: str) -> DataFrame:
    """What the outlook is made from: every area's and the company's months without a gap."""
    return net_cash_series(spark, sf).groupBy("area_name").agg(
        F.count("*").alias("months"),
        F.sum("net_cashflow").alias("net_cashflow"),
        F.min("month").alias("first_month"),
        F.max("month").alias("last_month"),
    )


@query(
    """SELECT area_name, step, CAST(last_month + to_months(step) AS DATE) AS month, TRUE AS ordered, TRUE AS widening
FROM (SELECT area_name, max(month) AS last_month FROM full_series GROUP BY area_name), (SELECT unnest(range(1, 7))::INTEGER AS step)""",
    "cash_in costs projects",
    NET_CASH,
)
def outlook_steps(spark: SparkSession, sf: str) -> DataFrame:
    """Six months for every series, after its last; the interval holds the forecast and never narrows."""
    return outlook_rules(net_cash_outlook(spark, sf)).drop("forecast")


def outlook_rules(outlook: DataFrame) -> DataFrame:
    """Each step with its month, its forecast, and whether the interval keeps the rules."""
    width = F.col("upper") - F.col("lower")
    before = F.lag(width).over(Window.partitionBy("area_name").orderBy("step"))
    return outlook.select(
        "area_name",
        "step",
        "month",
        "forecast",
        ((F.col("lower") <= F.col("forecast")) & (F.col("forecast") <= F.col("upper"))).alias("ordered"),
        F.coalesce(width >= before * (1 - 1e-12), F.lit(True)).alias("widening"),
    )


@query(
    """SELECT area_name, step, CAST(last_month + to_months(step) AS DATE) AS month, TRUE AS ordered, TRUE AS widening, TRUE AS forecast_made
FROM (SELECT area_name, max(month) AS last_month FROM series WHERE month(month) <> 8 AND net <> 0 GROUP BY area_name),
  (SELECT unnest(range(1, 7))::INTEGER AS step)""",
    "cash_in costs projects",
    NET_CASH,
)
def gap_outlook_steps(spark: SparkSession, sf: str) -> DataFrame:
    """The outlook from series with gaps: every August is missing, and so is a month without movement."""
    observed = net_cash_series(spark, sf).where((F.month("month") != 8) & (F.col("net_cashflow") != 0))
    return outlook_rules(arima.forecast(observed, "net_cashflow", by=["area_name"])).select(
        "*", F.col("forecast").isNotNull().alias("forecast_made")
    ).drop("forecast")


@query(
    "SELECT area_name, month, CAST(net AS DOUBLE) AS forecast FROM full_series WHERE net < -100000",
    "cash_in costs projects",
    NET_CASH,
)
def danger_line_filter(spark: SparkSession, sf: str) -> DataFrame:
    """The danger line over the observed months, some of which pass and some not."""
    observed = net_cash_series(spark, sf).select("area_name", "month", F.col("net_cashflow").cast("double").alias("forecast"))
    return arima.months_under(observed)
