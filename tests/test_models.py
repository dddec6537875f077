import datetime as dt
import itertools
import math
import threading

import numpy as np
import pytest
from helpers import cost, costs, project, projects
from pyspark.sql import functions as F

from girder.models import arima, attribution, boosted, features, forest
from girder.sources import standins as src


@pytest.fixture(scope="module")
def rows(spark, sf):
    df = features.cost_rate_features(src.projects(spark, sf), src.cost_records(spark, sf, ("project_id", "category", "amount_kpy", "status")))
    return df.cache()


@pytest.fixture(scope="module")
def reg(rows):
    return boosted.fit(features.split(rows)[0], boosted.regressor(iterations=4, depth=3))


def test_feature_edges(spark):
    p = projects(spark, project("none"), project("stopped", progress=0.0), project("plan", status="計画"), project("null", status=None))
    got = {r.project_id: r for r in features.cost_rate_features(p, costs(spark, cost("stopped", 50))).collect()}
    assert set(got) == {"none", "stopped"}
    assert (got["none"].outsourcing_pct, got["none"].actual_cost_rate, got["none"].is_over_budget) == (0.0, 0.0, 0)
    assert got["stopped"].actual_cost_rate == 5000.0 and got["stopped"].is_over_budget == 1
    assert got["stopped"].cost_progress_ratio == 0.0


def test_first_category_is_dropped(rows):
    names = features.feature_names(features.encoder().fit(rows))
    assert names[-2:] == ["division_建築", "client_type_民間"]


def test_split_is_a_partition_and_stable(rows):
    train, test = features.split(rows)
    assert train.count() + test.count() == rows.count()
    assert train.join(test, "project_id", "left_semi").count() == 0
    again = features.split(rows.repartition(5))[1]
    assert {r.project_id for r in again.select("project_id").collect()} == {r.project_id for r in test.select("project_id").collect()}


def test_a_fit_reads_few_partitions(rows):
    """Every tree level is a job: a few hundred rows must not be dealt to 64 tasks each time, and none is lost."""
    seen = []

    class Watched:
        def getLabelCol(self):  # noqa: N802
            return boosted.TARGET

        def copy(self):
            return self

        def fit(self, encoded):
            seen.append((encoded.rdd.getNumPartitions(), encoded.count()))
            return boosted.regressor(iterations=1, depth=1).fit(encoded)

    train = rows.repartition(64)
    boosted.fit(train, Watched())
    boosted.cross_validate(train, Watched(), folds=2)
    assert seen[0] == (1, rows.count())
    assert [n for n, _ in seen] == [1, 1, 1] and sum(c for _, c in seen[1:]) == rows.count()


def test_fits_run_side_by_side_on_settled_rows(rows):
    """Two fits wait for each other, so one after the other would end in a broken barrier; their rows come without the plan that made them."""
    both, plans = threading.Barrier(2, timeout=60), []

    class Waiting:
        def __init__(self, estimator):
            self.estimator = estimator

        def getLabelCol(self):  # noqa: N802
            return self.estimator.getLabelCol()

        def fit(self, encoded):
            both.wait()
            plans.append(encoded._jdf.queryExecution().optimizedPlan().toString())
            return self.estimator.fit(encoded)

    reg, clf = boosted.regressor(iterations=2, depth=2), boosted.classifier(iterations=2, depth=2)
    models = boosted.fit_all(rows, Waiting(reg), Waiting(clf))
    assert [type(m.stages[-1]).__name__ for m in models] == ["GBTRegressionModel", "GBTClassificationModel"]
    assert all(plan.startswith("LogicalRDD") for plan in plans) and len(plans) == 2
    alone = boosted.fit(rows, reg)
    predicted = lambda m: [r[0] for r in m.transform(rows).orderBy("project_id").select("predicted_cost_rate").collect()]
    assert predicted(models[0]) == pytest.approx(predicted(alone))


def test_metrics_against_hand_values(spark):
    df = spark.createDataFrame([(10.0, 12.0), (0.0, 1.0)], "actual_cost_rate double, predicted_cost_rate double")
    m = boosted.regression_metrics(df).first()
    assert (m.rmse, m.mae, m.mape) == pytest.approx((math.sqrt(2.5), 1.5, 60.0))
    none = spark.createDataFrame([(0, 0)], "is_over_budget int, predicted_over_budget int")
    c = boosted.classification_metrics(none).first()
    assert (c.accuracy, c.precision, c.recall, c.f1) == (1.0, 0.0, 0.0, 0.0)


def expected(tree, x, known, node=0):
    """What one tree is expected to give when only the features in ``known`` are seen."""
    if tree["left"][node] < 0:
        return float(tree["mean"][node])
    f, sides = int(tree["feature"][node]), (int(tree["left"][node]), int(tree["right"][node]))
    if f in known:
        goes = x[f] in tree["sets"][node] if node in tree["sets"] else x[f] <= tree["threshold"][node]
        return expected(tree, x, known, sides[0] if goes else sides[1])
    return sum(tree["rows"][s] / tree["rows"][node] * expected(tree, x, known, s) for s in sides)


def brute_shapley(tree, x, width):
    """Every set of the features that the tree uses, by the definition."""
    used = sorted({int(f) for f, left in zip(tree["feature"], tree["left"], strict=True) if left >= 0})
    n = len(used)
    out = np.zeros(width)
    for j in used:
        others = [f for f in used if f != j]
        for k in range(n):
            weight = math.factorial(k) * math.factorial(n - 1 - k) / math.factorial(n)
            for known in itertools.combinations(others, k):
                out[j] += weight * (expected(tree, x, {*known, j}) - expected(tree, x, set(known)))
    return out * tree["weight"]


def grown_tree(rng, features, depth):
    """A random tree; features repeat on a path, and one is split by a set."""
    tree = {"mean": [], "left": [], "right": [], "feature": [], "threshold": [], "rows": [], "sets": {}, "weight": 0.7}

    def grow(rows, level):
        at = len(tree["left"])
        for key, value in (("mean", rng.normal()), ("left", -1), ("right", -1), ("feature", -1), ("threshold", np.nan), ("rows", rows)):
            tree[key].append(value)
        if level and rows > 1 and (level == depth or rng.random() < 0.8):
            tree["feature"][at] = int(rng.integers(0, features))
            if tree["feature"][at] == 0:
                tree["sets"][at] = np.array([0.0, 2.0])
            else:
                tree["threshold"][at] = rng.normal()
            cut = int(rng.integers(1, rows))
            tree["left"][at] = grow(cut, level - 1)
            tree["right"][at] = grow(rows - cut, level - 1)
        return at

    grow(50, depth)
    return {k: np.array(v) if isinstance(v, list) else v for k, v in tree.items()}


def test_shapley_values_equal_all_orders():
    rng = np.random.default_rng(4)
    for _ in range(12):
        tree = grown_tree(rng, 5, 6)
        x = rng.normal(size=(7, 6))
        x[:, 0] = rng.integers(0, 4, 7)
        got = attribution.shapley_values(x, [tree], 6)
        assert got == pytest.approx(np.array([brute_shapley(tree, row, 6) for row in x]), abs=1e-12)
        base = attribution.expected_value([tree])
        assert base == pytest.approx(tree["weight"] * expected(tree, x[0], set()))
        assert got.sum(axis=1) + base == pytest.approx([tree["weight"] * expected(tree, row, set(range(6))) for row in x])
        assert not got[:, 5].any()
    assert attribution.shapley_values(np.zeros((0, 6)), [tree], 6).shape == (0, 6)


@pytest.mark.parametrize("bits", [1, 2, 4, 9])
def test_shapley_values_are_read_off_tables(monkeypatch, bits):
    """Rows are looked up in tables made before; only a leaf with more decisions than a table has works out its patterns."""
    monkeypatch.setattr(attribution, "BITS", bits)
    rng = np.random.default_rng(7)
    for depth in (0, 1, 4, 6):
        trees = [grown_tree(rng, 5, depth) for _ in range(4)]
        x = rng.normal(size=(9, 6))
        x[:, 0] = rng.integers(0, 4, 9)
        want = sum(np.array([brute_shapley(t, row, 6) for row in x]) for t in trees)
        assert attribution.shapley_values(x, trees, 6) == pytest.approx(want, abs=1e-12)
        pieces = [attribution._pieces(t) for t in trees]
        assert all(len(table[0]) == 2 ** len(decisions) <= 2**bits for parts in pieces for decisions, _, _, table in parts if table is not None)
        if bits == 9:
            with monkeypatch.context() as m:
                m.setattr(attribution, "_leaf_values", None)
                assert attribution.shapley_values(x, trees, 6, pieces) == pytest.approx(want, abs=1e-12)


def test_contributions_of_a_fitted_model(spark, rows, reg):
    """Shapley values of the fitted trees by the definition, their sum, and what is read off them."""
    names = features.feature_names(reg)
    scored = attribution.contributions(reg.transform(rows), reg, names)
    from catalog.models import contribution_violations

    assert tuple(contribution_violations(scored, len(names)).first()) == (rows.count(), 0, 0)
    off = scored.withColumn("base_value", F.col("base_value") * 1.001 + 0.001)
    assert contribution_violations(off, len(names)).first()["sum_violations"] == rows.count()
    trees = attribution._as_arrays(attribution.tree_nodes(reg, spark).toPandas())
    for r in scored.orderBy("project_id").limit(5).collect():
        x = r["features"].toArray()
        assert r["contributions"] == pytest.approx(sum(brute_shapley(t, x, len(names)) for t in trees), rel=1e-9, abs=1e-9)
    factors = attribution.top_factors(scored, names, k=3).first()["top_risk_factors"]
    assert len(factors) <= 3 and all(f.contribution > 0 for f in factors)
    assert attribution.mean_contributions(scored, names).count() == len(names)


def test_scores_and_levels(rows, reg):
    train, _ = features.split(rows)
    clf = boosted.fit(train, boosted.classifier(iterations=3, depth=3))
    scored = boosted.score(rows, reg, clf, rmse=2.0)
    r = scored.agg(F.min("risk_score").alias("lo"), F.max("risk_score").alias("hi"), F.count("*").alias("n")).first()
    assert 0 <= r.lo <= r.hi <= 100 and r.n == rows.count()
    width = F.col("prediction_interval_upper") - F.col("prediction_interval_lower")
    assert scored.select(F.max(width)).first()[0] == pytest.approx(2 * 1.96 * 2.0)
    top = boosted.result_table(scored, rows=5).collect()
    assert [x.risk_score for x in top] == sorted((x.risk_score for x in top), reverse=True)
    from catalog.models import score_violations

    rules = score_violations(scored, 2.0).first()
    assert tuple(rules) == (r.n, r.n, 0, 0, 0, 0)
    assert score_violations(scored, 3.0).first()["interval_violations"] > 0.9 * r.n
    hist = boosted.probability_histogram(scored)
    assert hist.agg(F.sum("row_count")).first()[0] == rows.count()


def test_cross_validation_covers_every_fold(rows):
    got = boosted.cross_validate(rows, boosted.regressor(iterations=2, depth=2), folds=3).collect()
    values = [r.rmse for r in got]
    assert sorted(r.fold for r in got) == [0, 1, 2]
    assert got[0].mean_rmse == pytest.approx(np.mean(values)) and got[0].std_rmse == pytest.approx(np.std(values))


def planted(spark, n=60):
    rng = np.random.default_rng(1)
    data = [(i, float(rng.normal(0, 1)), float(rng.normal(0, 1))) for i in range(n)]
    for i, shock in ((10, 12.0), (30, -15.0), (50, 10.0)):
        data[i] = (i, shock, -shock)
    return spark.createDataFrame(data, "id int, a double, b double")


def test_planted_anomalies_score_lowest(spark):
    got = forest.detect(planted(spark), ["id"], ["a", "b"]).orderBy("anomaly_score").collect()
    assert {r.id for r in got[:3]} == {10, 30, 50}
    assert sum(r.is_anomaly for r in got) == 6
    assert all(-1 < r.anomaly_score < 0 for r in got)


def test_forest_repeats_with_its_seed_and_any_partitioning(spark):
    one = {r.id: r.anomaly_score for r in forest.detect(planted(spark), ["id"], ["a", "b"], trees=20).collect()}
    two = {r.id: r.anomaly_score for r in forest.detect(planted(spark).repartition(3), ["id"], ["a", "b"], trees=20).collect()}
    assert one == pytest.approx(two)


@pytest.mark.parametrize("gathered", [3, 50, 10**6])
def test_quantile_is_exact_at_any_size(spark, gathered):
    rng = np.random.default_rng(2)
    ends = np.concatenate([np.zeros(400), rng.normal(5, 1, 300), np.full(400, 10.0)])  # ties at both ends, many values between
    for values in (rng.normal(0, 1, 2001), np.repeat([1.0, 2.0, 2.0, 3.0], 300), ends, np.array([4.0])):
        df = spark.createDataFrame([(float(v),) for v in values] + [(None,)], "v double")
        for fraction in (0.0, 0.1, 0.5, 1.0):
            assert forest.exact_quantile(df, "v", fraction, gathered) == pytest.approx(np.quantile(values, fraction))


def test_tree_samples_are_whole_on_a_larger_table(spark):
    df = spark.range(20000).select("id", F.rand(3).alias("a"))
    got = forest.tree_samples(df, ["id"], F.array("a"), 20000, trees=8, size=256, seed=1)
    assert {r["count"] for r in got.groupBy("tree").count().collect()} == {256}


def test_rescaled_scores(spark):
    df = spark.createDataFrame([(-0.8,), (-0.5,), (-0.4,)], "anomaly_score double")
    got = sorted((r.unit_score, r.is_anomaly_by_cut) for r in forest.rescale_scores(df).collect())
    assert got[0] == (0.0, False) and got[-1] == (1.0, True)


def arma_series(n, phi=0.6, theta=0.3, seed=7):
    rng = np.random.default_rng(seed)
    e = rng.normal(0, 1, n)
    w = np.zeros(n)
    for t in range(1, n):
        w[t] = phi * w[t - 1] + e[t] + theta * e[t - 1]
    return np.cumsum(w)


def test_series_fit_recovers_its_parameters():
    phi, theta, variance, _ = arima.fit_series(arma_series(1500))
    assert phi == pytest.approx(0.6, abs=0.08) and theta == pytest.approx(0.3, abs=0.08)
    assert variance == pytest.approx(1.0, abs=0.1)


def dense_likelihood(y, phi, theta, steps):
    """The known months after the first as one Gaussian vector: best variance, log likelihood, and means and spreads ahead."""
    n = len(y) - 1 + steps
    lags = np.empty(n)
    lags[0] = (1 + 2 * phi * theta + theta**2) / (1 - phi**2)
    if n > 1:
        lags[1] = phi * lags[0] + theta
    for k in range(2, n):
        lags[k] = phi * lags[k - 1]
    changes = lags[np.abs(np.subtract.outer(np.arange(n), np.arange(n)))]
    total = np.tril(np.ones((n, n)))
    levels = total @ changes @ total.T
    known = np.flatnonzero(~np.isnan(y[1:]))
    ahead = np.arange(len(y) - 1, n)
    cov, miss = levels[np.ix_(known, known)], y[1:][known] - y[0]
    variance = miss @ np.linalg.solve(cov, miss) / len(known)
    logs = np.linalg.slogdet(cov)[1]
    cross = levels[np.ix_(ahead, known)]
    means = y[0] + cross @ np.linalg.solve(cov, miss)
    spread = np.diag(levels[np.ix_(ahead, ahead)] - cross @ np.linalg.solve(cov, cross.T))
    return variance, -0.5 * (len(known) * (math.log(2 * math.pi) + 1 + math.log(variance)) + logs), means, spread


@pytest.mark.parametrize("missing", [(), (3,), (5, 6, 7, 15), (1, 2, 22)])
def test_filter_equals_the_dense_gaussian(missing):
    y = arma_series(24, seed=3) * 50 + 1000
    y[list(missing)] = np.nan
    for phi, theta in ((0.0, 0.0), (0.5, 0.3), (-0.7, 0.9), (0.95, -0.95)):
        found = arima.kalman(y, np.array([phi]), np.array([theta]))
        variance, likelihood, means, spread = dense_likelihood(y, phi, theta, 4)
        assert found.variance[0] == pytest.approx(variance)
        assert found.log_likelihood[0] == pytest.approx(likelihood)
        state, p = found.means, found.spread
        for h in range(4):
            state, p = arima._step(state, p, np.array([phi]), np.array([theta]))
            assert (state[0][0], p[0][0]) == (pytest.approx(means[h]), pytest.approx(spread[h]))


def test_fit_is_the_best_of_a_fine_grid():
    y = arma_series(40, 0.4, -0.5, seed=11)
    y[[7, 20, 21]] = np.nan
    phi, theta, _, found = arima.fit_series(y)
    axis = np.linspace(-0.98, 0.98, 99)
    many = arima.kalman(y, *(g.ravel() for g in np.meshgrid(axis, axis)))
    assert found.log_likelihood[0] >= many.log_likelihood.max() - 1e-9


def test_forecast_per_series_with_reasons(spark):
    months = [dt.date(2022 + i // 12, i % 12 + 1, 1) for i in range(24)]
    rng = np.random.default_rng(0)
    data = [("walk", m, float(v)) for m, v in zip(months, np.cumsum(rng.normal(0, 1, 24)))]
    data += [("flat", m, 5.0) for m in months] + [("ramp", m, 2.0 * i) for i, m in enumerate(months[:3])]
    data += [("short", m, float(i * i)) for i, m in enumerate(months[:4])] + [("five", m, float(i * i)) for i, m in enumerate(months[:5])]
    data += [("ramp with gaps", m, 2.0 * i) for i, m in enumerate(months[:9]) if i not in (2, 3, 6)]
    data += [("walk with gaps", m, None if i == 9 else v) for i, (_, m, v) in enumerate(data[:24]) if i not in (4, 5, 23)]
    data += [("nothing known", m, None) for m in months[:6]]
    got = arima.forecast(spark.createDataFrame(data, "k string, month date, v double"), "v", by=["k"]).collect()
    assert len(got) == 48
    for r in got:
        if r.k == "nothing known":
            assert r.forecast is None and r.reason == "too short"
        elif r.k == "ramp with gaps":
            assert r.lower == r.forecast == r.upper == 16.0 + 2 * r.step
        elif r.k.startswith("walk"):
            assert r.reason is None and r.lower < r.forecast < r.upper
        elif r.k == "five":
            assert r.reason is None and r.lower <= r.forecast <= r.upper
        elif r.k == "short":
            assert r.forecast is None and r.reason == "too short"
        else:
            assert r.reason is None and r.lower == r.forecast == r.upper == (5.0 if r.k == "flat" else 4.0 + 2 * r.step)
    first = next(r for r in got if r.k == "walk" and r.step == 1)
    assert first.month == dt.date(2024, 1, 1)
    assert min(r.month for r in got if r.k == "walk with gaps") == dt.date(2023, 12, 1)
    widths = [r.upper - r.lower for r in sorted((r for r in got if r.k == "walk"), key=lambda r: r.step)]
    assert widths == sorted(widths)


def test_order_of_a_ranking_is_judged_in_many_tasks(spark):
    """Rising scores count within a partition and across a border, and no window takes in all rows."""
    from catalog.models import order_violations

    falling = spark.range(1000, numPartitions=7).select((1000.0 - F.col("id")).alias("s"))
    assert tuple(order_violations(falling, "s").first()) == (1000, 0)
    edges = spark.range(12, numPartitions=3).select(F.when(F.col("id") == 4, 50.0).when(F.col("id") == 9, 40.0).when(F.col("id") == 11, None).otherwise(20.0 - F.col("id")).alias("s"))
    assert tuple(order_violations(edges, "s").first()) == (12, 3)
    assert order_violations(falling.limit(0), "s").first()["ranked"] == 0
    plan = order_violations(falling, "s")._jdf.queryExecution().optimizedPlan().toString()
    assert [line for line in plan.splitlines() if "Window [lag" in line and ", [place" in line and "[part" in line]


def test_documents_fit_both_models_at_once_and_the_split_is_placed_once(spark, rows, sf, monkeypatch):
    """Neither model is fitted before the other begins, and all queries of a session read one split."""
    import catalog.models as queries

    placed, fits = [], []
    split, fit_all = features.split, boosted.fit_all
    monkeypatch.setattr(queries, "_fitted", {})
    monkeypatch.setattr(features, "split", lambda *a, **k: placed.append(1) or split(*a, **k))
    monkeypatch.setattr(boosted, "fit_all", lambda train, *e: fits.append(len(e)) or fit_all(train, *e))
    monkeypatch.setattr(boosted, "regressor", lambda make=boosted.regressor: make(iterations=2, depth=2))
    monkeypatch.setattr(boosted, "classifier", lambda make=boosted.classifier: make(iterations=2, depth=2))
    assert queries.prediction_documents(spark, sf).count() == rows.count()
    queries.cost_rate_model_metrics(spark, sf).collect()
    assert fits == [2] and len(placed) == 1
    sides = [sorted(r[0] for r in side.select("project_id").collect()) for side in queries.settled_split(spark, sf)]
    assert sides == [sorted(r[0] for r in side.select("project_id").collect()) for side in split(rows)]


def test_blocks_grow_the_trees_of_mllib(spark, monkeypatch):
    """Same nodes as by MLlib's own fit: more rows than it draws thresholds from, zeros, a constant, two-valued and equal features."""
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.functions import vector_to_array
    from pyspark.ml.regression import GBTRegressor

    from girder.models import blocks

    rng = np.random.default_rng(3)
    x = rng.normal(size=(12_000, 4)).round(2)
    x[:, 0] = np.where(x[:, 0] < 0, 0.0, x[:, 0])
    x[:, 1] = rng.integers(0, 5, len(x)) - 2.0
    kinds = [("a", "x")[i] for i in rng.integers(0, 2, len(x))]
    rate = x[:, 0] * 3 + (x[:, 1] > 0) * 5 + (np.array(kinds) == "x") * 2 + x[:, 2] ** 2 + rng.normal(size=len(x)) * 3
    data = [(*map(float, r), k, c, float(v), int(v > 5)) for r, k, c, v in zip(x, kinds, ("p", "q") * 6000, rate)]
    df = spark.createDataFrame(data, f"n0 double, n1 double, n2 double, n3 double, k string, c string, {boosted.TARGET} double, {boosted.LABEL} int")
    encoded = features.encoder(numeric=("n0", "n1", "n2", "n3", "same"), categorical=("k", "c")).fit(df := df.withColumn("same", F.lit(4.0))).transform(df).coalesce(1)
    monkeypatch.setattr(blocks, "BLOCK", 5000)
    monkeypatch.setattr(blocks, "KEPT", 2)

    class Fitted:
        def __init__(self, model):
            self.stages = [model]

    for own, plain, column in ((boosted.regressor(5, depth=4), GBTRegressor(), "predicted_cost_rate"), (boosted.classifier(5, depth=4), GBTClassifier(), "over_budget_vector")):
        for p, v in own._paramMap.items():
            plain._set(**{p.name: v})
        models = own.fit(encoded), plain.fit(encoded)
        assert type(models[0]) is type(models[1]) and models[0].getMaxDepth() == 4
        nodes = [attribution.tree_nodes(Fitted(m), spark).toPandas().sort_values(["treeID", "id"]).reset_index(drop=True) for m in models]
        for c in nodes[1].columns:
            if c in ("prediction", "values"):
                assert np.concatenate([np.atleast_1d(v) for v in nodes[0][c]]) == pytest.approx(np.concatenate([np.atleast_1d(v) for v in nodes[1][c]]), rel=1e-9, abs=1e-9)
            else:
                assert nodes[0][c].tolist() == nodes[1][c].tolist(), c
        value = vector_to_array(column)[1] if column == "over_budget_vector" else F.col(column)
        predicted = [m.transform(encoded).select(value.alias("v")).toPandas()["v"].to_numpy() for m in models]
        assert predicted[0] == pytest.approx(predicted[1], rel=1e-9)
        assert list(models[0].featureImportances.toArray()) == pytest.approx(list(models[1].featureImportances.toArray()))
    with pytest.raises(Exception, match="no label"):
        own.fit(encoded.withColumn(boosted.LABEL, F.when(F.col("n3") < 0, F.col(boosted.LABEL))))
    assert boosted.regressor(2).setMinInfoGain(0.5).fit(encoded).getMinInfoGain() == 0.5


def test_a_level_of_a_fit_is_read_by_blocks(spark):
    """A pass reads arrays of many rows, not a row at a time, and as many tasks as there are blocks for."""
    from girder.models import blocks

    rows = spark.range(300, numPartitions=8).select(F.array(F.col("id").cast("double")).alias("x"), F.col("id").cast("double").alias(boosted.TARGET))
    from pyspark.ml.functions import array_to_vector

    held = blocks._blocks(boosted.regressor(), rows.withColumn("features", array_to_vector("x")), 300, [np.array([99.5])], False)
    got = held.collect()
    assert held.getNumPartitions() == 1 and sum(b.shape[1] for b, _, _ in got) == 300 and len(got) <= 8
    assert sorted(np.concatenate([y[b[0] == 0] for b, y, _ in got])) == list(range(100))
    held.unpersist()
