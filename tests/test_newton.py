"""Second-order boosting against a brute-force search of every split."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from girder.models import newton


def table(spark, n=80, seed=1, partitions=3):
    rng = np.random.default_rng(seed)
    x = np.round(rng.normal(0, 1, (n, 3)), 1)
    y = 3 * x[:, 0] - 2 * (x[:, 1] > 0.5) + rng.normal(0, 0.1, n) + 10
    rows = [(i, *map(float, x[i]), float(y[i]), int(y[i] > 10)) for i in range(n)]
    rows[5] = (5, None, *rows[5][2:])
    return spark.createDataFrame(rows, "id long, a double, b double, c double, y double, over int").repartition(partitions), rows


FEATURES = ["a", "b", "c"]


def brute_split(x, g, h, settings):
    """(gain, feature, threshold) of the best split over every value of every feature."""
    worth = lambda m: g[m].sum() ** 2 / (h[m].sum() + settings.penalty)
    found = [(-np.inf, None, None)]
    for f in range(x.shape[1]):
        for t in np.unique(x[:, f][np.isfinite(x[:, f])]):
            left = x[:, f] <= t
            if h[left].sum() >= settings.least_curvature and h[~left].sum() >= settings.least_curvature:
                found.append((worth(left) + worth(~left) - worth(np.ones(len(g), bool)), f, t))
    return max(found, key=lambda s: s[0])


@pytest.mark.parametrize("loss", ["squared", "logistic"])
def test_every_split_is_the_best_one(spark, loss):
    df, rows = table(spark)
    settings = newton.Settings(iterations=3, step=0.5, depth=3, bins=200, penalty=0.7, least_curvature=0.5, loss=loss)
    model = newton.fit(df, FEATURES, "y" if loss == "squared" else "over", settings)
    x = np.array([[-np.inf if v is None else v for v in r[1:4]] for r in rows])
    label = np.array([r[4] if loss == "squared" else r[5] for r in rows], float)
    bins = newton.binned(np.where(np.isinf(x), np.nan, x), model.cuts)
    margin = np.full(len(rows), model.base)
    assert len(model.trees) == 3
    for tree in model.trees:
        g, h, _ = newton._slopes(loss, margin, label)
        members = {0: np.ones(len(rows), bool)}
        depth = {0: 0}
        for n in range(len(tree["left"])):
            m = members[n]
            if n:
                assert tree["value"][n] == pytest.approx(-0.5 * g[m].sum() / (h[m].sum() + 0.7), abs=1e-6)
            gain, f, t = brute_split(x[m], g[m], h[m], settings)
            if tree["left"][n] < 0:
                assert depth[n] == 3 or not gain > 1e-6
                continue
            left = m & (bins[:, tree["feature"][n]] <= tree["cut"][n])
            worth = lambda k: g[k].sum() ** 2 / (h[k].sum() + 0.7)
            assert worth(left) + worth(m & ~left) - worth(m) == pytest.approx(gain, rel=1e-6, abs=1e-6)
            for child, part in ((tree["left"][n], left), (tree["right"][n], m & ~left)):
                members[child], depth[child] = part, depth[n] + 1
        margin = margin + newton._values(tree, bins)
    got = {r["id"]: r["p"] for r in newton.predict(df, model, "p").collect()}
    want = margin if loss == "squared" else 1 / (1 + np.exp(-margin))
    assert [got[i] for i in range(len(rows))] == pytest.approx(want.tolist())


def test_trees_do_not_depend_on_partitions(spark):
    settings = newton.Settings(iterations=2, depth=3)
    one, two = (newton.fit(table(spark, partitions=p)[0], FEATURES, "y", settings) for p in (1, 5))
    assert one.base == pytest.approx(two.base)
    for a, b in zip(one.trees, two.trees, strict=True):
        assert all((a[k] == b[k]).all() for k in ("feature", "cut", "left", "right")) and a["value"] == pytest.approx(b["value"])


def test_stops_by_the_held_out_fold(spark):
    df, _ = table(spark, n=120, seed=3)
    settings = newton.Settings(iterations=40, step=0.9, depth=4, least_curvature=0.0, penalty=0.0, patience=2)
    noisy = df.withColumn("y", F.col("y") + F.when(F.col("id") % 2 == 0, 1.0).otherwise(-1.0))
    model = newton.fit(noisy, FEATURES, "y", settings, held_out=F.col("id") % 4 == 0)
    least = int(np.argmin(model.losses))
    assert len(model.trees) == least < 40 and len(model.losses) <= least + 3
    judged = newton.predict(noisy.where("id % 4 = 0"), model, "p").agg(F.avg((F.col("p") - F.col("y")) ** 2)).first()[0]
    assert judged == pytest.approx(model.losses[least], rel=1e-6)
    # Held-out rows grow no trees: other labels of theirs change nothing but when to stop.
    other = noisy.withColumn("y", F.when(F.col("id") % 4 == 0, F.col("y") + 5).otherwise(F.col("y")))
    again = newton.fit(other, FEATURES, "y", settings, held_out=F.col("id") % 4 == 0)
    for a, b in zip(model.trees, again.trees):  # noqa: B905
        assert (a["feature"] == b["feature"]).all()


def test_edges(spark):
    df, _ = table(spark, n=10)
    flat = df.withColumn("y", F.lit(4.0)).withColumn("c", F.lit(None).cast("double"))
    model = newton.fit(flat, FEATURES, "y", newton.Settings(iterations=5))
    assert model.trees == [] and {r["prediction"] for r in newton.predict(flat, model).collect()} == {4.0}
    with pytest.raises(ValueError, match="no row"):
        newton.fit(df.where("false"), FEATURES, "y")
    assert newton.predict(df.where("false"), model).collect() == []


def test_levels_read_few_partitions(spark, monkeypatch):
    """Each level is a job over the rows: 80 of them must not be dealt to 40 tasks every time."""
    df, rows = table(spark, partitions=40)
    seen, sums = [], newton._sums

    def watched(data, *rest):
        seen.append((data.rdd.getNumPartitions(), data.count()))
        return sums(data, *rest)

    monkeypatch.setattr(newton, "_sums", watched)
    newton.fit(df, FEATURES, "y", newton.Settings(iterations=2, depth=2))
    assert seen and set(seen) == {(1, len(rows))}
