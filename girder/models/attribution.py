"""Shapley values of a boosted-tree prediction: what each feature adds to it.

The value of a set of known features is the prediction expected from them
alone: where a tree splits by another feature, both sides count by the rows
that took them in training. A Shapley value is a feature's mean addition over
all orders in which the features can become known. It is exact here. In a
leaf's part of a tree only the features on its path matter: of a known one the
row goes the leaf's way or not (1 or 0), of an unknown one the path's share of
rows counts. The sets of one size are the coefficients of a product of linear
terms, so the work grows with the cube of the path and not with the number of
sets. Values and ``base_value``, the prediction expected from nothing, add up
to the prediction.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from math import factorial

import numpy as np
import pandas as pd
from pyspark.ml import PipelineModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from girder.session import scratch_path, settle


def tree_nodes(model: PipelineModel, spark) -> DataFrame:
    """Node table of the fitted trees, read from the model's saved form, which is deleted again."""
    path = scratch_path(spark, "boosted-model")
    model.stages[-1].write().save(path)
    weights = spark.read.parquet(f"{path}/treesMetadata").toDF("treeID", "metadata", "weight")
    node = F.col("nodeData")
    nodes = settle(
        spark.read.parquet(f"{path}/data")
        .join(weights, "treeID")
        .select(
            "treeID",
            "weight",
            node["id"].alias("id"),
            node["prediction"].alias("prediction"),
            node["leftChild"].alias("left"),
            node["rightChild"].alias("right"),
            node["split"]["featureIndex"].alias("feature"),
            node["split"]["leftCategoriesOrThreshold"].alias("values"),
            node["split"]["numCategories"].alias("categories"),
            node["rawCount"].alias("rows"),
        )
    )
    saved = spark._jvm.org.apache.hadoop.fs.Path(path)
    saved.getFileSystem(spark._jsc.hadoopConfiguration()).delete(saved, True)
    return nodes


def _as_arrays(nodes: pd.DataFrame) -> list[dict]:
    """One set of arrays per tree, indexed by node id."""
    trees = []
    for _, t in nodes.sort_values(["treeID", "id"]).groupby("treeID"):
        thresholds = np.array([v[0] if len(v) and c < 0 else np.nan for v, c in zip(t["values"], t["categories"])])
        left_sets = {i: np.asarray(v) for i, (v, c) in enumerate(zip(t["values"], t["categories"])) if c >= 0}
        trees.append(
            {
                "weight": float(t["weight"].iloc[0]),
                "mean": t["prediction"].to_numpy(),
                "left": t["left"].to_numpy(),
                "right": t["right"].to_numpy(),
                "feature": t["feature"].to_numpy(),
                "rows": t["rows"].to_numpy(),
                "threshold": thresholds,
                "sets": left_sets,
            }
        )
    return trees


def _leaves(tree: dict) -> list[tuple[float, np.ndarray]]:
    """For each leaf its value and the shares of rows of the features on its path."""
    found = []
    open_ = [(0, {}, {})]
    while open_:
        node, shares, steps = open_.pop()
        if tree["left"][node] < 0:
            found.append((float(tree["mean"][node]), np.array(list(shares.values()))))
            continue
        open_ += _sides(tree, node, shares, steps)
    return found


def expected_value(trees: list[dict]) -> float:
    """The prediction expected without knowing a feature."""
    return sum(t["weight"] * sum(value * shares.prod() for value, shares in _leaves(t)) for t in trees)


def _leaf_values(goes: np.ndarray, shares: np.ndarray) -> np.ndarray:
    """Shapley values of a leaf worth 1 for each pattern (a row of ``goes``: known features that lead to it)."""
    m = len(shares)
    weights = np.array([factorial(k) * factorial(m - 1 - k) / factorial(m) for k in range(m)])
    out = np.empty(goes.shape)
    for j in range(m):
        # Coefficient k: all sets of k other features, known ones by the row, the rest by their shares.
        sets = np.zeros(goes.shape)
        sets[:, 0] = 1.0
        for i in range(m):
            if i != j:
                grown = sets * shares[i]
                grown[:, 1:] += sets[:, :-1] * goes[:, i : i + 1]
                sets = grown
        out[:, j] = (goes[:, j] - shares[j]) * (sets @ weights)
    return out


BITS = 9  # decisions a table covers


def _pieces(tree: dict) -> list[tuple]:
    """The tree cut into parts of at most ``BITS`` decisions; a deeper leaf is a part of its own.

    A part has the decisions its leaves depend on, each a list of (node, left)
    steps that a row takes all or not, the features it credits, its leaves as
    (worth, features, shares, decisions of each feature), and the values
    (feature, pattern) of all patterns of its decisions, None if there are more
    than 2^BITS.
    """
    below: dict[int, list[int]] = {}

    def splits(n: int) -> list[int]:
        if tree["left"][n] < 0:
            return []
        below[n] = [n, *splits(int(tree["left"][n])), *splits(int(tree["right"][n]))]
        return below[n]

    splits(0)
    found = []
    open_ = [(0, {}, {})]
    while open_:
        node, shares, steps = open_.pop()
        inside = below.get(node, [])
        if inside and len(steps) + len(inside) > BITS:
            open_ += [(child, *taken) for child, *taken in _sides(tree, node, shares, steps)]
            continue
        decisions = [*steps.values(), *([(n, True)] for n in inside)]
        known = {f: [(i, True)] for i, f in enumerate(steps)}
        place = {n: len(steps) + i for i, n in enumerate(inside)}
        leaves, todo = [], [(node, shares, known)]
        while todo:
            n, part, way = todo.pop()
            if tree["left"][n] < 0:
                if part:
                    leaves.append((tree["weight"] * float(tree["mean"][n]), list(part), np.array(list(part.values())), list(way.values())))
                continue
            todo += _sides(tree, n, part, way, place)
        if not leaves:
            continue
        credited = sorted({f for _, features, _, _ in leaves for f in features})
        patterns = (np.arange(2 ** len(decisions))[:, None] >> np.arange(len(decisions)) & 1).astype(bool) if len(decisions) <= BITS else None
        found.append((decisions, credited, leaves, None if patterns is None else _worth(leaves, credited, patterns)))
    return found


def _sides(tree: dict, node: int, shares: dict, steps: dict, names: dict | None = None) -> list[tuple[int, dict, dict]]:
    """The children of a node with their features' shares and steps; ``names`` numbers the nodes of the steps."""
    f, out = int(tree["feature"][node]), []
    for child, left in ((int(tree["left"][node]), True), (int(tree["right"][node]), False)):
        part = float(tree["rows"][child]) / float(tree["rows"][node])
        step = (node if names is None else names[node], left)
        out.append((child, shares | {f: shares.get(f, 1.0) * part}, steps | {f: [*steps.get(f, []), step]}))
    return out


def _worth(leaves: list[tuple], credited: list[int], patterns: np.ndarray) -> np.ndarray:
    """Shapley values (feature, pattern) of leaves for patterns of decisions."""
    out = np.zeros((len(credited), len(patterns)))
    for value, features, shares, ways in leaves:
        goes = np.stack([np.logical_and.reduce([patterns[:, i] == side for i, side in way]) for way in ways], axis=1)
        out[[credited.index(f) for f in features]] += value * _leaf_values(goes.astype(float), shares).T
    return out


def shapley_values(x: np.ndarray, trees: list[dict], width: int, pieces: list[list[tuple]] | None = None) -> np.ndarray:
    """Shapley values of all rows, read off the tables of the trees' ``pieces`` by the decisions a row meets."""
    out = np.zeros((width, len(x)))
    if not len(x):
        return out.T
    columns = np.ascontiguousarray(x.T)
    for t, parts in zip(trees, pieces or map(_pieces, trees), strict=True):
        left = np.zeros((len(t["left"]), len(x)), bool)
        for n in np.flatnonzero(t["left"] >= 0):
            value = columns[t["feature"][n]]
            left[n] = np.isin(value, t["sets"][n]) if n in t["sets"] else value <= t["threshold"][n]
        for decisions, credited, leaves, table in parts:
            taken = [np.logical_and.reduce([left[n] if side else ~left[n] for n, side in way]) for way in decisions]
            if table is None:
                patterns, back = np.unique(np.stack(taken, axis=1), axis=0, return_inverse=True)
                table, at = _worth(leaves, credited, patterns), back.ravel()
            else:
                at = np.zeros(len(x), np.uint16)
                for i, bit in enumerate(taken):
                    at |= np.left_shift(bit, i, dtype=np.uint16)
                at = at.astype(np.intp)
            for f, values in zip(credited, table, strict=True):
                out[f] += values.take(at, mode="clip")
    return out.T


def contributions(encoded: DataFrame, model: PipelineModel, names: Sequence[str]) -> DataFrame:
    """Adds ``contributions``, the Shapley values in feature order, and ``base_value``.

    ``encoded`` has the model's features vector. The node table holds at most
    iterations x 2^(depth+1) rows, whatever the data, and the tables of its parts
    are worked out once; both are sent to each executor once.
    """
    spark = encoded.sparkSession
    trees = _as_arrays(tree_nodes(model, spark).toPandas())
    sent = spark.sparkContext.broadcast((trees, [_pieces(t) for t in trees]))
    width = len(names)

    @F.pandas_udf("array<double>")
    def credit(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        trees, pieces = sent.value
        for features in batches:
            x = np.stack(features.to_numpy()) if len(features) else np.zeros((0, width))
            yield pd.Series(list(np.ascontiguousarray(shapley_values(x, trees, width, pieces))))

    base = F.lit(expected_value(trees))
    return encoded.withColumns({"contributions": credit(vector_to_array("features")), "base_value": base})


def mean_contributions(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """Mean absolute contribution per feature, largest first; one aggregate, no row blow-up."""
    one = df.agg(*[F.avg(F.abs(F.col("contributions")[i])).alias(f"c{i}") for i in range(len(names))])
    cells = F.array(
        *[F.struct(F.lit(n).alias("feature"), F.col(f"c{i}").alias("mean_abs_contribution")) for i, n in enumerate(names)]
    )
    return one.select(F.explode(cells).alias("c")).select("c.*").orderBy(F.desc("mean_abs_contribution"), "feature")


def top_factors(df: DataFrame, names: Sequence[str], k: int = 3, key: str = "project_id") -> DataFrame:
    """The k features that raise each prediction most, with their part of all movement."""
    total = F.aggregate("contributions", F.lit(0.0), lambda a, c: a + F.abs(c))
    pairs = F.zip_with(
        F.array(*[F.lit(n) for n in names]),
        F.col("contributions"),
        lambda n, c: F.struct((-c).alias("order"), n.alias("factor"), c.alias("contribution")),
    )
    raising = F.filter(F.array_sort(pairs), lambda p: p["contribution"] > 0)
    listed = F.transform(
        F.slice(raising, 1, k),
        lambda p: F.struct(
            p["factor"].alias("factor"), F.round(F.try_divide(p["contribution"], F.col("_total")), 4).alias("contribution")
        ),
    )
    return df.withColumn("_total", total).select(key, listed.alias("top_risk_factors"))
