"""MLlib's gradient-boosted trees, grown on blocks of bin numbers.

The fit is MLlib's: the same bins, gains, pseudo-residuals and step, and the
result is its model class. What differs is the pass that each tree level takes
over the rows. A row is a byte per feature, kept in blocks of columns with the
label and the margin of the trees so far; a task adds its blocks up by node,
feature and bin with array operations, where MLlib visits a row's features one
by one. One table per task, as long as the nodes, features and bins, goes to
the driver, whatever the number of rows.

Settings beyond those used here (weights, subsampling, validation rows, other
losses, limits on nodes, categories beyond two) are left to MLlib itself.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import RDD, StorageLevel
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressionModel, GBTRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from girder.session import ensure_checkpoint_dir, scratch_path

BLOCK = 1 << 16  # rows
KEPT = 25  # trees between two checkpoints
EPSILON = float(np.finfo(float).eps)
NODE = "treeID int, nodeData struct<id int, prediction double, impurity double, impurityStats array<double>, rawCount long, gain double, leftChild int, rightChild int, split struct<featureIndex int, leftCategoriesOrThreshold array<double>, numCategories int>>"


class BlockRegressor(GBTRegressor):
    """GBTRegressor whose fit passes over blocks."""

    def _fit(self, dataset: DataFrame) -> GBTRegressionModel:
        return _fit(self, dataset, super()._fit, GBTRegressionModel)


class BlockClassifier(GBTClassifier):
    """GBTClassifier whose fit passes over blocks."""

    def _fit(self, dataset: DataFrame) -> GBTClassificationModel:
        return _fit(self, dataset, super()._fit, GBTClassificationModel)


def _fit(estimator, dataset: DataFrame, plain, model_class):
    arity = _arity(dataset, estimator.getFeaturesCol())
    if arity is None or not _usual(estimator):
        return plain(dataset)
    spark = dataset.sparkSession
    ensure_checkpoint_dir(spark)
    logistic = model_class is GBTClassificationModel
    cuts, total = bin_cuts(estimator, dataset, arity)
    blocks = _blocks(estimator, dataset, total, cuts, logistic)
    trees = _grow(blocks, cuts, arity, estimator.getMaxIter(), estimator.getStepSize(), estimator.getMaxDepth(), logistic)
    saved = [(weight, _saved_nodes(nodes, cuts, arity)) for weight, nodes in trees]
    return estimator._copyValues(_model(spark, estimator, model_class, saved, len(cuts)))


def _usual(estimator) -> bool:
    """Whether everything but iterations, step, depth, bins, seed and column names is as MLlib sets it."""
    free = {"featuresCol", "labelCol", "predictionCol", "rawPredictionCol", "probabilityCol", "maxIter", "stepSize", "maxDepth", "maxBins", "seed", "checkpointInterval", "maxMemoryInMB", "cacheNodeIds", "leafCol", "thresholds"}
    return all(p.name in free or estimator._defaultParamMap.get(p) == v for p, v in estimator._paramMap.items())


def _arity(dataset: DataFrame, column: str) -> dict[int, int] | None:
    """Positions of two-valued features, which MLlib takes as categories; None if others have categories."""
    attributes = dataset.schema[column].metadata.get("ml_attr", {}).get("attrs", {})
    if attributes.get("nominal"):
        return None
    return {a["idx"]: 2 for a in attributes.get("binary", [])}


def bin_cuts(estimator, dataset: DataFrame, arity: dict[int, int]) -> tuple[list[np.ndarray], int]:
    """MLlib's thresholds of every feature and the number of rows; a two-valued one is cut between 0 and 1.

    MLlib sets thresholds by the quantiles of about 10,000 rows, or of all rows if there are fewer; the same rows are drawn.
    """
    spark = dataset.sparkSession
    rows = dataset.select(estimator.getFeaturesCol())
    total = rows.count()
    if not total:
        raise ValueError("no row to learn from")
    bins = min(estimator.getMaxBins(), total)
    wanted = max(bins * bins, 10_000)
    share = wanted / total if wanted < total else 1.0
    drawn = rows
    if share < 1:
        seed = spark._jvm.org.apache.spark.util.random.XORShiftRandom(estimator.getSeed()).nextInt()
        sampled = rows._jdf.toJavaRDD().sample(False, share, seed)
        drawn = DataFrame(spark._jsparkSession.createDataFrame(sampled, rows._jdf.schema()), spark)
    x = np.array([r[0] for r in drawn.select(vector_to_array(estimator.getFeaturesCol())).collect()], np.float64)
    width = x.shape[1] if x.size else rows.first()[0].size
    cuts = []
    for f in range(width):
        if f in arity:
            cuts.append(np.array([0.5]))
            continue
        values, counts = np.unique(x[:, f][x[:, f] != 0], return_counts=True) if x.size else (np.array([]), np.array([]))
        cuts.append(_thresholds(values, counts.astype(float), share * total, bins - 1))
    return cuts, total


def _thresholds(values: np.ndarray, counts: np.ndarray, samples: float, most: int) -> np.ndarray:
    if not len(values):
        return np.array([])
    zeros = samples - counts.sum()
    if zeros > EPSILON * counts.sum() * 100:
        at = int(np.searchsorted(values, 0.0))
        values, counts = np.insert(values, at, 0.0), np.insert(counts, at, zeros)
    middles = (values[:-1] + values[1:]) / 2.0
    if len(middles) <= most:
        return middles
    stride = samples / (most + 1)
    found, upto, target = [], np.cumsum(counts), stride
    for i in range(1, len(values)):
        if abs(upto[i - 1] - target) < abs(upto[i] - target):
            found.append(middles[i - 1])
            target += stride
    return np.array(found)


def _blocks(estimator, dataset: DataFrame, total: int, cuts: list[np.ndarray], logistic: bool) -> RDD:
    """(bins by feature, label, margin) of up to ``BLOCK`` rows each."""
    width = len(cuts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = [], 0
        for batch in batches:
            label = batch.column(1)
            if label.null_count:
                raise ValueError("a row to learn from has no label")
            y = label.to_numpy(zero_copy_only=False)
            x = batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
            if not (np.isfinite(x).all() and np.isfinite(y).all()):
                raise ValueError("a feature or label is not finite")
            if logistic and not np.isin(y, (0.0, 1.0)).all():
                raise ValueError("labels other than 0 and 1")
            b = np.empty((width, len(x)), np.uint8)
            for f, c in enumerate(cuts):
                b[f] = np.searchsorted(c, x[:, f], side="left")
            held.append((b, 2 * y - 1 if logistic else y))
            rows += len(y)
            if rows >= BLOCK:
                yield _packed(held)
                held, rows = [], 0
        if rows:
            yield _packed(held)

    rows = dataset.select(vector_to_array(estimator.getFeaturesCol()).alias("x"), F.col(estimator.getLabelCol()).cast("double").alias("y"))
    packed = rows.mapInArrow(run, "bins binary, label binary")
    tasks = min(-(-total // BLOCK), 2 * dataset.sparkSession.sparkContext.defaultParallelism)
    if packed.rdd.getNumPartitions() != tasks:  # even shares for all cores, if there are blocks enough
        packed = packed.repartition(tasks)
    read = packed.rdd.map(lambda r: (np.frombuffer(r[0], np.uint8).reshape(width, -1), np.frombuffer(r[1]), None))
    return read.persist(StorageLevel.MEMORY_AND_DISK)


def _packed(held: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
    bins, label = np.concatenate([b for b, _ in held], axis=1), np.concatenate([y for _, y in held])
    return pa.record_batch({"bins": pa.array([bins.tobytes()], pa.binary()), "label": pa.array([label.tobytes()], pa.binary())})


def _nodes(tree: dict[str, np.ndarray], bins: np.ndarray) -> np.ndarray:
    """The node each row of a block has come to."""
    rows = np.arange(bins.shape[1])
    flat, start = bins.reshape(-1), tree["feature"] * bins.shape[1]
    sides = np.where(tree["flip"], (tree["right"], tree["left"]), (tree["left"], tree["right"])).T.reshape(-1)
    at = np.zeros(bins.shape[1], np.intp)
    for _ in range(int(tree["depth"])):
        beyond = flat.take(start.take(at) + rows) > tree["cut"].take(at)
        at = sides.take(2 * at + beyond)
    return at


def _residual(label: np.ndarray, margin: np.ndarray | None, logistic: bool) -> np.ndarray:
    if margin is None:
        return label
    if not logistic:
        return 2.0 * (label - margin)
    with np.errstate(over="ignore"):
        return 4.0 * label / (1.0 + np.exp(2.0 * label * margin))


def _sums(blocks: RDD, tree: dict[str, np.ndarray], level: list[int], width: int, bins: int, logistic: bool) -> np.ndarray:
    """Rows, residuals and their squares (3, node, feature, bin) of the nodes of a level."""
    place = np.full(len(tree["left"]), -1)
    place[level] = np.arange(len(level))
    shape = (3, len(level), width, bins)

    def run(part: Iterator[tuple]) -> Iterator[np.ndarray]:
        out = np.zeros(shape)
        for b, label, margin in part:
            y = _residual(label, margin, logistic)
            at = place[_nodes(tree, b)]
            if (at < 0).any():
                use = np.flatnonzero(at >= 0)
                b, y, at = b[:, use], y[use], at[use]
            base, square = at * bins, y * y
            for f in range(width):
                cell = base + b[f]
                for i, weight in enumerate((None, y, square)):
                    out[i, :, f] += np.bincount(cell, weight, len(level) * bins).reshape(-1, bins)
        yield out

    found = blocks.mapPartitions(run)
    if found.getNumPartitions() > 64:
        return found.treeReduce(np.add)
    return sum(found.collect(), np.zeros(shape))


def _impurity(s: np.ndarray) -> np.ndarray:
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where(s[0] == 0, 0.0, (s[2] - s[1] * s[1] / s[0]) / s[0])


def _split(sums: np.ndarray, cuts: list[np.ndarray], arity: dict[int, int], own: np.ndarray | None) -> tuple[np.ndarray, float, tuple | None]:
    """Sums and gain of a node and its best split (feature, cut, flip, left sums, right sums), None if no split gains."""
    sums = sums.copy()
    flip = np.zeros(len(cuts), bool)
    for f in arity:  # categories by their mean, an empty one last
        n, s = sums[0, f, :2], sums[1, f, :2]
        means = [s[i] / n[i] if n[i] else np.inf for i in (0, 1)]
        if means[1] < means[0]:
            flip[f] = True
            sums[:, f, :2] = sums[:, f, 1::-1]
    upto = sums.cumsum(axis=2)
    left = upto[:, :, :-1]
    right = upto[:, :, -1:] - left
    real = np.arange(left.shape[2])[None, :] < np.array([len(c) for c in cuts])[:, None]
    if own is None:
        first = int(np.argmax(real.any(axis=1)))
        own = left[:, first, 0] + right[:, first, 0]
    impurity = float(_impurity(own))
    rows = left[0] + right[0]
    with np.errstate(divide="ignore", invalid="ignore"):
        gain = impurity - left[0] / rows * _impurity(left) - right[0] / rows * _impurity(right)
    gain = np.where(real & (left[0] >= 1) & (right[0] >= 1) & (gain >= 0), gain, -np.inf)
    f, cut = divmod(int(gain.argmax()), gain.shape[1]) if gain.size else (0, 0)
    if not gain.size or not gain[f, cut] > 0:
        return own, -1.0, None
    return own, float(gain[f, cut]), (f, cut, bool(flip[f]), left[:, f, cut], right[:, f, cut])


def _grow(blocks: RDD, cuts: list[np.ndarray], arity: dict[int, int], iterations: int, step: float, depth: int, logistic: bool) -> list[tuple[float, list[dict]]]:
    """(weight, nodes) of every tree; a node has its sums, gain and split."""
    width, bins = len(cuts), max(2, *(len(c) + 1 for c in cuts))
    trees, before = [], None
    for number in range(iterations):
        weight = step if number else 1.0
        nodes = [{"sums": None, "gain": -1.0, "feature": 0, "cut": 0, "flip": False, "left": 0, "right": 0}]
        level = [0]
        for at_depth in range(max(depth, 1)):  # a tree of depth 0 needs the sums of its root
            sums = _sums(blocks, _arrays(nodes, at_depth), level, width, bins, logistic)
            if before is not None:  # the first pass over the new margins has kept them
                before.unpersist()
                before = None
            below = []
            for i, at in enumerate(level):
                own, gain, split = _split(sums[:, i], cuts, arity, nodes[at]["sums"])
                nodes[at]["sums"] = own
                if split is None or at_depth == depth:
                    continue
                f, cut, flip, *sides = split
                nodes[at] |= {"gain": gain, "feature": f, "cut": cut, "flip": flip, "left": len(nodes), "right": len(nodes) + 1}
                for side in sides:
                    if at_depth + 1 < depth and abs(float(_impurity(side))) >= EPSILON:
                        below.append(len(nodes))
                    nodes.append({"sums": side, "gain": -1.0, "feature": 0, "cut": 0, "flip": False, "left": len(nodes), "right": len(nodes)})
            level = below
            if not level:
                break
        trees.append((weight, nodes))
        if number + 1 < iterations:
            grown, value = _arrays(nodes, depth), np.array([n["sums"][1] / n["sums"][0] if n["sums"][0] else 0.0 for n in nodes])
            before, blocks = blocks, _moved(blocks, grown, value, weight)
            blocks.persist(StorageLevel.MEMORY_AND_DISK)
            if (number + 1) % KEPT == 0:
                blocks.checkpoint()
    blocks.unpersist()
    return trees


def _moved(blocks: RDD, tree: dict[str, np.ndarray], value: np.ndarray, weight: float) -> RDD:
    """The blocks with the tree's values added to their margins."""

    def moved(block: tuple) -> tuple:
        bins, label, margin = block
        added = value[_nodes(tree, bins)] * weight
        return bins, label, added if margin is None else margin + added

    return blocks.map(moved)


def _arrays(nodes: list[dict], depth: int) -> dict[str, np.ndarray]:
    return {k: np.array([n[k] for n in nodes]) for k in ("feature", "cut", "flip", "left", "right")} | {"depth": np.array(depth)}


def _saved_nodes(nodes: list[dict], cuts: list[np.ndarray], arity: dict[int, int]) -> list[tuple]:
    """Nodes in MLlib's saved form, parents before their left and then their right part; equal leaves of one parent are one."""

    def build(at: int) -> dict:
        n = nodes[at]
        rows, total, _ = (float(v) for v in n["sums"])
        tree = {"prediction": total / rows if rows else 0.0, "impurity": float(_impurity(n["sums"])), "sums": n["sums"], "gain": -1.0, "sides": ()}
        if n["gain"] > 0:
            sides = build(n["left"]), build(n["right"])
            if not (sides[0]["prediction"] == sides[1]["prediction"] and not sides[0]["sides"] and not sides[1]["sides"]):
                f, cut = n["feature"], n["cut"]
                split = (f, [1.0 if n["flip"] else 0.0], arity[f]) if f in arity else (f, [float(cuts[f][cut])], -1)
                tree |= {"gain": n["gain"], "sides": sides, "split": split}
        return tree

    out: list = []

    def number(tree: dict) -> int:
        me = len(out)
        out.append(None)
        left, right = [number(side) for side in tree["sides"]] or (-1, -1)
        stats = [float(v) for v in tree["sums"]]
        out[me] = (me, tree["prediction"], tree["impurity"], stats, int(stats[0]), tree["gain"], left, right, tree.get("split", (-1, [], -1)))
        return me

    number(build(0))
    return out


def _model(spark, estimator, model_class, trees: list[tuple], width: int):
    """The trees as MLlib's model, by way of its saved form, which is deleted again."""
    path = scratch_path(spark, "grown-model")
    package = "classification" if model_class is GBTClassificationModel else "regression"

    def described(name: str, uid: str, params: dict, **more) -> str:
        of = f"org.apache.spark.ml.{name}"
        return json.dumps({"class": of, "timestamp": int(time.time() * 1000), "sparkVersion": spark.version, "uid": uid, "paramMap": params, "defaultParamMap": {}, **more})

    params = {p.name: v for p, v in (estimator._defaultParamMap | estimator._paramMap).items()}
    about = described(f"{package}.{model_class.__name__}", estimator.uid, params, numFeatures=width, numTrees=len(trees))
    rows = [(i, n) for i, (_, nodes) in enumerate(trees) for n in nodes]
    of_trees = [(i, described("regression.DecisionTreeRegressionModel", f"dtr_{uuid.uuid4().hex[:12]}", {}), float(w)) for i, (w, _) in enumerate(trees)]
    spark.createDataFrame([(about,)], "value string").coalesce(1).write.text(f"{path}/metadata")
    spark.createDataFrame(of_trees, "_1 int, _2 string, _3 double").coalesce(1).write.parquet(f"{path}/treesMetadata")
    spark.createDataFrame(rows, NODE).coalesce(1).write.parquet(f"{path}/data")
    model = model_class.load(path)
    saved = spark._jvm.org.apache.hadoop.fs.Path(path)
    saved.getFileSystem(spark._jsc.hadoopConfiguration()).delete(saved, True)
    return model
