"""Second-order boosting of regression trees on binned features.

Every feature is cut at its quantiles once, and a row becomes a few bytes of
bin numbers. A tree grows level by level: each task sums gradients and
curvatures of its rows by node, feature and bin, Spark adds these histograms
up, and the best split of every node is read off them. A node with gradient
sum G and curvature sum H has the value -G / (H + penalty); a split gains
GL^2 / (HL + penalty) + GR^2 / (HR + penalty) - G^2 / (H + penalty). What is
gathered is one row per node, feature and bin, whatever the size of the data.

Gradients are summed as whole numbers (in units of 2^-30 of the largest one
possible at the start), so any partitioning grows the same trees. Margins of
past trees are written to the checkpoint folder every ``KEEP`` trees; a pass
evaluates only those since. Rows of the fold that is held out do not grow
trees: their loss after each tree decides when to stop.

A NULL or NaN feature counts as below every cut. Rows without a label are left
out of a fit. The logistic loss takes labels 0 and 1.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from girder.session import packed, settle

KEEP = 10
UNIT = 1 << 30


@dataclass(frozen=True)
class Settings:
    iterations: int = 100
    step: float = 0.1
    depth: int = 5
    bins: int = 64  # 255 at most
    penalty: float = 1.0
    least_curvature: float = 1.0
    least_gain: float = 0.0
    loss: str = "squared"  # or "logistic"
    patience: int = 10  # trees without a lower loss of the held-out fold before it stops


@dataclass
class Boosted:
    """Cuts of the features, the first margin and the trees: lists of (feature, cut number, left, right, value) by node.

    ``losses`` are the mean losses of the held-out fold before the first tree and after each.
    """

    features: list[str]
    settings: Settings
    cuts: list[np.ndarray]
    base: float
    trees: list[dict] = field(default_factory=list)
    losses: list[float] = field(default_factory=list)


def _values(tree: dict, bins: np.ndarray) -> np.ndarray:
    """The tree's value for every row of bin numbers."""
    return tree["value"][_nodes(tree, bins)]


def _nodes(tree: dict, bins: np.ndarray) -> np.ndarray:
    at = np.zeros(len(bins), np.int64)
    while True:
        open_ = np.flatnonzero(tree["left"][at] >= 0)
        if not len(open_):
            return at
        n = at[open_]
        goes_left = bins[open_, tree["feature"][n]] <= tree["cut"][n]
        at[open_] = np.where(goes_left, tree["left"][n], tree["right"][n])


def _slopes(loss: str, margin: np.ndarray, label: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Gradient, curvature and loss of every row."""
    if loss == "squared":
        miss = margin - label
        return miss, np.ones(len(miss)), miss * miss
    chance = 1 / (1 + np.exp(-np.clip(margin, -40, 40)))
    return chance - label, np.maximum(chance * (1 - chance), 1e-12), -(label * np.log(chance + 1e-15) + (1 - label) * np.log(1 - chance + 1e-15))


def quantile_cuts(rows: DataFrame, features: Sequence[str], bins: int) -> list[np.ndarray]:
    """Up to ``bins`` - 1 cuts per feature; a feature with few values is cut at each of them."""
    shares = [i / bins for i in range(1, bins)]
    found = rows.agg(*[F.percentile_approx(F.nanvl(F.col(f).cast("double"), F.lit(None).cast("double")), shares, 10_000).alias(f"q{i}") for i, f in enumerate(features)]).first()
    return [np.unique(np.array(q or [], np.float64)) for q in found]


def binned(x: np.ndarray, cuts: list[np.ndarray]) -> np.ndarray:
    """Bin numbers (rows, features): how many cuts lie below the value."""
    out = np.zeros(x.shape, np.uint8)
    for i, c in enumerate(cuts):
        out[:, i] = np.searchsorted(c, np.where(np.isnan(x[:, i]), -np.inf, x[:, i]), side="left")
    return out


def _to_bins(rows: DataFrame, features: Sequence[str], cuts: list[np.ndarray], held_out: Column, label: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.stack([batch.column(i).to_numpy(zero_copy_only=False) for i in range(len(cuts))], axis=1) if batch.num_rows else np.zeros((0, len(cuts)))
            packed = binned(x, cuts)
            yield pa.record_batch(
                {
                    "bins": pa.array([r.tobytes() for r in packed], pa.binary()),
                    "label": batch.column("label"),
                    "held_out": batch.column("held_out"),
                    "margin": np.zeros(len(packed)),
                }
            )

    columns = [F.col(f).cast("double").alias(f"x{i}") for i, f in enumerate(features)]
    known = rows.where(F.col(label).isNotNull())
    return known.select(*columns, F.col(label).cast("double").alias("label"), F.coalesce(held_out, F.lit(False)).alias("held_out")).mapInArrow(
        run, "bins binary, label double, held_out boolean, margin double"
    )


def _parts(batch: pa.RecordBatch, width: int) -> tuple[np.ndarray, ...]:
    bins = np.frombuffer(b"".join(batch.column("bins").to_pylist()), np.uint8).reshape(-1, width)
    return bins, *(batch.column(c).to_numpy(zero_copy_only=False) for c in ("label", "held_out", "margin"))


def best_splits(cells: dict[int, tuple[float, float]], nodes: int, widths: list[int], settings: Settings) -> list[tuple | None]:
    """For each node the best (feature, cut number, left sums, right sums), or None; equal gains go to the first feature and cut.

    ``cells`` has the sums (gradient, curvature) of a node, feature and bin, numbered in this order.
    """
    stride = max(widths)
    table = np.zeros((2, nodes * len(widths) * stride))
    for cell, sums in cells.items():
        table[:, cell] = sums
    table = table.reshape(2, nodes, len(widths), stride)
    out: list[tuple | None] = []
    for n in range(nodes):
        total = table[:, n, 0].sum(axis=1)
        left = table[:, n].cumsum(axis=2)[:, :, :-1]
        right = total[:, None, None] - left
        rooms = (np.minimum(left[1], right[1]) >= settings.least_curvature) & (left[1] > 0) & (right[1] > 0)
        rooms &= np.arange(stride - 1)[None, :] < np.array(widths)[:, None] - 1
        worth = lambda s: s[0] ** 2 / (s[1] + settings.penalty)
        with np.errstate(divide="ignore", invalid="ignore"):
            gain = np.where(rooms, worth(left) + worth(right) - worth(total), -np.inf)
        best = int(gain.argmax()) if gain.size else 0
        if not gain.size or gain.flat[best] <= settings.least_gain + 1e-12:
            out.append(None)
            continue
        f, cut = divmod(best, stride - 1)
        out.append((f, cut, tuple(left[:, f, cut]), tuple(right[:, f, cut])))
    return out


def _sums(rows: DataFrame, model: Boosted, trees: list[dict], grown: dict, level: list[int], unit: float) -> tuple[dict, float, int]:
    """Histogram cells of the nodes of a level, and the loss and number of the held-out rows; one row per cell is gathered."""
    widths = [len(c) + 1 for c in model.cuts]
    stride, loss, base = max(widths), model.settings.loss, model.base
    sent = rows.sparkSession.sparkContext.broadcast((trees, grown, np.array(level)))
    total = len(level) * len(widths) * stride

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees, grown, level = sent.value
        place = np.full(len(grown["left"]), -1)
        place[level] = np.arange(len(level))
        g_sum, h_sum = np.zeros(total, np.int64), np.zeros(total, np.int64)
        missed, judged = 0.0, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            bins, label, held_out, margin = _parts(batch, len(widths))
            held_out = held_out.astype(bool)
            margin = base + margin + sum((_values(t, bins) for t in trees), np.zeros(len(bins)))
            g, h, lost = _slopes(loss, margin, label)
            missed, judged = missed + float(lost[held_out].sum()), judged + int(held_out.sum())
            at = place[_nodes(grown, bins)]
            use = (at >= 0) & ~held_out
            cells = ((at[use, None] * len(widths) + np.arange(len(widths))) * stride + bins[use]).ravel()
            for sums, value in ((g_sum, g), (h_sum, h)):
                whole = np.rint(value[use] * unit).astype(np.int64)
                np.add.at(sums, cells, np.repeat(whole, len(widths)))
        used = np.flatnonzero((g_sum != 0) | (h_sum != 0))
        yield pa.record_batch(
            {
                "cell": np.append(used, -1), "g": np.append(g_sum[used], 0), "h": np.append(h_sum[used], 0),
                "loss": np.append(np.zeros(len(used)), missed), "judged": np.append(np.zeros(len(used), np.int64), judged),
            }
        )

    found = rows.mapInArrow(run, "cell long, g long, h long, loss double, judged long").groupBy("cell")
    table = found.agg(*[F.sum(c).alias(c) for c in ("g", "h", "loss", "judged")]).collect()
    held = next((r for r in table if r["cell"] == -1), None)
    cells = {r["cell"]: (r["g"] / unit, r["h"] / unit) for r in table if r["cell"] >= 0}
    return cells, (held["loss"] if held else 0.0), (held["judged"] if held else 0)


def fit(rows: DataFrame, features: Sequence[str], label: str, settings: Settings = Settings(), held_out: Column | None = None) -> Boosted:
    """Trees on the rows that ``held_out`` does not name; with it, as many as lower the loss of the others."""
    cuts = quantile_cuts(rows, features, settings.bins)
    data = settle(_to_bins(rows, features, cuts, F.lit(False) if held_out is None else held_out, label))
    own = data.where("not held_out").agg(F.avg("label").alias("mean"), F.max(F.abs("label")).alias("most"), F.count("*").alias("n")).first()
    if not own.n:
        raise ValueError("no row to learn from")
    data = packed(data)
    base, most = own.mean, 2 * own.most
    if settings.loss == "logistic":
        share = min(max(own.mean, 1e-6), 1 - 1e-6)
        base, most = math.log(share / (1 - share)), 1.0
    unit = UNIT / max(most, 1.0)
    model = Boosted(list(features), settings, cuts, base)
    widths = [len(c) + 1 for c in cuts]
    since: list[dict] = []
    for _ in range(settings.iterations):
        nodes = [{"feature": -1, "cut": -1, "left": -1, "right": -1, "value": 0.0}]
        level = [0]
        for depth in range(settings.depth):
            grown = {k: np.array([n[k] for n in nodes]) for k in nodes[0]}
            cells, lost, judged = _sums(data, model, since, grown, level, unit)
            if depth == 0 and judged:
                model.losses.append(lost / judged)
                if len(model.losses) - 1 - int(np.argmin(model.losses)) >= settings.patience:
                    return _shortest(model)
            below = []
            for at, split in zip(level, best_splits(cells, len(level), widths, settings), strict=True):
                if split is None:
                    continue
                f, cut, *sides = split
                nodes[at] |= {"feature": f, "cut": cut, "left": len(nodes), "right": len(nodes) + 1}
                for g, h in sides:
                    below.append(len(nodes))
                    nodes.append({"feature": -1, "cut": -1, "left": -1, "right": -1, "value": -settings.step * g / (h + settings.penalty)})
            level = below
            if not level:
                break
        if len(nodes) == 1:
            break  # nothing left to gain
        tree = {k: np.array([n[k] for n in nodes]) for k in nodes[0]}
        model.trees.append(tree)
        since.append(tree)
        if len(since) == KEEP:
            data, since = settle(_with_margins(data, since, len(widths))), []
    if model.losses:
        root = {k: np.array([v]) for k, v in (("feature", -1), ("cut", -1), ("left", -1), ("right", -1), ("value", 0.0))}
        _, lost, judged = _sums(data, model, since, root, [0], unit)
        model.losses.append(lost / judged)
    return _shortest(model)


def _shortest(model: Boosted) -> Boosted:
    """The model up to the tree after which the held-out loss was least."""
    if model.losses:
        model.trees = model.trees[: int(np.argmin(model.losses))]
    return model


def _with_margins(data: DataFrame, trees: list[dict], width: int) -> DataFrame:
    sent = data.sparkSession.sparkContext.broadcast(trees)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bins, label, held_out, margin = _parts(batch, width)
            margin = margin + sum((_values(t, bins) for t in sent.value), np.zeros(len(bins)))
            yield pa.RecordBatch.from_arrays([batch.column("bins"), batch.column("label"), batch.column("held_out"), pa.array(margin)], batch.schema.names)

    return data.mapInArrow(run, "bins binary, label double, held_out boolean, margin double")


def predict(df: DataFrame, model: Boosted, name: str = "prediction") -> DataFrame:
    """Adds the prediction: the value for the squared loss, the chance of 1 for the logistic one."""
    cuts, trees, base, logistic = model.cuts, model.trees, model.base, model.settings.loss == "logistic"

    @F.pandas_udf("double")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for x in batches:
            values = np.array([[np.nan if v is None else v for v in row] for row in x], np.float64).reshape(len(x), len(cuts))
            bins = binned(values, cuts)
            margin = base + sum((_values(t, bins) for t in trees), np.zeros(len(bins)))
            yield pd.Series(1 / (1 + np.exp(-margin)) if logistic else margin)

    return df.withColumn(name, run(F.array(*[F.col(f).cast("double") for f in model.features])))
