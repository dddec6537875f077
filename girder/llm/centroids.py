"""Centroid clustering of vectors, with a vantage-point tree over the centroids.

Vectors of the right length without null, NaN or infinite components are kept;
a component x becomes the integer floor(scale * x), and all else is integer
arithmetic. The first centroids are the vectors whose ids hash smallest. In
each round the tree is built from the centroids and broadcast, every vector is
assigned to the nearest one, and tasks send one sum per cluster and component,
so neither a hot cluster nor a vector that fills a third of the table costs
more. Means are exact floors of whole sums.

The search for a vector visits the tree's nodes best-first, by the least
distance that the triangle inequality leaves to anything below. A node is cut
only if that is above the best distance found, so that a centroid as near as
the best is still met, and the smaller number wins. Distances are compared as
squared integers; the bounds are square roots with room for their rounding.
The vectors of a batch take their steps together.

Components beyond 2**27 in size would overflow 64-bit distances and stop the
run with an error. Null vectors, vectors of another length and those with bad
components are left out. Rows without id are clustered but are never first
centroids. Repeated rows are vectors of their own; equal hashes go by the
components. With fewer vectors than ``k`` each is a centroid; an empty table
gives an empty result. Columns named like an added one are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from girder.llm.scratch import scratch
from girder.session import settle

LEAF = 3
LARGEST = 1 << 27
CELLS = 1 << 22  # vectors times nodes that a step holds


def usable(vector: Column, size: int) -> Column:
    """Whether the vector has ``size`` components and all of them are numbers."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce((F.size(vector) == size) & ~bad, F.lit(False))


def whole(vector: Column, scale: int) -> Column:
    return F.transform(vector, lambda x: F.floor(x.cast("double") * scale))


def squared(vectors: np.ndarray, centroid: np.ndarray) -> np.ndarray:
    gaps = vectors - centroid
    return np.einsum("ij,ij->i", gaps, gaps)


def build_tree(centroids: np.ndarray, leaf: int = LEAF) -> list[tuple]:
    """Nodes: (members, children). A leaf has several members and no child; else one member, the vantage point.

    A child is (node, least, greatest distance of what is below it to the vantage point).
    """
    nodes: list[tuple] = []

    def grow(members: np.ndarray) -> int:
        at = len(nodes)
        nodes.append(())
        if len(members) <= leaf:
            nodes[at] = (members.tolist(), [])
            return at
        # A point far from the middle sees the others at the most different distances.
        middle = centroids[members].mean(axis=0)
        vantage = members[int(np.argmax(((centroids[members] - middle) ** 2).sum(axis=1)))]
        others = members[members != vantage]
        reach = squared(centroids[others], centroids[vantage])
        order = np.argsort(reach, kind="stable")
        others, reach = others[order], np.sqrt(reach[order].astype(np.float64))
        half = len(others) // 2
        children = [
            (grow(part), float(far[0]), float(far[-1])) for part, far in ((others[:half], reach[:half]), (others[half:], reach[half:]))
        ]
        nodes[at] = ([int(vantage)], children)
        return at

    grow(np.arange(len(centroids)))
    return nodes


def nearest(nodes: list[tuple], centroids: np.ndarray, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each vector the nearest centroid, the smaller number of equals, and the squared distance."""
    if len(vectors) and int(np.abs(vectors).max()) > LARGEST:
        raise ValueError(f"a component beyond {LARGEST} in size has no 64-bit distance")
    which, best = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    step = max(1, CELLS // len(nodes))
    for start in range(0, len(vectors), step):
        found = _search(nodes, centroids, vectors[start : start + step])
        which.append(found[0])
        best.append(found[1])
    return np.concatenate(which), np.concatenate(best)


def _search(nodes: list[tuple], centroids: np.ndarray, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    best = np.full(len(vectors), np.iinfo(np.int64).max)
    which = np.full(len(vectors), len(centroids))
    # The least distance to anything below each node still to be visited.
    least = np.full((len(vectors), len(nodes)), np.inf)
    least[:, 0] = 0.0
    active = np.arange(len(vectors))
    while len(active):
        node = least[active].argmin(axis=1)
        bound = least[active, node]
        going = (bound < np.inf) & (bound <= np.sqrt(best[active].astype(np.float64)))
        active, node, bound = active[going], node[going], bound[going]
        least[active, node] = np.inf
        for at in np.unique(node):
            here = node == at
            rows = active[here]
            members, children = nodes[at]
            for c in members:
                away = squared(vectors[rows], centroids[c])
                better = (away < best[rows]) | ((away == best[rows]) & (c < which[rows]))
                best[rows[better]], which[rows[better]] = away[better], c
            if children:
                reach = np.sqrt(away.astype(np.float64))
                for child, low, high in children:
                    gap = np.maximum(reach - high, low - reach) - 1e-9 * (reach + high)
                    least[rows, child] = np.maximum(bound[here], gap)
    return which, best


def _matrix(column: pa.Array, size: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, size)


def _round_sums(vectors: DataFrame, centroids: np.ndarray) -> tuple[np.ndarray, list[int]]:
    """Members and summed components of every cluster: at most one row per cluster and component is gathered."""
    spark, size = vectors.sparkSession, centroids.shape[1]
    sent = spark.sparkContext.broadcast((build_tree(centroids), centroids))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nodes, points = sent.value
        sums, members = np.zeros(points.shape, np.int64), np.zeros(len(points), np.int64)
        for batch in batches:
            rows = _matrix(batch.column(0), size)
            which, _ = nearest(nodes, points, rows)
            order = np.argsort(which, kind="stable")
            heads = np.flatnonzero(np.diff(which[order], prepend=-1))
            if len(heads):
                sums[which[order][heads]] += np.add.reduceat(rows[order], heads, axis=0)
            members += np.bincount(which, minlength=len(points))
        used = np.flatnonzero(members)
        yield pa.record_batch(
            {
                "cluster": np.repeat(used, size),
                "place": np.tile(np.arange(size), len(used)),
                "total": sums[used].ravel(),
                "members": np.repeat(members[used], size),
            }
        )

    found = vectors.mapInArrow(run, "cluster long, place long, total long, members long").groupBy("cluster", "place")
    rows = found.agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total"), F.sum("members").alias("members")).collect()
    after, counts = centroids.copy(), [0] * len(centroids)
    for r in rows:
        after[r["cluster"], r["place"]] = int(r["total"]) // r["members"]
        counts[r["cluster"]] = r["members"]
    return after, counts


def first_centroids(vectors: DataFrame, k: int, size: int, seed: int) -> np.ndarray:
    """Up to ``k`` vectors (vec_id, _whole) with the smallest sha256 of ``seed:vec_id``."""
    named = vectors.where("vec_id is not null").select(F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256).alias("h"), "_whole")
    rows = named.orderBy("h", "_whole").limit(k).collect()
    return np.array([r["_whole"] for r in rows], np.int64).reshape(-1, size)


def cluster(vectors: DataFrame, k: int = 40, size: int = 64, rounds: int = 5, seed: int = 2, scale: int = 256) -> DataFrame:
    """The kept rows of ``vectors`` (vec_id, embedding) with cluster, distance, cluster_inertia, inertia and centroid (its integers).

    The assignment is the one after ``rounds`` updates; empty clusters keep
    their centroid.
    """
    spark = vectors.sparkSession
    added = ("cluster", "distance", "cluster_inertia", "inertia", "centroid", "_whole")
    own = [c for c in vectors.columns if c.lower() not in added]
    kept = vectors.where(usable(F.col("embedding"), size)).select(*own, whole(F.col("embedding"), scale).alias("_whole"))
    with scratch(spark) as store:
        slim = store(kept.select("vec_id", "_whole"))
        centroids = first_centroids(slim, k, size, seed)
        if len(centroids):
            for _ in range(rounds):
                centroids, _ = _round_sums(slim.select("_whole"), centroids)
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in vectors.schema.fields if f.name in own)
    if not len(centroids):
        fields = f"{kinds}, cluster int, distance long, cluster_inertia long, inertia long, centroid array<bigint>"
        return spark.createDataFrame([], fields)
    sent = spark.sparkContext.broadcast((build_tree(centroids), centroids))

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nodes, points = sent.value
        for batch in batches:
            which, best = nearest(nodes, points, _matrix(batch.column("_whole"), size))
            names = [c for c in batch.schema.names if c != "_whole"]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in names), pa.array(which.astype(np.int32)), pa.array(best)], [*names, "cluster", "distance"]
            )

    assigned = settle(kept.mapInArrow(assign, f"{kinds}, cluster int, distance long"))
    inertia = {r["cluster"]: int(r["inertia"]) for r in assigned.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("inertia")).collect()}
    whole_inertia = sum(inertia.values())
    rows = [(c, n, whole_inertia, [int(x) for x in centroids[c]]) for c, n in sorted(inertia.items())]
    summary = spark.createDataFrame(rows, "cluster int, cluster_inertia long, inertia long, centroid array<bigint>")  # k rows at most
    joined = assigned.join(F.broadcast(summary), "cluster")
    return joined.select(*own, "cluster", "distance", "cluster_inertia", "inertia", "centroid")
