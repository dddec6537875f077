"""Removing lines that many documents share, with an index that documents can leave again.

The index is a table of exact reference counts: for the 128-bit hash of each
line key, the number of documents that hold it. Beside it stand cuckoo
filters, one per shard of the keys, of the keys that reached the limit. They
have a fixed size, so their total is bounded and they are broadcast; a line
that a filter lets through is looked up in the exact table by a join, so no
line is dropped by a filter's error. A shard with more keys than fit lets
every line through, and the exact table alone decides. Inserting and deleting
documents adds to and takes from the counts, and moves the keys that cross the
limit into and out of the filters.

Null or empty text is one empty line; a key shorter than ``min_chars`` code
points never counts. A line that a document repeats counts once. Repeated
rows are documents of their own. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from girder.llm.kernels import text_bytes
from girder.session import settle

BLANKS = b" \t\n\x0b\x0c\r"
SLOTS = 4
KEY_SCHEMA = "k1 long, k2 long"


def line_key(line: bytes) -> bytes:
    return line.strip(BLANKS).lower()


def key_hashes(text: bytes, min_chars: int = 1) -> list[bytes | None]:
    """The 16-byte hash of each line's key; None for one that is too short to count."""
    out: list[bytes | None] = []
    for line in text.split(b"\n"):
        key = line_key(line)
        long_enough = len(key) >= min_chars and (min_chars < 2 or len(key.decode("utf-8", "replace")) >= min_chars)
        out.append(xxhash.xxh3_128_digest(key) if long_enough else None)
    return out


class CuckooFilter:
    """A set of 64-bit hash pairs with four 16-bit fingerprints a bucket; supports deletion."""

    def __init__(self, buckets: int, slots: np.ndarray | None = None, full: bool = False) -> None:
        self.buckets = buckets
        self.slots = np.zeros((buckets, SLOTS), np.uint16) if slots is None else slots
        self.full = full

    def to_bytes(self) -> bytes:
        return bytes([self.full]) + self.slots.tobytes()

    @classmethod
    def from_bytes(cls, data: bytes, writable: bool = False) -> CuckooFilter:
        slots = np.frombuffer(data, np.uint16, offset=1).reshape(-1, SLOTS)
        return cls(len(slots), slots.copy() if writable else slots, bool(data[0]))

    def _places(self, k1: np.ndarray, k2: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        mark = ((k2.astype(np.uint64) >> np.uint64(48)) | np.uint64(1)).astype(np.int64)
        first = (k1.astype(np.uint64) >> np.uint64(20)).astype(np.int64) & (self.buckets - 1)
        return mark, first, self._other(first, mark)

    def _other(self, place, mark):
        return (place ^ (mark * 0x5BD1E995)) & (self.buckets - 1)

    def contains(self, k1: np.ndarray, k2: np.ndarray) -> np.ndarray:
        if self.full:
            return np.ones(len(k1), bool)
        mark, one, two = self._places(k1, k2)
        mark = mark.astype(np.uint16)[:, None]
        return (self.slots[one] == mark).any(1) | (self.slots[two] == mark).any(1)

    def insert(self, k1: np.ndarray, k2: np.ndarray, kicks: int = 500) -> None:
        mark, one, two = self._places(k1, k2)
        for m, a, b in zip(mark.tolist(), one.tolist(), two.tolist(), strict=True):
            place = a if (self.slots[a] == 0).any() else b
            for turn in range(kicks):
                free = np.flatnonzero(self.slots[place] == 0)
                if len(free):
                    self.slots[place, free[0]] = m
                    break
                out = int(self.slots[place, turn % SLOTS])
                self.slots[place, turn % SLOTS] = m
                m, place = out, int(self._other(place, out))
            else:
                self.full = True
                return

    def delete(self, k1: np.ndarray, k2: np.ndarray) -> None:
        mark, one, two = self._places(k1, k2)
        for m, a, b in zip(mark.tolist(), one.tolist(), two.tolist(), strict=True):
            for place in (a, b):
                at = np.flatnonzero(self.slots[place] == m)
                if len(at):
                    self.slots[place, at[0]] = 0
                    break


@dataclass(frozen=True)
class LineIndex:
    """Exact counts of line keys (k1, k2, n) and the filters (shard, data) of the frequent ones."""

    counts: DataFrame
    filters: DataFrame
    min_docs: int = 10
    min_chars: int = 1
    shards: int = 64
    buckets: int = 4096

    @staticmethod
    def empty(spark: SparkSession, **settings: int) -> LineIndex:
        return LineIndex(
            spark.createDataFrame([], f"{KEY_SCHEMA}, n long"), spark.createDataFrame([], "shard int, data binary"), **settings
        )

    def insert(self, docs: DataFrame) -> LineIndex:
        return self._changed(docs, 1)

    def delete(self, docs: DataFrame) -> LineIndex:
        return self._changed(docs, -1)

    def _changed(self, docs: DataFrame, sign: int) -> LineIndex:
        change = _keys(docs, self.min_chars).groupBy("k1", "k2").agg((F.count("*") * sign).alias("change"))
        joined = self.counts.join(change, ["k1", "k2"], "full")
        was, change = F.coalesce("n", F.lit(0)), F.coalesce("change", F.lit(0))
        moved = settle(joined.select("k1", "k2", was.cast("long").alias("was"), (was + change).cast("long").alias("n")))
        counts = moved.where("n > 0").select("k1", "k2", "n")
        shard = F.pmod("k1", F.lit(self.shards)).cast("int")
        crossed = moved.where((F.col("n") >= self.min_docs) != (F.col("was") >= self.min_docs)).select(
            shard.alias("shard"), "k1", "k2", (F.col("n") >= self.min_docs).alias("enters")
        )
        # A shard with more keys than its filter holds is full without looking at
        # them, so what a task gathers is bounded by the filter's size.
        entering = F.broadcast(crossed.groupBy("shard").agg(F.count_if("enters").alias("entering")))  # a row a shard
        fits = crossed.join(entering, "shard").withColumn("over", F.col("entering") > self.buckets * SLOTS)
        crossed = fits.where("not over").drop("entering").unionByName(
            fits.where("over").groupBy("shard").agg(F.min("k1").alias("k1"), F.min("k2").alias("k2"), F.lit(True).alias("enters"), F.lit(True).alias("over"))
        )
        filters = crossed.groupBy("shard").cogroup(self.filters.groupBy("shard")).applyInPandas(
            _filter_update(self.buckets), "shard int, data binary"
        )
        return LineIndex(counts, settle(filters), self.min_docs, self.min_chars, self.shards, self.buckets)

    def dropped_lines(self, docs: DataFrame) -> DataFrame:
        """(row_key, other_key, dropped): for each document with shared lines, their line numbers."""
        data = {r["shard"]: bytes(r["data"]) for r in self.filters.collect()}  # at most shards * (8 * buckets + 1) bytes
        shared = docs.sparkSession.sparkContext.broadcast(data)
        passed = _keyed(docs).mapInArrow(
            _probe(shared, self.shards, self.min_chars), f"row_key long, other_key long, line int, {KEY_SCHEMA}"
        )
        frequent = self.counts.where(F.col("n") >= self.min_docs).select("k1", "k2")
        return (
            passed.join(frequent, ["k1", "k2"]).groupBy("row_key", "other_key").agg(F.collect_set("line").alias("dropped"))
        )

    def apply(self, docs: DataFrame) -> DataFrame:
        """``docs`` without the shared lines, with n_lines (before) and n_dropped."""
        own = [c for c in docs.columns if c.lower() not in ("n_lines", "n_dropped")]
        others = F.struct(*[c for c in own if c != "text"])
        keyed = docs.select(others.alias("own"), "text", *_row_keys()).join(self.dropped_lines(docs), ["row_key", "other_key"], "left")
        rows = keyed.select("own", "text", "dropped")
        schema = T.StructType([*rows.schema.fields[:2], T.StructField("n_lines", T.LongType()), T.StructField("n_dropped", T.LongType())])
        cut = rows.mapInArrow(_cut, schema)
        return cut.select(*[F.col(c) if c == "text" else F.col("own")[c].alias(c) for c in own], "n_lines", "n_dropped")


def _row_keys() -> list:
    """Two hashes of id and text stand for the row, as ids may repeat or be null."""
    return [F.xxhash64("doc_id", "text").alias("row_key"), F.xxhash64("text", "doc_id", F.lit(1)).alias("other_key")]


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.select("text", *_row_keys())


def _keys(docs: DataFrame, min_chars: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: list[bytes] = []
            for text in text_bytes(batch.column(0)):
                found.extend({k for k in key_hashes(text, min_chars) if k is not None})
            halves = np.frombuffer(b"".join(found), np.int64).reshape(-1, 2)
            yield pa.record_batch({"k1": halves[:, 0].copy(), "k2": halves[:, 1].copy()})

    return docs.select("text").mapInArrow(run, KEY_SCHEMA)


def _probe(shared, shards: int, min_chars: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filters = {k: CuckooFilter.from_bytes(v) for k, v in shared.value.items()}
        for batch in batches:
            rows, lines, found = [], [], []
            for i, text in enumerate(text_bytes(batch.column("text"))):
                for j, key in enumerate(key_hashes(text, min_chars)):
                    if key is not None:
                        rows.append(i)
                        lines.append(j)
                        found.append(key)
            halves = np.frombuffer(b"".join(found), np.int64).reshape(-1, 2)
            k1, k2 = halves[:, 0].copy(), halves[:, 1].copy()
            shard = k1 % shards
            keep = np.zeros(len(k1), bool)
            for s in np.unique(shard):
                if int(s) in filters:
                    at = np.flatnonzero(shard == s)
                    keep[at] = filters[int(s)].contains(k1[at], k2[at])
            at = np.flatnonzero(keep)
            owner = pa.array(np.asarray(rows, np.int64)[at])
            yield pa.record_batch(
                {
                    "row_key": batch.column("row_key").take(owner),
                    "other_key": batch.column("other_key").take(owner),
                    "line": np.asarray(lines, np.int32)[at],
                    "k1": k1[at],
                    "k2": k2[at],
                }
            )

    return run


def _filter_update(buckets: int):
    def run(key, moved: pd.DataFrame, old: pd.DataFrame) -> pd.DataFrame:
        held = CuckooFilter.from_bytes(bytes(old["data"].iloc[0]), True) if len(old) else CuckooFilter(buckets)
        held.full = held.full or bool(moved["over"].any())
        enters = moved["enters"].to_numpy(bool)
        k1, k2 = moved["k1"].to_numpy(np.int64), moved["k2"].to_numpy(np.int64)
        if not held.full:  # a full filter lets everything through for good
            held.delete(k1[~enters], k2[~enters])
            held.insert(k1[enters], k2[enters])
        return pd.DataFrame({"shard": [int(key[0])], "data": [held.to_bytes()]})

    return run


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts, n_lines, n_dropped = [], [], []
        column = batch.column("text")
        for raw, text, dropped in zip(column, text_bytes(column), batch.column("dropped").to_pylist(), strict=True):
            lines = text.split(b"\n")
            gone = set(dropped or ())
            texts.append((b"\n".join(x for i, x in enumerate(lines) if i not in gone)).decode() if raw.is_valid else None)
            n_lines.append(len(lines))
            n_dropped.append(len(gone))
        names = [c for c in batch.schema.names if c != "dropped"]
        columns = [pa.array(texts, pa.string()) if c == "text" else batch.column(c) for c in names]
        yield pa.RecordBatch.from_arrays(
            [*columns, pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64())], [*names, "n_lines", "n_dropped"]
        )


def dedup_lines(docs: DataFrame, **settings: int) -> DataFrame:
    """One run over a whole table: every document inserted, then its shared lines cut."""
    return LineIndex.empty(docs.sparkSession, **settings).insert(docs).apply(docs)

