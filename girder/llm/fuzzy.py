"""Context-triggered piecewise fingerprints and their likeness.

A rolling hash of the last seven bytes cuts a text into chunks wherever its
low bits are all ones; each chunk adds one character to a signature, so an
edit changes the characters near it and no others. The block size, a power of
two, follows from the length: a fingerprint is ``block:signature:signature``
with the second at twice the block size. Two fingerprints are compared where
their block sizes meet: likeness is 1 minus the edit distance of the
signatures (insertions and deletions) over their joint length.

Null text is empty; an empty text has two empty signatures. Equal texts have
equal fingerprints and likeness 1. A task holds the arrays of about a
megabyte of text, or of one longer text, at a time.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from girder.llm.kernels import BASE, BASE_INVERSE, byte_values, mix, powers
from girder.session import settle

WINDOW = 7
LONGEST = 64
SMALLEST = 4
LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
CODES = np.frombuffer(LETTERS.encode(), np.uint8)
GROUP = 1 << 20


class Fingerprinter:
    """Fingerprints of byte strings; keeps the tables of powers between calls."""

    def __init__(self) -> None:
        self.values = byte_values(fold=False)
        self.up = powers(GROUP, BASE)
        self.down = powers(GROUP, BASE_INVERSE)

    def many(self, texts: list[bytes]) -> list[str]:
        out: list[str] = []
        group: list[bytes] = []
        size = 0
        for text in texts:
            if group and size + len(text) > GROUP:
                out += self._group(group)
                group, size = [], 0
            group.append(text)
            size += len(text)
        return out + (self._group(group) if group else [])

    def _group(self, texts: list[bytes]) -> list[str]:
        joined = np.frombuffer(b"".join(texts), np.uint8)
        if len(joined) + 1 > len(self.up):
            self.up, self.down = powers(len(joined) + 1, BASE), powers(len(joined) + 1, BASE_INVERSE)
        values = self.values[joined]
        sums = np.zeros(len(joined) + 1, np.uint64)
        np.cumsum(values * self.up[: len(joined)], out=sums[1:])
        if len(joined) >= WINDOW:
            # Hash of the seven bytes that end before each place.
            rolling = mix((sums[WINDOW:] - sums[:-WINDOW]) * self.down[: len(joined) - WINDOW + 1])
            # Places where a block of the smallest size may end, and up to which size.
            ends = np.flatnonzero((rolling & np.uint64(SMALLEST - 1)) == SMALLEST - 1)
            kept = rolling[ends]
            ends = ends + WINDOW
        else:
            ends, kept = np.zeros(0, np.int64), np.zeros(0, np.uint64)
        bounds = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
        lows = np.searchsorted(ends, bounds[:-1] + WINDOW)
        highs = np.searchsorted(ends, bounds[1:], side="right")
        return [
            self._one(sums, int(bounds[i]), int(bounds[i + 1]), ends[lows[i] : highs[i]], kept[lows[i] : highs[i]])
            for i in range(len(texts))
        ]

    def _one(self, sums: np.ndarray, start: int, end: int, ends: np.ndarray, rolling: np.ndarray) -> str:
        block = SMALLEST
        while block * LONGEST < end - start:
            block *= 2
        while True:
            at = ends[(rolling & np.uint64(block - 1)) == block - 1]
            if len(at) >= LONGEST // 2 or block == SMALLEST:
                break
            block //= 2
        wide = ends[(rolling & np.uint64(2 * block - 1)) == 2 * block - 1]
        return f"{block}:{self._signature(sums, start, end, at)}:{self._signature(sums, start, end, wide)}"

    def _signature(self, sums: np.ndarray, start: int, end: int, ends: np.ndarray) -> str:
        """One letter a chunk; the last of the longest signature covers all that is left."""
        if start == end:
            return ""
        ends = ends[: LONGEST - 1]
        if not len(ends) or ends[-1] != end:
            ends = np.append(ends, end)
        elif len(ends) == LONGEST - 1:
            ends = ends.copy()
            ends[-1] = end
        starts = np.concatenate([[start], ends[:-1]])
        letters = mix((sums[ends] - sums[starts]) * self.down[starts]) >> np.uint64(58)
        return CODES[letters.astype(np.int64)].tobytes().decode()


def _common(one: list[str], two: list[str]) -> np.ndarray:
    """Lengths of the longest common subsequences of pairs of signatures, by bits of one word a pair."""
    place = np.zeros(256, np.int64)
    place[CODES] = np.arange(64)
    n = len(one)
    masks = np.zeros((n, 64), np.uint64)
    rows = np.repeat(np.arange(n), [len(x) for x in one])
    letters = place[np.frombuffer("".join(one).encode(), np.uint8)]
    offsets = np.concatenate([np.arange(len(x)) for x in one]) if len(rows) else np.zeros(0, np.int64)
    np.bitwise_or.at(masks, (rows, letters), np.uint64(1) << offsets.astype(np.uint64))
    lengths = np.array([len(x) for x in two])
    other = np.full((n, int(lengths.max(initial=0))), -1, np.int64)
    other[np.arange(other.shape[1])[None, :] < lengths[:, None]] = place[np.frombuffer("".join(two).encode(), np.uint8)]
    state = np.full(n, ~np.uint64(0), np.uint64)
    every = np.arange(n)
    for j in range(other.shape[1]):
        letter = other[:, j]
        met = np.where(letter >= 0, masks[every, letter], np.uint64(0)) & state
        state = (state + met) | (state - met)
    first = np.array([len(x) for x in one], np.uint64)
    used = np.where(first == 64, ~np.uint64(0), (np.uint64(1) << (first % np.uint64(64))) - np.uint64(1))
    return np.bitwise_count(~state & used).astype(np.int64)


def likeness(one: list[str], two: list[str]) -> np.ndarray:
    """Likeness (0 to 1) of pairs of fingerprints; 0 where no block sizes meet."""
    pairs: list[tuple[int, str, str]] = []
    out = np.zeros(len(one))
    for i, (a, b) in enumerate(zip(one, two, strict=True)):
        if a == b:
            out[i] = 1.0
            continue
        block_a, a1, a2 = a.split(":")
        block_b, b1, b2 = b.split(":")
        size_a, size_b = int(block_a), int(block_b)
        if size_a == size_b:
            pairs += [(i, a1, b1), (i, a2, b2)]
        elif size_a == 2 * size_b:
            pairs.append((i, a1, b2))
        elif size_b == 2 * size_a:
            pairs.append((i, a2, b1))
    pairs = [p for p in pairs if p[1] and p[2]]
    if pairs:
        both = np.array([len(a) + len(b) for _, a, b in pairs])
        shared = _common([a for _, a, _ in pairs], [b for _, _, b in pairs])
        np.maximum.at(out, [i for i, _, _ in pairs], 2.0 * shared / both)
    return out


def edit_tail(text: str, follower: str) -> str:
    """The text with its last quarter replaced by as much of the start of another."""
    gone = len(text) // 4
    return text[: len(text) - gone] + follower[:gone]


FIELDS = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _compared(tools: Fingerprinter, ids: list, texts: list[str], followers: list[str], prints: list[str], next_prints: list[str]) -> dict:
    edited = [edit_tail(a, b).encode() for a, b in zip(texts, followers, strict=True)]
    edited_prints = tools.many(edited)
    return {
        "doc_id": pa.array(ids, pa.int64()),
        "n_chars": pa.array([len(t) for t in texts], pa.int64()),
        "edited_sha256": pa.array([hashlib.sha256(t).hexdigest() for t in edited], pa.string()),
        "fingerprint": pa.array(prints, pa.string()),
        "edited_fingerprint": pa.array(edited_prints, pa.string()),
        "near_edited": likeness(prints, edited_prints),
        "near_next": likeness(prints, next_prints),
    }


def _within(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of one sorted partition, each compared with the one after it; its two ends are left as texts."""
    tools = Fingerprinter()
    held: tuple[int | None, str, str] | None = None
    edge = {"n_chars": 0, "edited_sha256": None, "fingerprint": None, "edited_fingerprint": None, "near_edited": 0.0, "near_next": 0.0}

    def ends(kind: int, doc_id: int | None, text: str) -> pa.RecordBatch:
        columns = {"doc_id": pa.array([doc_id], pa.int64())}
        columns |= {k: pa.array([v], pa.string() if v is None else None) for k, v in edge.items()}
        return pa.record_batch(columns | {"part_end": pa.array([kind], pa.int32()), "text": pa.array([text], pa.string())})

    for batch in batches:
        ids = batch.column("doc_id").to_pylist()
        texts = [t or "" for t in batch.column("text").to_pylist()]
        if not ids:
            continue
        prints = tools.many([t.encode() for t in texts])
        if held is None:
            yield ends(1, ids[0], texts[0])
        else:
            ids, texts, prints = [held[0], *ids], [held[1], *texts], [held[2], *prints]
        held = (ids[-1], texts[-1], prints[-1])
        n = len(ids) - 1
        if n:
            done = _compared(tools, ids[:-1], texts[:-1], texts[1:], prints[:-1], prints[1:])
            yield pa.record_batch(done | {"part_end": np.zeros(n, np.int32), "text": pa.nulls(n, pa.string())})
    if held is not None:
        yield ends(2, held[0], held[1])


def _across(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    tools = Fingerprinter()
    for batch in batches:
        texts, followers = batch.column("text").to_pylist(), batch.column("follower").to_pylist()
        prints = tools.many([t.encode() for t in texts])
        next_prints = tools.many([t.encode() for t in followers])
        yield pa.record_batch(_compared(tools, batch.column("doc_id").to_pylist(), texts, followers, prints, next_prints))


def fingerprints(docs: DataFrame) -> DataFrame:
    """``docs`` with the fingerprint of every text."""
    own = [c for c in docs.columns if c != "fingerprint"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tools = Fingerprinter()
        for batch in batches:
            found = tools.many([(t or "").encode() for t in batch.column("text_").to_pylist()])
            names = [c for c in batch.schema.names if c != "text_"]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(found, pa.string())], [*names, "fingerprint"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields if f.name in own)
    return docs.select(*own, F.col("text").alias("text_")).mapInArrow(run, f"{schema}, fingerprint string")


def compare_neighbours(docs: DataFrame) -> DataFrame:
    """Every document against its edited text and against the next one by doc_id (after the last: the first).

    Documents are dealt by ranges of doc_id and compared along each range; only
    the first and last text of every range are handled apart, two rows a
    partition. Rows of one doc_id follow in the order of their texts.
    """
    ordered = docs.select(F.col("doc_id").cast("long"), "text").repartitionByRange("doc_id").sortWithinPartitions(
        F.col("doc_id").asc_nulls_first(), "text"
    )
    found = settle(ordered.mapInArrow(_within, f"{FIELDS}, part_end int, text string"))
    in_order = Window.orderBy(F.col("doc_id").asc_nulls_first(), "part_end")
    edges = found.where("part_end > 0").select("doc_id", "part_end", "text")
    whole = in_order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    follower = F.coalesce(F.lead("text").over(in_order), F.first("text").over(whole))
    across = edges.withColumn("follower", follower).where("part_end = 2").drop("part_end").mapInArrow(_across, FIELDS)
    return found.where("part_end = 0").drop("part_end", "text").unionByName(across)
