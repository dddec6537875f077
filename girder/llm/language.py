"""Language identification by rank-order profiles of character n-grams.

A language's profile is its most frequent n-grams in order. A document's own
most frequent n-grams are compared to each profile: every n-gram adds the
distance of its two ranks, or the length of the profile if it is not in it
("out of place"). The nearest profile wins.

Words are runs of letters, lower-cased, with a blank at both ends; n-grams of
one to three characters do not cross them. Counts of a language are summed in
each task first, so a language that holds most rows does no harm, and cover
every learning document; every text counts whole.

A null text, or one without a letter, is ``und`` with score 0, as is every
text if nothing was learned. Learning rows with a null language are left out.
Ties of counts go by the n-gram's code points, ties of distance by the
language's name.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

GRAMS = 3
DEPTH = 300
BITS = np.uint64(21)
BLANK = np.uint64(32)
PIECE = 1 << 19


def _letter_runs(text: str) -> np.ndarray:
    """Code points of the lower-cased text with every non-letter a blank, and blanks at both ends."""
    codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    out = np.full(len(codes) + 2, 32, np.uint64)
    out[1:-1] = codes
    small = codes < 128
    letter = (codes - 97 < 26) & small
    others = np.flatnonzero(~small)
    if len(others):
        kinds, back = np.unique(codes[others], return_inverse=True)
        letter[others] = np.fromiter((chr(c).isalpha() for c in kinds), bool, len(kinds))[back]
    out[1:-1][~letter] = 32
    return out


def _pieces(text: str) -> Iterator[str]:
    """A long text in parts that end between words, or at PIECE characters in a word without end."""
    start = 0
    while len(text) - start > PIECE:
        end = start + PIECE
        while end < len(text) and end - start < 2 * PIECE and text[end].isalpha():
            end += 1
        yield text[start:end]
        start = end
    yield text[start:]


def gram_counts(text: str) -> tuple[np.ndarray, np.ndarray]:
    """The distinct n-grams of a text, packed into 64 bits, and their counts."""
    found = []
    for piece in _pieces(text):
        codes = _letter_runs(piece)
        inner = codes != BLANK
        grams = codes.copy()
        keep = inner
        found.append(codes[inner])
        for n in range(2, GRAMS + 1):
            grams = (grams[:-1] << BITS) | codes[n - 1 :]
            # A blank may only begin or end an n-gram.
            middle = np.ones(len(grams), bool)
            for k in range(1, n - 1):
                middle &= inner[k : k + len(grams)]
            keep = middle & (inner[: len(grams)] | inner[n - 1 :])
            found.append(grams[keep])
    return np.unique(np.concatenate(found), return_counts=True)


def _top(grams: np.ndarray, counts: np.ndarray, depth: int) -> np.ndarray:
    """The most frequent n-grams in order; ties by the n-gram."""
    if len(grams) > depth:
        least = np.partition(counts, len(counts) - depth)[len(counts) - depth]
        at = counts >= least
        grams, counts = grams[at], counts[at]
    return grams[np.lexsort((grams, -counts))][:depth]


def learn_profiles(docs: DataFrame, depth: int = DEPTH) -> DataFrame:
    """(lang, gram, place): the ``depth`` most frequent n-grams of each language from (lang, text) rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts: dict[str, list] = {}
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist(), strict=True):
                parts.setdefault(lang, []).append(gram_counts(text))
            for lang, found in parts.items():
                grams, back = np.unique(np.concatenate([g for g, _ in found]), return_inverse=True)
                sums = np.bincount(back, np.concatenate([n for _, n in found]), len(grams)).astype(np.int64)
                yield pa.record_batch(
                    {"lang": pa.array([lang] * len(grams), pa.string()), "gram": grams.astype(np.int64), "n": sums}
                )

    counts = docs.where("lang is not null and text is not null").select("lang", "text").mapInArrow(run, "lang string, gram long, n long")
    summed = counts.groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram")) - 1
    return summed.withColumn("place", place).where(F.col("place") < depth).select("lang", "gram", "place")


class Profiles:
    """The learned profiles as one sorted table of n-grams with a place per language."""

    def __init__(self, rows: list[tuple[str, int, int]], depth: int) -> None:
        self.langs = sorted({r[0] for r in rows})
        self.depth = depth
        self.grams = np.unique(np.array([r[1] for r in rows], np.int64)).astype(np.uint64)
        self.places = np.full((len(self.langs), len(self.grams) + 1), -1, np.int32)
        for lang, gram, place in rows:
            self.places[self.langs.index(lang), np.searchsorted(self.grams, np.uint64(gram))] = place

    def predict(self, text: str | None) -> tuple[str, float]:
        if not text or not self.langs:
            return "und", 0.0
        own = _top(*gram_counts(text), self.depth)
        if not len(own):
            return "und", 0.0
        at = np.minimum(np.searchsorted(self.grams, own), len(self.grams) - 1)
        at = np.where(self.grams[at] == own, at, len(self.grams))
        places = self.places[:, at]
        away = np.abs(places - np.arange(len(own), dtype=np.int32))
        away = np.where(places < 0, self.depth, np.minimum(away, self.depth)).sum(1)
        best = int(np.argmin(away))
        return self.langs[best], 1.0 - float(away[best]) / (self.depth * len(own))


def identify(docs: DataFrame, profiles: DataFrame, depth: int = DEPTH) -> DataFrame:
    """``docs`` with lang_pred and score, from the text alone.

    The profiles are gathered: at most ``depth`` rows for each language.
    """
    rows = [(r["lang"], r["gram"], r["place"]) for r in profiles.collect()]
    # Plain rows, so that executors need no copy of this package.
    sent = docs.sparkSession.sparkContext.broadcast(rows)
    own = [c for c in docs.columns if c.lower() not in ("lang_pred", "score", "_text")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Profiles(sent.value, depth)
        for batch in batches:
            found = [known.predict(t) for t in batch.column("_text").to_pylist()]
            names = [c for c in batch.schema.names if c != "_text"]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in names), pa.array([x for x, _ in found], pa.string()), pa.array([x for _, x in found], pa.float64())],
                [*names, "lang_pred", "score"],
            )

    kept = docs.select(*own, F.col("text").alias("_text"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields if f.name in own)
    return kept.mapInArrow(run, f"{schema}, lang_pred string, score double")
