"""Quality classifier from weak labels: heuristics vote, EM weighs them, a hashed linear scorer learns the outcome.

Two aspects are judged, junk and abuse. For each, several overlapping
labellers look at a document and vote bad, good, or abstain. Nobody says how
good the labellers are: expectation-maximisation over the counts of their vote
patterns (all documents) estimates each one's behaviour in the good and in the
bad class. The posterior of a pattern is the label of its documents, and a
linear scorer over hashed words, word beginnings and votes is fitted to these
labels. A document is rejected if either scorer finds it bad.

What is gathered is bounded: vote patterns (3 to the power of the labellers),
and one task fits the scorer on about ``TRAIN`` documents picked by hash. Two
labellers of abuse use all words and word beginnings that stand out in toxic
rows of a label table, from about ``LABELLED`` of its rows of either kind.
Every document is voted on and scored whole.

How dense abuse is, is judged on the densest ``STRETCH`` words that stand
together in a text, so the length of the rest does not outvote them. Single
words spread thinner than that over a long text are not abuse for it.

Null text is empty; a text without words gets no bad vote, and is scored like
any other. No list of abusive words is built in: without labels and without a
``lexicon`` given, the labellers of abuse abstain and abuse is not seen. Repeated rows
get equal scores. Label rows that repeat or have no document do nothing. An
empty table gives an empty result.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from girder.llm.kernels import WordHasher, mix, slices, text_bytes
from girder.session import settle

BEGINNINGS = (4, 5, 6, 7)
DIMENSIONS = 1 << 18
LABELLED = 4_000
STRETCH = 1_000
TRAIN = 6_000
STEPS = 60
SLICE = 1 << 20  # bytes of text read at once; word hashes and their look-ups are many times as large
CHUNK = 1 << 20  # features of the sample weighed at once
BAD, NONE, GOOD = 0, 1, 2
JUNK_LABELLERS = ("symbols", "marks", "capitals", "variety", "bars", "echo", "shouting")
ABUSE_LABELLERS = ("listed", "words", "beginnings", "several", "density")


def _begin_hashes(words: tuple[str, ...]) -> np.ndarray:
    """The hash of the longest beginning that is taken of each word; a word shorter than any beginning stands for itself."""
    hasher = WordHasher(BEGINNINGS)
    found, _ = hasher.words([w.encode() for w in words])
    return np.array([next((h for h in column[:0:-1].tolist() if h), int(column[0])) for column in found.T], np.uint64)


@dataclass
class Batch:
    """Word hashes of some texts and the figures that the labellers look at."""

    words: np.ndarray
    counts: np.ndarray
    figures: dict[str, np.ndarray]


class Reader:
    def __init__(self) -> None:
        self.hasher = WordHasher(BEGINNINGS)
        table = np.zeros((4, 256), np.int64)
        codes = np.arange(256)
        letter = ((codes >= 65) & (codes <= 90)) | ((codes >= 97) & (codes <= 122))
        table[0] = ~(letter | ((codes >= 48) & (codes <= 57)) | (codes >= 128) | (codes <= 32))
        table[1, list(b"#$%&*<>{}\\^~")] = 1
        table[2, 65:91] = 1
        table[3, ord("!")] = 1
        self.kinds = table
        self.bar = WordHasher().words([b"|"])[0][0]

    def read(self, texts: list[bytes]) -> Batch:
        words, counts = self.hasher.words(texts)
        ends = np.cumsum(counts)
        starts = ends - counts
        data = np.frombuffer(b"".join(texts), np.uint8)
        bounds = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
        shares = []
        for row in self.kinds:
            sums = np.concatenate([[0], np.cumsum(row[data])])
            shares.append((sums[bounds[1:]] - sums[bounds[:-1]]) / np.maximum(np.diff(bounds), 1))
        full = words[0]
        owner = np.repeat(np.arange(len(texts)), counts)
        echo = np.zeros(len(texts))
        again = np.flatnonzero((full[1:] == full[:-1]) & (owner[1:] == owner[:-1]))
        np.add.at(echo, owner[again], 1)
        bars = np.zeros(len(texts))
        np.add.at(bars, owner[full == self.bar], 1)
        distinct = np.array([len(np.unique(full[a:b])) for a, b in zip(starts, ends, strict=True)])
        n = np.maximum(counts, 1)
        figures = {"symbols": shares[0], "marks": shares[1], "capitals": shares[2], "shouting": shares[3]}
        figures |= {"variety": distinct / n, "bars": bars / n, "echo": echo / n}
        return Batch(words, counts, figures)


def _vote(bad: np.ndarray, good: np.ndarray) -> np.ndarray:
    return np.where(bad, BAD, np.where(good, GOOD, NONE))


def junk_votes(batch: Batch) -> np.ndarray:
    f, n = batch.figures, batch.counts
    some = n >= 5
    return np.stack(
        [
            _vote((f["symbols"] > 0.07) & some, f["symbols"] < 0.05),
            _vote((f["marks"] > 0.01) & some, f["marks"] < 0.002),
            _vote((f["capitals"] > 0.3) & some, f["capitals"] < 0.15),
            _vote((f["variety"] < 0.25) & (n >= 50), f["variety"] > 0.45),
            _vote((f["bars"] > 0.03) & some, f["bars"] == 0),
            _vote((f["echo"] > 0.15) & some, f["echo"] < 0.08),
            _vote((f["shouting"] > 0.02) & some, f["shouting"] < 0.005),
        ],
        axis=1,
    )


def _densest(at: np.ndarray, owner: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """For each text, the most places of ``at`` (ascending) that any ``STRETCH`` words of it hold."""
    most = np.zeros(len(ends), np.int64)
    # A stretch that holds the most can begin at one of them.
    reach = np.searchsorted(at, np.minimum(at + STRETCH, ends[owner[at]]))
    np.maximum.at(most, owner[at], reach - np.arange(len(at)))
    return most


def abuse_votes(batch: Batch, listed: np.ndarray, learned_words: np.ndarray, learned_begins: np.ndarray) -> np.ndarray:
    texts = len(batch.counts)
    owner = np.repeat(np.arange(texts), batch.counts)
    ends = np.cumsum(batch.counts)

    def hits(rows: np.ndarray, known: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """How many words are known: in the whole text, and in its densest stretch."""
        if not len(known):
            return np.zeros(texts), np.zeros(texts)
        found = np.minimum(np.searchsorted(known, rows), len(known) - 1)
        at = np.flatnonzero((known[found] == rows).any(0))
        return np.bincount(owner[at], minlength=texts), _densest(at, owner, ends)

    in_list, list_stretch = hits(batch.words, listed)
    in_words, words_stretch = hits(batch.words[:1], learned_words)
    in_begins, begins_stretch = hits(batch.words[1:], learned_begins)
    known = bool(len(learned_begins))
    any_known = known or bool(len(listed))
    n = np.clip(batch.counts, 1, STRETCH)
    every, stretch = np.maximum(in_list, in_begins), np.maximum(list_stretch, begins_stretch)
    return np.stack(
        [
            _vote(in_list > 0, (in_list == 0) & bool(len(listed))),
            _vote((in_words > 0) & (words_stretch * 300 >= n), (in_words == 0) & known),
            _vote((begins_stretch > 1) & (begins_stretch * 200 >= n), known & (begins_stretch * 1500 < n)),
            _vote((stretch > 2) & (stretch * 300 >= n), (every < 2) & any_known),
            _vote((stretch > 1) & (stretch * 120 >= n), (stretch * 800 < n) & any_known),
        ],
        axis=1,
    )


def estimate(patterns: np.ndarray, counts: np.ndarray, rounds: int = 200) -> dict[tuple[int, ...], float]:
    """EM over vote patterns: the chance that a document with each pattern is bad.

    Each labeller has, in either class, a chance to vote bad where it votes at
    all; to abstain says nothing. Starts from: bad where any labeller says so.
    """
    if not len(patterns):
        return {}
    n, labellers = patterns.shape
    bad = np.where((patterns == BAD).any(1), 0.8, 0.05)
    votes = np.stack([patterns == v for v in (BAD, GOOD)], axis=2).astype(float)
    for _ in range(rounds):
        weights = np.stack([counts * bad, counts * (1 - bad)])
        prior = np.clip(weights.sum(1) / counts.sum(), 1e-6, 1 - 1e-6)
        table = np.einsum("cn,nlv->clv", weights, votes) + 0.5
        table /= table.sum(2, keepdims=True)
        # A bad vote speaks for the bad class: the classes cannot change places.
        turned = table[1, :, BAD] > table[0, :, BAD]
        table[1, turned, BAD] = table[0, turned, BAD]
        logs = np.log(prior)[:, None] + np.einsum("nlv,clv->cn", votes, np.log(table))
        new = 1 / (1 + np.exp(np.clip(logs[1] - logs[0], -50, 50)))
        if np.abs(new - bad).max() < 1e-9:
            break
        bad = new
    return {tuple(int(v) for v in p): float(x) for p, x in zip(patterns, bad, strict=True)}


def _learn_words(labelled: DataFrame, sizes: dict[int, int]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of words, and of word beginnings, that toxic rows have far more often; from ``sizes`` rows (text, toxic)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader()
        for whole in batches:
            for batch in slices(whole):
                toxic = batch.column("toxic").to_numpy()
                found = reader.read(text_bytes(batch.column("text")))
                sums: list[Counter] = [Counter(), Counter()]
                for i, end in enumerate(np.cumsum(found.counts)):
                    own = found.words[:, end - found.counts[i] : end]
                    for kind, row in enumerate((own[0], own[1:])):
                        sums[int(toxic[i])].update((kind, h) for h in np.unique(row).tolist() if h)
                keys = list({**sums[0], **sums[1]})
                yield pa.record_batch(
                    {
                        "kind": pa.array([k for k, _ in keys], pa.int32()),
                        "hash": np.array([h for _, h in keys], np.uint64).astype(np.int64),
                        "bad": pa.array([sums[1][k] for k in keys], pa.int64()),
                        "good": pa.array([sums[0][k] for k in keys], pa.int64()),
                    }
                )

    counts = labelled.mapInArrow(run, "kind int, hash long, bad long, good long").groupBy("kind", "hash")
    sums = counts.agg(F.sum("bad").alias("bad"), F.sum("good").alias("good")).where("bad >= 3")
    # Rates in toxic and other rows: their ratio, and how far apart they are in standard errors.
    bad, good = F.col("bad") / max(sizes.get(1, 0), 1), F.col("good") / max(sizes.get(0, 0), 1)
    both = (F.col("bad") + F.col("good")) / max(sum(sizes.values()), 1)
    error = F.sqrt(both * (1 - both) * (1 / max(sizes.get(1, 0), 1) + 1 / max(sizes.get(0, 0), 1)))
    ratio = bad / ((F.col("good") + 0.5) / max(sizes.get(0, 0), 1))
    telling = sums.where((bad - good >= 4 * error) & (ratio >= F.when(F.col("kind") == 0, 30).otherwise(4)))
    rows = telling.select("kind", "hash").collect()  # from ``LABELLED`` toxic rows at most
    learned = [np.sort(np.array([r["hash"] for r in rows if r["kind"] == k], np.int64).astype(np.uint64)) for k in (0, 1)]
    return learned[0], learned[1]


def _indices(batch: Batch, junk: np.ndarray, abuse: np.ndarray) -> Iterator[np.ndarray]:
    """Hashed features of each text: first the votes, then words and beginnings."""
    ends = np.cumsum(batch.counts)
    names = np.arange(junk.shape[1] + abuse.shape[1], dtype=np.uint64) * np.uint64(3)
    for i, end in enumerate(ends):
        own = np.unique(batch.words[:, end - batch.counts[i] : end])
        votes = mix(names + np.concatenate([junk[i], abuse[i]]).astype(np.uint64) + np.uint64(1))
        yield (np.concatenate([votes, mix(own[own > 0])]) >> np.uint64(64 - 18)).astype(np.int32)


VOTES = len(JUNK_LABELLERS) + len(ABUSE_LABELLERS)


def _values(n: int) -> np.ndarray:
    """Votes weigh 1 each, words 1 over the root of their number."""
    values = np.full(n, 1 / np.sqrt(max(n - VOTES, 1)), np.float64)
    values[:VOTES] = 1.0
    return values


def _chunks(sizes: np.ndarray, limit: int) -> Iterator[tuple[int, int]]:
    """Ranges of rows with about ``limit`` features, one row at least."""
    start, held = 0, 0
    for i, n in enumerate(sizes.tolist()):
        if held and held + n > limit:
            yield start, i
            start, held = i, 0
        held += n
    if start < len(sizes):
        yield start, len(sizes)


def _fit(frame: pd.DataFrame) -> pd.DataFrame:
    """Weights of both aspects by logistic regression (AdaGrad over all rows of the sample).

    Scores and gradients are added up chunk by chunk, so beside the features a
    step holds the arrays of one chunk.
    """
    rows = frame.sort_values("row").reset_index(drop=True)
    features = [np.frombuffer(x, np.int32) for x in rows["features"]]
    sizes = np.array([len(x) for x in features])
    parts = list(_chunks(sizes, CHUNK))
    index = [np.concatenate(features[a:b]) for a, b in parts]
    labels = {aspect: rows[aspect].to_numpy() for aspect in ("junk", "abuse")}
    del frame, rows
    scale = 1 / np.sqrt(np.maximum(sizes - VOTES, 1))
    del features
    out = []
    for aspect, label in labels.items():
        weights, seen = np.zeros(DIMENSIONS), np.full(DIMENSIONS, 1e-8)
        bias, bias_seen = 0.0, 1e-8
        for _ in range(STEPS):
            gradient, off = np.zeros(DIMENSIONS), 0.0
            for (a, b), at in zip(parts, index, strict=True):
                heads = np.cumsum(sizes[a:b]) - sizes[a:b]
                values = np.repeat(scale[a:b], sizes[a:b])
                values[(heads[:, None] + np.arange(VOTES)).ravel()] = 1.0
                score = np.add.reduceat(weights[at] * values, heads) + bias
                error = (1 / (1 + np.exp(-np.clip(score, -30, 30))) - label[a:b]) / len(label)
                values *= np.repeat(error, sizes[a:b])
                gradient += np.bincount(at, values, DIMENSIONS)
                off += error.sum()
            gradient += 1e-7 * weights
            seen += gradient**2
            weights -= 0.3 * gradient / np.sqrt(seen)
            bias_seen += off**2
            bias -= 0.3 * off / np.sqrt(bias_seen)
        out.append({"aspect": aspect, "bias": bias, "weights": weights.astype(np.float32).tobytes()})
    return pd.DataFrame(out)


def classify(docs: DataFrame, labels: DataFrame | None = None, lexicon: tuple[str, ...] = ()) -> DataFrame:
    """``docs`` with p_junk, p_abuse (0 to 1), quality (0 to 1) and keep; ``lexicon`` lists abusive words of at least 4 bytes."""
    spark = docs.sparkSession
    own = [c for c in docs.columns if c.lower() not in ("p_junk", "p_abuse", "quality", "keep")]
    listed = np.sort(_begin_hashes(lexicon))
    words, begins = np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    row = F.abs(F.xxhash64("doc_id", "text") % 1_000_000_007)
    if labels is not None:
        marked = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
        sizes = {r["toxic"]: r["count"] for r in marked.groupBy("toxic").count().collect()}
        pick = F.abs(F.xxhash64("doc_id") % 1_000_000_007)
        cut = {t: int(min(1.0, LABELLED / n) * 1_000_000_007) for t, n in sizes.items()}
        chosen = marked.where((F.col("toxic").isin(0, 1)) & (pick <= F.when(F.col("toxic") == 1, cut.get(1, 0)).otherwise(cut.get(0, 0))))
        # About 2 * LABELLED rows of 12 bytes, whatever the size of the table.
        learning = {t: min(n, LABELLED) for t, n in sizes.items() if t in (0, 1)}
        words, begins = _learn_words(docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("text", "toxic"), learning)
    sent = spark.sparkContext.broadcast((listed, words, begins))

    def votes(batch: Batch) -> tuple[np.ndarray, np.ndarray]:
        return junk_votes(batch), abuse_votes(batch, *sent.value)

    def count_votes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader()
        for whole in batches:
            seen: Counter = Counter()
            for batch in slices(whole, limit=SLICE):
                junk, abuse = votes(reader.read(text_bytes(batch.column("text"))))
                seen.update(("junk", bytes(v)) for v in junk.astype(np.uint8))
                seen.update(("abuse", bytes(v)) for v in abuse.astype(np.uint8))
            yield pa.record_batch(
                {
                    "aspect": pa.array([a for a, _ in seen], pa.string()),
                    "pattern": pa.array([p for _, p in seen], pa.binary()),
                    "n": pa.array(list(seen.values()), pa.int64()),
                }
            )

    counted = docs.select("text").mapInArrow(count_votes, "aspect string, pattern binary, n long").groupBy("aspect", "pattern")
    rows = counted.agg(F.sum("n").alias("n")).orderBy("aspect", "pattern").collect()
    posteriors = {}
    for aspect in ("junk", "abuse"):
        mine = [r for r in rows if r["aspect"] == aspect]
        width = len(JUNK_LABELLERS if aspect == "junk" else ABUSE_LABELLERS)
        patterns = np.array([list(r["pattern"]) for r in mine], np.int64).reshape(len(mine), width)
        posteriors[aspect] = estimate(patterns, np.array([r["n"] for r in mine], float))
    total = sum(r["n"] for r in rows if r["aspect"] == "junk")
    known = spark.sparkContext.broadcast(posteriors)

    def training(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader()
        for whole in batches:
            for batch in slices(whole, limit=SLICE):
                read = reader.read(text_bytes(batch.column("text")))
                junk, abuse = votes(read)
                yield pa.record_batch(
                    {
                        "row": batch.column("row"),
                        "features": pa.array([x.tobytes() for x in _indices(read, junk, abuse)], pa.binary()),
                        "junk": np.array([known.value["junk"][tuple(v)] for v in junk.tolist()], np.float64),
                        "abuse": np.array([known.value["abuse"][tuple(v)] for v in abuse.tolist()], np.float64),
                    }
                )

    sample = docs.select("text", row.alias("row")).where(F.col("row") <= int(min(1.0, TRAIN / max(total, 1)) * 1_000_000_007))
    features = sample.mapInArrow(training, "row long, features binary, junk double, abuse double")
    fitted = features.withColumn("all", F.lit(0)).groupBy("all").applyInPandas(_fit, "aspect string, bias double, weights binary").collect()
    model = {r["aspect"]: (r["bias"], np.frombuffer(bytes(r["weights"]), np.float32)) for r in fitted}
    model_sent = spark.sparkContext.broadcast(model)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader()
        for whole in batches:
            for batch in slices(whole, limit=SLICE):
                read = reader.read(text_bytes(batch.column("text")))
                junk, abuse = votes(read)
                chances = {"junk": [], "abuse": []}
                for x in _indices(read, junk, abuse):
                    values = _values(len(x))
                    for aspect, found in chances.items():
                        bias, weights = model_sent.value[aspect]
                        found.append(1 / (1 + np.exp(-np.clip(weights[x] @ values + bias, -30, 30))))
                p_junk, p_abuse = np.array(chances["junk"], np.float64), np.array(chances["abuse"], np.float64)
                worst = np.maximum(p_junk, p_abuse)
                names = batch.schema.names
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(c) for c in names), pa.array(p_junk), pa.array(p_abuse), pa.array(1 - worst), pa.array(worst < 0.5)],
                    [*names, "p_junk", "p_abuse", "quality", "keep"],
                )

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields if f.name in own)
    # Every text goes to a worker once and comes back once.
    return docs.select(*own).mapInArrow(score, f"{schema}, p_junk double, p_abuse double, quality double, keep boolean")
