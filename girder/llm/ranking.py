"""Ranked lexical search for many queries at once, their common parts scored once.

Queries are mined for term sets that several of them share: terms that occur
in the same queries are one class, and classes that stand together in two
queries or more are joined pair by pair, again and again, into larger sets.
The outcome is a directed graph from classes over shared sets to queries. For
a block of documents, the partial score of every class is accumulated once,
every shared set is the sum of its two parts, and a query adds up the few sets
it is made of. Tasks keep the best ``top`` documents of each query only, so
no table of documents by queries is ever made.

Two passes read the documents: one counts documents, terms and the documents
of each query term, the other scores. Queries come in blocks of about
``BLOCK_TERMS`` terms by a hash of their id; a block's terms are gathered and
its graph is broadcast, whatever the number of queries.

Terms are the maximal runs of letters a-z, digits and code points from 128 on,
A-Z in lower case. Null or empty text has none and is not counted. Documents
without id are counted and come after equal scores with one; repeated rows are
documents of their own. Rows of one item_id are one query, of which equal
texts count once; items without id or terms have no result. An empty table
gives an empty result. Scores are 64-bit integers.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from girder.llm.kernels import slices, text_bytes
from girder.llm.scratch import scratch
from girder.session import settle

TOP = 10
BLOCK_TERMS = 100_000
CELLS = 1 << 22  # accumulators that a block of documents has
NO_ID = np.iinfo(np.int64).max
SALTS = 64


def _fold() -> bytes:
    kept = {*range(48, 58), *range(97, 123), *range(128, 256)}
    return bytes(b + 32 if 65 <= b < 91 else b if b in kept else 32 for b in range(256))


def item_terms(items: DataFrame) -> DataFrame:
    """(item_id, term, times) of the terms of each query."""
    fold = _fold()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [Counter(t.translate(fold).split()) for t in text_bytes(batch.column("text"))]
            owner = np.repeat(np.arange(len(found)), [len(c) for c in found])
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("item_id").take(pa.array(owner, pa.int64())),
                    pa.array([t for c in found for t in c], pa.binary()),
                    pa.array([n for c in found for n in c.values()], pa.int64()),
                ],
                ["item_id", "term", "times"],
            )

    kind = items.schema["item_id"].dataType.simpleString()
    texts = items.where("item_id is not null and text is not null").select("item_id", "text").distinct()
    return texts.mapInArrow(run, f"item_id {kind}, term binary, times long").groupBy("item_id", "term").agg(F.sum("times").alias("times"))


def share_terms(rows: list[tuple[int, int, int]], queries: int) -> dict:
    """The query-sharing graph of (query, term, times) rows.

    ``entries`` are (term, class, times): what a term adds to the accumulator of
    its class. ``levels`` are lists of (set, part, part) in the order of
    evaluation; sets are numbered after the classes. ``queries`` has the sets
    that add up to each query.
    """
    holders: dict[tuple[int, int], list[int]] = defaultdict(list)
    for query, term, times in sorted(rows):
        holders[term, times].append(query)
    classes: dict[tuple[int, ...], int] = {}
    entries = [(term, classes.setdefault(tuple(held), len(classes)), times) for (term, times), held in holders.items()]
    # Wide-spread classes come first in every query, so that shared ones stand side by side.
    order = sorted(classes.items(), key=lambda c: (-len(c[0]), c[1]))
    made: list[list[int]] = [[] for _ in range(queries)]
    for held, c in order:
        for query in held:
            made[query].append(c)
    levels, size = [], len(classes)
    while True:
        pairs = Counter(pair for sets in made for pair in zip(sets, sets[1:], strict=False))
        shared = {pair for pair, n in pairs.items() if n > 1}
        if not shared:
            break
        joined, used = [], Counter()
        for sets in made:
            out: list = []
            at = 0
            while at < len(sets):
                pair = tuple(sets[at : at + 2])
                if pair in shared and (at + 2 >= len(sets) or pairs[pair] >= pairs[sets[at + 1], sets[at + 2]]):
                    out.append(pair)
                    used[pair] += 1
                    at += 2
                else:
                    out.append(sets[at])
                    at += 1
            joined.append(out)
        number = {pair: size + i for i, pair in enumerate(sorted(p for p, n in used.items() if n > 1))}
        if not number:
            break
        made = [[x for s in out for x in ([number[s]] if s in number else s if isinstance(s, tuple) else [s])] for out in joined]
        levels.append([(n, *pair) for pair, n in number.items()])
        size += len(number)
    return {"entries": entries, "classes": len(classes), "size": size, "levels": levels, "queries": made}


def _arrays(graph: dict, terms: int) -> dict:
    """The graph as arrays: entries by term, levels as index triples, queries one after the other."""
    entries = np.array(sorted(graph["entries"]), np.int64).reshape(-1, 3)
    return {
        "heads": np.searchsorted(entries[:, 0], np.arange(terms + 1)),
        "classes": entries[:, 1],
        "times": entries[:, 2],
        "size": graph["size"],
        "levels": [np.array(level, np.int64).T for level in graph["levels"]],
        "sets": np.concatenate([np.array(q, np.int64) for q in graph["queries"]]),
        "starts": np.cumsum([0, *(len(q) for q in graph["queries"][:-1])]),
    }


def score_block(graph: dict, postings: tuple[np.ndarray, np.ndarray, np.ndarray], docs: int) -> np.ndarray:
    """Scores (query, document) from postings (document, term, value) of a block of documents."""
    doc, term, value = postings
    width = graph["heads"][term + 1] - graph["heads"][term]
    at = np.repeat(graph["heads"][term] - (np.cumsum(width) - width), width) + np.arange(int(width.sum()))
    partial = np.zeros((graph["size"], docs), np.int64)
    np.add.at(partial, (graph["classes"][at], np.repeat(doc, width)), np.repeat(value, width) * graph["times"][at])
    for made, one, two in graph["levels"]:
        partial[made] = partial[one] + partial[two]
    return np.add.reduceat(partial[graph["sets"]], graph["starts"], axis=0)


class Best:
    """The ``top`` documents of every query so far: highest score, then smallest id, no id last."""

    def __init__(self, queries: int, top: int) -> None:
        self.top = top
        self.scores = np.zeros((queries, top), np.int64)
        self.ids = np.full((queries, top), NO_ID)
        self.nameless = np.ones((queries, top), bool)

    def add(self, scores: np.ndarray, ids: np.ndarray, nameless: np.ndarray) -> None:
        least, last = self.scores[:, -1:], self.ids[:, -1:]
        hopeful = (scores > 0) & ((scores > least) | ((scores == least) & (ids[None, :] <= last)))
        for q in np.flatnonzero(hopeful.any(axis=1)):
            at = np.flatnonzero(hopeful[q])
            s = np.concatenate([self.scores[q], scores[q, at]])
            i = np.concatenate([self.ids[q], ids[at]])
            n = np.concatenate([self.nameless[q], nameless[at]])
            order = np.lexsort((i, n, -s))[: self.top]
            self.scores[q], self.ids[q], self.nameless[q] = s[order], i[order], n[order]

    def rows(self) -> pa.RecordBatch:
        query, place = np.nonzero(self.scores > 0)
        ids = pa.array(self.ids[query, place], pa.int64(), mask=self.nameless[query, place])
        return pa.RecordBatch.from_arrays([pa.array(query), ids, pa.array(self.scores[query, place])], ["query", "doc_id", "score"])


def _statistics(docs: DataFrame, vocabulary: dict[bytes, int]) -> dict[int, int]:
    """Documents that hold each query term; at -1 the documents with a term, at -2 all their terms."""
    sent = docs.sparkSession.sparkContext.broadcast(vocabulary)
    fold = _fold()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = sent.value
        sums: Counter = Counter()
        for batch in batches:
            for text in text_bytes(batch.column("text")):
                found = text.translate(fold).split()
                if found:
                    sums[-1] += 1
                    sums[-2] += len(found)
                    sums.update(known[t] for t in known.keys() & set(found))
        yield pa.record_batch({"term": pa.array(list(sums), pa.int64()), "n": pa.array(list(sums.values()), pa.int64())})

    counts = docs.select("text").mapInArrow(run, "term long, n long").groupBy("term").agg(F.sum("n").alias("n"))
    return {r["term"]: r["n"] for r in counts.collect()}  # a row for each query term of the block


def _scored(docs: DataFrame, graph: dict, vocabulary: dict[bytes, int], found: dict[int, int], queries: int, top: int) -> DataFrame:
    documents, terms = found[-1], found[-2]
    weights = np.zeros(len(vocabulary), np.int64)
    for t in vocabulary.values():
        weights[t] = math.floor(1000 * math.log((2 * documents + 2) / (2 * found.get(t, 0) + 1)))
    sent = docs.sparkSession.sparkContext.broadcast((graph, vocabulary, weights))
    block = max(8, min(1024, CELLS // (graph["size"] + len(graph["sets"]))))
    fold = _fold()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        graph, known, weights = sent.value
        best = Best(queries, top)
        for whole in batches:
            for part in slices(whole):
                ids = part.column("doc_id")
                nameless = np.asarray(ids.is_null())
                numbers = ids.fill_null(NO_ID).to_numpy().astype(np.int64)
                texts = text_bytes(part.column("text"))
                for start in range(0, len(texts), block):
                    postings = []
                    for j, text in enumerate(texts[start : start + block]):
                        words = text.translate(fold).split()
                        length = 25 + 75 * len(words) * documents // terms
                        times = Counter(words)
                        for t in known.keys() & times.keys():
                            n, at = times[t], known[t]
                            postings.append((j, at, int(weights[at]) * (1_000_000_000 * n // (1000 * n + 8 * length))))
                    columns = np.array(postings, np.int64).reshape(-1, 3).T
                    here = slice(start, start + block)
                    best.add(score_block(graph, (columns[0], columns[1], columns[2]), len(texts[here])), numbers[here], nameless[here])
        yield best.rows()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "query long, doc_id long, score long")


def _best(rows: DataFrame, top: int, *keys: str) -> DataFrame:
    order = Window.partitionBy(*keys).orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last())
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)


def search(docs: DataFrame, items: DataFrame, top: int = TOP, block_terms: int = BLOCK_TERMS) -> DataFrame:
    """(item_id, rank, doc_id, score): the ``top`` documents of each item with a score above 0."""
    spark = docs.sparkSession
    kind = items.schema["item_id"].dataType.simpleString()
    results = []
    with scratch(spark) as store:
        queries = store(item_terms(items))
        blocks = -(-queries.count() // block_terms)
        for b in range(blocks):
            rows = queries.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == b).collect()
            names = {name: i for i, name in enumerate(dict.fromkeys(r["item_id"] for r in rows))}
            vocabulary = {t: i for i, t in enumerate(sorted({bytes(r["term"]) for r in rows}))}
            found = _statistics(docs, vocabulary) if rows else {}
            if not found.get(-1):
                continue
            graph = share_terms([(names[r["item_id"]], vocabulary[bytes(r["term"])], r["times"]) for r in rows], len(names))
            scored = _scored(docs, _arrays(graph, len(vocabulary)), vocabulary, found, len(names), top)
            # Each task sends its best documents; parts of them are cut to the best before the last step.
            salted = scored.withColumn("part", F.spark_partition_id() % SALTS)
            best = _best(_best(salted, top, "query", "part"), top, "query")
            named = spark.createDataFrame([(i, name) for name, i in names.items()], f"query long, item_id {kind}")
            results.append(settle(best.join(F.broadcast(named), "query").select("item_id", "rank", "doc_id", "score")))
    if not results:
        return spark.createDataFrame([], f"item_id {kind}, rank int, doc_id long, score long")
    out = results[0]
    for more in results[1:]:
        out = out.unionByName(more)
    return out
