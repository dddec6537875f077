"""Toxicity by two Kneser-Ney models, one of toxic and one of ordinary documents.

An expression is a word: a run of letters a-z, digits and bytes from 128 on of
the lower-cased text, of at most ``WORD`` bytes (a longer run counts as several).
Each class has a model of how words are spelled, byte after byte, from the
``ORDER - 1`` bytes before. Its counts are discounted, and what the discount
frees is spread by counts that both classes share: shorter contexts, counted
by the different bytes that precede them, over the words of all documents. So
a rare expression is judged by its spelling, and where one class does not know
a context neither is preferred. A word counts once in a document.

The difference of a word's two log-likelihoods says how much more likely a
toxic document is to hold it. A toxic document is taken as ordinary text with
a ``SHARE`` of toxic words, so that a word adds log(1 - share + share * e^d),
and a document has the sum over its best stretch of different words, less the
log of its length (best stretches grow by chance as texts grow). A logistic
curve turns that into a score. It is fitted to labelled rows that the models
for this did not count, about ``FITTED`` of them picked by hash.

Every labelled document outside the held-out ones is counted, and the shared
counts cover all documents, so the tables grow with the input. The differences
are broadcast while they have at most ``TABLE_BYTES``; beyond that, different
words are scored by joins, and the words of documents are joined to them. Both
give the same scores.

Null or empty text, or text without a word, has the sum 0. Without a toxic or
without an ordinary document to learn from there is no evidence and every
score is 0. Label rows that
repeat count as toxic if one of them is; rows without document or label do
nothing. Rows that repeat a doc_id get the label of the id each and score
equally if their texts are equal. An empty table gives an empty result.
Columns of the input that are named like an added one are replaced.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from girder.llm.kernels import slices
from girder.llm.scratch import scratch
from girder.session import settle

ORDER = 8
SHARED = (1, 3, 5)
DISCOUNT = 0.9
SHARE = 0.01
SHORT = 20
MISSED = 3.0
WORD = 256
FITTED = 20_000
BROADCAST_LABELS = 2_000_000  # labels up to this number (some 30 bytes each) are broadcast to the texts, more are joined by shuffle
TABLE_BYTES = 96 << 20
ENTRY_BYTES = 12
HELD_WORDS = 200_000
HELD_SPELLINGS = 3_000_000
START, END = 0x20, 0x0A
LOWER_ORDER = SHARED[-1] + 1
CLASSES = ("toxic_early", "plain_early", "toxic_late", "plain_late")


def _fold() -> bytes:
    kept = {*range(48, 58), *range(97, 123), *range(128, 256)}
    return bytes(b if b in kept else 32 for b in range(256))


def _distinct_words(text: str | None, fold: bytes) -> list[bytes]:
    """The different words of a text, by first place."""
    words = dict.fromkeys((text or "").lower().encode("utf-8", "surrogatepass").translate(fold).split())
    if words and max(map(len, words)) > WORD:
        words = dict.fromkeys(w[i : i + WORD] for w in words for i in range(0, len(w), WORD))
    return list(words)


def _grams(words: list[bytes], order: int) -> tuple[np.ndarray, np.ndarray]:
    """For each byte of each word and its end: the byte after the ``order`` - 1 before it, packed; and the word's place."""
    joined = b"".join(b"\x20" + w + b"\x0a" for w in words)
    codes = np.frombuffer(joined, np.uint8).astype(np.uint64)
    starts = codes == START
    owner = np.cumsum(starts) - 1
    packed = codes.copy()
    for k in range(1, min(order, len(codes))):
        inside = owner[k:] == owner[:-k]
        packed[k:] |= np.where(inside, codes[:-k] << np.uint64(8 * k), np.uint64(0))
    return packed[~starts], owner[~starts]


def _count(docs: DataFrame) -> DataFrame:
    """(lower, gram, n, toxic_early, ...): documents by spelling, over all of them at the shared order and by class at the full one."""
    fold = _fold()

    def count(sums: list[Counter], order: int) -> tuple[np.ndarray, np.ndarray]:
        words = list(dict.fromkeys(w for c in sums for w in c))
        if not words:
            return np.zeros(0, np.uint64), np.zeros((len(sums), 0), np.int64)
        grams, owner = _grams(words, order)
        keys, back = np.unique(grams, return_inverse=True)
        counts = [np.bincount(back, np.array([c[w] for w in words], np.float64)[owner], len(keys)) for c in sums]
        return keys, np.array(counts).astype(np.int64)

    def add(held: tuple[np.ndarray, np.ndarray], more: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        keys, back = np.unique(np.concatenate([held[0], more[0]]), return_inverse=True)
        counts = np.zeros((len(held[1]), len(keys)), np.int64)
        for part, at in ((held[1], back[: len(held[0])]), (more[1], back[len(held[0]) :])):
            counts[:, at] += part
        return keys, counts

    def rows(held: tuple[np.ndarray, np.ndarray], lower: bool) -> pa.RecordBatch:
        keys, counts = held
        none = np.zeros(len(keys), np.int64)
        columns = [counts[0], none, none, none, none] if lower else [none, *counts]
        return pa.RecordBatch.from_arrays(
            [pa.array(np.full(len(keys), lower)), pa.array(keys.view(np.int64)), *map(pa.array, columns)], ["lower", "gram", "n", *CLASSES]
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # A task sends each spelling once, unless it meets very many.
        none = [(np.zeros(0, np.uint64), np.zeros((n, 0), np.int64)) for n in (1, len(CLASSES))]
        held = list(none)
        everywhere, classes = Counter(), [Counter() for _ in CLASSES]

        def fold_in() -> None:
            held[0], held[1] = add(held[0], count([everywhere], LOWER_ORDER)), add(held[1], count(classes, ORDER))
            for sums in (everywhere, *classes):
                sums.clear()

        for whole in batches:
            for batch in slices(whole):
                for text, kind in zip(batch.column("text").to_pylist(), batch.column("kind").to_pylist(), strict=True):
                    words = _distinct_words(text, fold)
                    everywhere.update(words)
                    if kind is not None:
                        classes[kind].update(words)
                if len(everywhere) > HELD_WORDS:
                    fold_in()
                    if len(held[0][0]) + len(held[1][0]) > HELD_SPELLINGS:
                        yield from (rows(held[0], True), rows(held[1], False))
                        held[:] = none
        fold_in()
        yield from (rows(held[0], True), rows(held[1], False))

    fields = ", ".join(f"{c} long" for c in ("n", *CLASSES))
    counted = docs.select("text", "kind").mapInArrow(run, f"lower boolean, gram long, {fields}")
    return counted.groupBy("lower", "gram").agg(*[F.sum(c).alias(c) for c in ("n", *CLASSES)])


def _last(gram: Column, n: int) -> Column:
    """The last n bytes of a packed spelling."""
    return gram.bitwiseAND(F.lit((1 << (8 * n)) - 1).cast("long"))


def _shared_chances(spellings: DataFrame) -> DataFrame:
    """(low, chance): Kneser-Ney chance of a byte after the bytes before it, from (gram, n) of the next longer order."""
    chances = None
    for before, n in zip((0, *SHARED), SHARED, strict=False):
        longer = spellings.groupBy(_last(F.col("gram"), n + 1).alias("longer")).agg(F.sum("n").alias("n"))
        low = longer.groupBy(_last(F.col("longer"), n).alias("low")).agg(F.count("*").alias("kinds"), F.sum("n").alias("n"))
        # What begins with the word has nothing before it, so its documents are counted instead.
        first = F.shiftrightunsigned("low", 8 * (n - 1))
        begins = first.isin(0, START) if n > 1 else F.lit(False)
        low = low.select("low", F.when(begins, F.col("n")).otherwise(F.col("kinds")).alias("n"))
        low = low.withColumn("context", F.shiftrightunsigned("low", 8))
        total = low.groupBy("context").agg(F.sum("n").alias("total"), F.count("*").alias("follow"))
        joined = low.join(total, "context")
        if chances is None:
            joined = joined.withColumn("lower", F.lit(1 / 256))
        else:
            joined = joined.withColumn("shorter", _last(F.col("low"), before)).join(chances.select(F.col("low").alias("shorter"), F.col("chance").alias("lower")), "shorter")
        kept = F.greatest(F.col("n") - DISCOUNT, F.lit(0.0))
        chances = joined.select("low", ((kept + DISCOUNT * F.col("follow") * F.col("lower")) / F.col("total")).alias("chance"))
    return chances


def differences(spellings: DataFrame, toxic: Column, plain: Column) -> DataFrame:
    """(gram, value): log of the toxic over the ordinary chance of each spelling, and for each context (a last byte 0) of one not seen.

    ``spellings`` has (gram, chance by the shared counts) and the columns behind the two counts.
    """
    rows = spellings.select("gram", "chance", toxic.alias("t"), plain.alias("p")).where("t + p > 0")
    rows = rows.withColumn("context", F.shiftrightunsigned("gram", 8))
    contexts = rows.groupBy("context").agg(
        F.sum("t").alias("t_all"), F.sum("p").alias("p_all"), F.count_if(F.col("t") > 0).alias("t_kinds"), F.count_if(F.col("p") > 0).alias("p_kinds")
    )
    known = contexts.where("t_all > 0 and p_all > 0").select(
        "context",
        "t_all",
        "p_all",
        (DISCOUNT * F.col("t_kinds") / F.col("t_all")).alias("t_free"),
        (DISCOUNT * F.col("p_kinds") / F.col("p_all")).alias("p_free"),
    )

    def chance(c: str) -> Column:
        return F.greatest(F.col(c) - DISCOUNT, F.lit(0.0)) / F.col(f"{c}_all") + F.col(f"{c}_free") * F.col("chance")

    seen = rows.join(known, "context").select("gram", (F.log(chance("t")) - F.log(chance("p"))).alias("value"))
    unseen = known.select(F.shiftleft("context", 8).alias("gram"), (F.log("t_free") - F.log("p_free")).alias("value"))
    return seen.unionByName(unseen)


def _word_sums(words: list[bytes], keys: np.ndarray, values: np.ndarray) -> np.ndarray:
    """For each word, the difference of its log-likelihoods."""
    if not words or not len(keys):
        return np.zeros(len(words))
    grams, owner = _grams(words, ORDER)

    def look(wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
        return keys[at] == wanted, values[at]

    known, value = look(grams)
    context, free = look(grams >> np.uint64(8) << np.uint64(8))
    return np.bincount(owner, np.where(known, value, np.where(context, free, 0.0)), len(words))


def _document_sum(differences: np.ndarray) -> float:
    """Best stretch of a document's words, less the log of its length."""
    gains = np.log1p(SHARE * np.expm1(np.minimum(differences, 50.0)))
    upto = np.concatenate([[0.0], np.cumsum(gains)])
    return float((upto - np.minimum.accumulate(upto)).max() - math.log(len(gains) + SHORT))


def _sums_by_table(docs: DataFrame, table: DataFrame) -> DataFrame:
    """``docs`` with evidence, from differences that every task holds."""
    found = table.select("gram", F.col("value").cast("float").alias("value")).toArrow()
    keys, values = found.column("gram").to_numpy().view(np.uint64), found.column("value").to_numpy()
    order = np.argsort(keys)
    sent = docs.sparkSession.sparkContext.broadcast((keys[order], values[order]))
    fold = _fold()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, values = sent.value
        known: dict[bytes, float] = {}
        for whole in batches:
            for batch in slices(whole, "_words_of"):
                texts = [_distinct_words(t, fold) for t in batch.column("_words_of").to_pylist()]
                if len(known) > HELD_WORDS:
                    known = {}
                new = list(dict.fromkeys(w for words in texts for w in words if w not in known))
                known.update(zip(new, _word_sums(new, keys, values).tolist(), strict=True))
                sums = [_document_sum(np.array([known[w] for w in words], np.float64)) for words in texts]
                names = [c for c in batch.schema.names if c != "_words_of"]
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(sums, pa.float64())], [*names, "evidence"])

    kept = [f for f in docs.schema.fields if f.name != "_words_of"]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept)
    return docs.mapInArrow(run, f"{schema}, evidence double")


def _sums_by_join(docs: DataFrame, table: DataFrame) -> DataFrame:
    """The same by joins: different words meet the differences, and documents the sums of their words."""
    fold = _fold()

    def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "_words_of", 1 << 20):
                texts = [_distinct_words(t, fold) for t in batch.column("_words_of").to_pylist()]
                owner = np.repeat(np.arange(len(texts)), [len(w) for w in texts])
                yield pa.record_batch(
                    {
                        "row": batch.column("row").take(pa.array(owner)),
                        "place": np.concatenate([np.zeros(0, np.int64), *(np.arange(len(w)) for w in texts)]).astype(np.int64),
                        "word": pa.array([w for words in texts for w in words], pa.binary()),
                    }
                )

    def spell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = batch.column("word").to_pylist()
            grams, owner = _grams(words, ORDER) if words else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
            yield pa.record_batch({"word": batch.column("word").take(pa.array(owner)), "gram": grams.view(np.int64)})

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = batch.column("words").to_pylist()
            sums = [_document_sum(np.array([w["difference"] for w in found or ()], np.float64)) for found in words]
            names = [c for c in batch.schema.names if c != "words"]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(sums, pa.float64())], [*names, "evidence"])

    numbered = settle(docs.withColumn("row", F.monotonically_increasing_id()))
    words = numbered.select("row", "_words_of").mapInArrow(explode, "row long, place long, word binary")
    spelled = words.select("word").distinct().mapInArrow(spell, "word binary, gram long")
    values = table.select("gram", F.col("value").cast("float").alias("value"))
    context = F.shiftleft(F.shiftrightunsigned("gram", 8), 8)
    found = spelled.withColumn("context", context).join(values, "gram", "left")
    found = found.join(values.select(F.col("gram").alias("context"), F.col("value").alias("free")), "context", "left")
    sums = found.groupBy("word").agg(F.sum(F.coalesce("value", "free", F.lit(0.0)).cast("double")).alias("difference"))
    gathered = words.join(sums, "word").groupBy("row").agg(F.sort_array(F.collect_list(F.struct("place", "difference"))).alias("words"))
    joined = numbered.drop("_words_of").join(gathered, "row", "left").drop("row")
    kept = [f for f in docs.schema.fields if f.name != "_words_of"]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept)
    return joined.mapInArrow(judge, f"{schema}, evidence double")


def fit_curve(evidence: np.ndarray, toxic: np.ndarray) -> tuple[float, float]:
    """Slope and offset of a logistic curve (Newton steps); targets are pulled in by the size of each class, a missed toxic row costs ``MISSED``."""
    bad, good = toxic.sum(), (1 - toxic).sum()
    if not bad or not good:
        return 1.0, 0.0
    goal = np.where(toxic == 1, (bad + 1) / (bad + 2), 1 / (good + 2))
    cost = np.where(toxic == 1, MISSED, 1.0)
    design = np.stack([evidence, np.ones(len(evidence))], axis=1)
    weights = np.zeros(2)
    for _ in range(50):
        chance = 1 / (1 + np.exp(-np.clip(design @ weights, -30, 30)))
        curve = design.T @ (design * (cost * np.maximum(chance * (1 - chance), 1e-6))[:, None]) + 1e-6 * np.eye(2)
        step = np.linalg.solve(curve, design.T @ (cost * (goal - chance)))
        weights += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-9:
            break
    return float(weights[0]), float(weights[1])


def score(docs: DataFrame, labels: DataFrame, held_out: Column, table_bytes: int = TABLE_BYTES) -> DataFrame:
    """``docs`` with evidence (the sum), score (0 to 1) and predicted; labels (doc_id, toxic) of rows that ``held_out`` names are not read."""
    spark = docs.sparkSession
    added = ("score", "predicted", "evidence", "_words_of")
    own = [c for c in docs.columns if c.lower() not in added]
    marked = settle(labels.where("doc_id is not null and toxic in (0, 1)").groupBy("doc_id").agg(F.max("toxic").alias("toxic")))
    marked = F.broadcast(marked) if marked.count() <= BROADCAST_LABELS else marked
    # One part in four of the learning rows stays out of the early counts, for the curve.
    late = F.pmod(F.xxhash64("doc_id"), F.lit(4)) == 0
    kind = F.when(F.col("toxic").isNotNull() & ~held_out, (1 - F.col("toxic") + F.when(late, 2).otherwise(0)).cast("int"))
    rows = docs.select("doc_id", "text").join(marked, "doc_id", "left").withColumn("kind", kind)

    def evidence(of: DataFrame, table: DataFrame) -> DataFrame:
        small = table.count() * ENTRY_BYTES <= table_bytes
        return (_sums_by_table if small else _sums_by_join)(of, table)

    with scratch(spark) as store:
        counted = store(_count(rows))
        chances = _shared_chances(counted.where("lower").select("gram", "n"))
        full = counted.where("not lower").withColumn("low", _last(F.col("gram"), SHARED[-1]))
        spellings = store(full.join(chances, "low").select("gram", "chance", *CLASSES))
        early = settle(differences(spellings, F.col("toxic_early"), F.col("plain_early")))
        table = settle(
            differences(spellings, F.col("toxic_early") + F.col("toxic_late"), F.col("plain_early") + F.col("plain_late"))
        )
    if table.isEmpty():
        return docs.select(*own, F.lit(None).cast("double").alias("evidence"), F.lit(0.0).alias("score"), F.lit(0).alias("predicted"))
    judged = rows.where("kind >= 2")
    share = min(1.0, FITTED / max(judged.count(), 1))
    pick = F.pmod(F.xxhash64("text", "doc_id"), F.lit(1_000_003)) < int(share * 1_000_003) + 1
    sample = evidence(judged.where(pick).select((3 - F.col("kind")).alias("toxic"), F.col("text").alias("_words_of")), early).toArrow()
    slope, offset = fit_curve(sample.column("evidence").to_numpy(), sample.column("toxic").to_numpy())
    found = evidence(docs.select(*own, F.col("text").alias("_words_of")), table)
    chance = 1 / (1 + F.exp(-(F.lit(slope) * F.col("evidence") + F.lit(offset))))
    return found.select(*own, "evidence", chance.alias("score")).withColumn("predicted", F.when(F.col("score") >= 0.5, 1).otherwise(0))
