"""Finding short test items inside long documents by size-partitioned MinHash containment.

Items are partitioned by their number of shingles. Items of up to ``SHORT``
shingles make bands of single shingles: as many that one of them is in every
document that holds enough of the item, so none is missed. Longer ones form
levels (up to 16, 32, 64 ...). For each level, documents are cut into blocks of
as many shingles, so an item and a block are of like size. Blocks and items get
MinHash values; each is a band of its own, and one equal value makes the
block's document a candidate. Their number follows from ``LOSS``: an item of q
shingles and a block of U that shares one of them have Jaccard 1 / (U + q - 1),
and shared shingles are hardest to meet when every one of them stands in
another block, so a contained item of any size is missed with a chance of at
most ``LOSS``, wherever its shingles stand, as far as MinHash values are
independent. Candidates are verified by exact containment of the item's
distinct shingles in the document's.

A MinHash value is the least exclusive-or of the shingles' 64-bit hashes with a
constant; the constants differ in their leading bits, so the values pick
shingles in different parts of the hash space.

Texts are lower-cased and cut into words at space and \\x09-\\x0D. A text with
fewer words than a shingle is one shingle as a whole; null, empty or blank
text has none and neither matches nor is matched. Rows of one doc_id are one
document, rows of one item_id one item; rows without id are left out. Equal
items match alike. An empty table on either side gives an empty result.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from girder.llm.scratch import rows_of_ids
from girder.session import settle

SHINGLE = 5
SHORT = 8
LOSS = 1e-5
# Rows of item values or shingles up to this number (about 30 bytes each) are broadcast; more are joined by shuffle.
BROADCAST_ROWS = 500_000


def constants(n: int) -> list[int]:
    """Signed 64-bit constants with evenly spread leading bits."""
    return [((k * (1 << 64)) // n + 0x3C6EF372FE94F82B * k % (1 << 56)) % (1 << 64) - (1 << 63) for k in range(n)]


def rows_needed(limit: int, percent: int, loss: float = LOSS) -> int:
    """MinHash values that a level of more than ``limit`` / 2 and up to ``limit`` shingles needs."""
    missed = lambda q: max(-(-percent * q // 100), 1) * math.log(1 - 1 / (limit + q - 1))
    return math.ceil(math.log(loss) / max(missed(q) for q in range(limit // 2 + 1, limit + 1)))


def shingle_rows(rows: DataFrame, key: str, size: int) -> DataFrame:
    """(key, at, token) for every shingle of every text, in one pass of generated code."""
    clean = F.btrim(F.lower("text"), F.lit(" \t\n\x0b\x0c\r"))
    words = F.split(clean, r"[\x20\x09-\x0D]+")
    split = rows.where(F.col(key).isNotNull() & (F.length(clean) > 0)).select(key, words.alias("words"))
    at = F.explode(F.sequence(F.lit(0), F.greatest(F.size("words") - size, F.lit(0))))
    token = F.xxhash64(*[F.get("words", F.col("at") + k) for k in range(size)])
    return split.select(key, "words", at.alias("at")).select(key, "at", token.alias("token"))


def _least(token: Column, rows: int) -> list[Column]:
    return [F.min(token.bitwiseXOR(F.lit(c))).alias(f"m{k}") for k, c in enumerate(constants(rows))]


def _stacked(rows: int) -> Column:
    return F.explode(F.array(*[F.struct(F.lit(k).alias("band"), F.col(f"m{k}").alias("value")) for k in range(rows)])).alias("x")


def _maybe_broadcast(df: DataFrame, small: bool) -> DataFrame:
    return F.broadcast(df) if small else df


def _met_by_shingle(texts: DataFrame, short: DataFrame, percent: int, size: int, few: bool) -> DataFrame:
    """Candidates for short items: a document that lacks the n - needed + 1 asked of n shingles cannot hold the needed."""
    needed = F.ceil(F.col("item_size") * percent / 100)
    asked = F.slice(F.sort_array(F.collect_set("token")), 1, F.greatest(F.col("item_size") - needed + 1, F.lit(0)).cast("int"))
    tokens = short.groupBy("item_id", "item_size").agg(asked.alias("asked")).select("item_id", F.explode("asked").alias("token"))
    found = shingle_rows(texts, "doc_id", size).select("doc_id", "token")
    return found.join(_maybe_broadcast(tokens, few), "token").select("doc_id", "item_id")


def _met_by_blocks(texts: DataFrame, tokens: DataFrame, levels: list[int], size: int, rows: int, few: bool) -> DataFrame:
    """Candidates for items with a level: a block of as many shingles has an equal MinHash value."""
    # The texts are dealt out once; blocks of a document then need no further shuffle.
    dealt = shingle_rows(texts.repartition("doc_id"), "doc_id", size)
    block = F.explode(F.array(*[F.struct(F.lit(n).alias("level"), F.floor(F.col("at") / n).cast("int").alias("block")) for n in levels]))
    blocks = (
        dealt.select("doc_id", "token", block.alias("b"))
        .select("doc_id", "token", "b.level", "b.block")
        .groupBy("doc_id", "level", "block")
        .agg(*_least(F.col("token"), rows))
    )
    signed = tokens.groupBy("item_id", "level").agg(*_least(F.col("token"), rows))
    values = blocks.select("doc_id", "level", _stacked(rows)).select("doc_id", "level", "x.band", "x.value")
    asked = signed.select("item_id", "level", _stacked(rows)).select("item_id", "level", "x.band", "x.value")
    return values.join(_maybe_broadcast(asked, few), ["level", "band", "value"]).select("doc_id", "item_id")


def contained(docs: DataFrame, items: DataFrame, percent: int = 80, size: int = SHINGLE, rows: int | None = None) -> DataFrame:
    """(doc_id, item_id, item_size, shared, containment) where a document holds ``percent`` of an item's shingles.

    ``rows`` MinHash values for each block; as many as ``LOSS`` asks for by default.
    """
    tokens = settle(shingle_rows(items, "item_id", size).select("item_id", "token").distinct())
    level = F.when(F.col("item_size") <= SHORT, 0).otherwise(F.pow(2, F.ceil(F.log2("item_size"))).cast("int"))
    signed = settle(tokens.groupBy("item_id").agg(F.count("*").alias("item_size")).withColumn("level", level))
    levels = [r["level"] for r in signed.select("level").distinct().orderBy("level").collect()]  # one for each power of two
    wide = [n for n in levels if n]
    rows = rows or max((rows_needed(n, percent) for n in wide), default=1)
    few_items = signed.count() * rows <= BROADCAST_ROWS
    few_tokens = tokens.count() <= BROADCAST_ROWS

    texts = docs.select("doc_id", "text")
    sized = tokens.join(_maybe_broadcast(signed, few_items), "item_id")
    met = []
    if wide:
        met.append(_met_by_blocks(texts, sized.where("level > 0"), wide, size, rows, few_items))
    if len(wide) < len(levels) or not levels:
        met.append(_met_by_shingle(texts, sized.where("level = 0"), percent, size, few_tokens))
    candidates = settle(reduce(DataFrame.unionAll, met).distinct())

    # Whole texts of the candidates against the items' shingles.
    named = settle(candidates.select("doc_id").distinct())
    found = shingle_rows(rows_of_ids(texts, named), "doc_id", size).select("doc_id", "token")
    met = found.join(_maybe_broadcast(tokens, few_tokens), "token").distinct()
    shared = met.join(candidates, ["doc_id", "item_id"]).groupBy("doc_id", "item_id").agg(F.count("*").alias("shared"))
    checked = shared.join(_maybe_broadcast(signed.select("item_id", "item_size"), few_items), "item_id")
    return checked.where(F.col("shared") * 100 >= F.col("item_size") * percent).select(
        "doc_id", "item_id", "item_size", "shared", (F.col("shared") / F.col("item_size")).alias("containment")
    )


def clean(docs: DataFrame, items: DataFrame, percent: int = 80, size: int = SHINGLE) -> DataFrame:
    """``docs`` without the documents that contain an item."""
    hits = settle(contained(docs, items, percent, size).select("doc_id").distinct())
    return rows_of_ids(docs, hits, keep=False)
