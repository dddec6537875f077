"""Mixing sources to target weights by Pareto order sampling.

Every source gets a target number of words: its share of a total by weight,
cut at a ceiling of copies, the excess shared out again. A source whose target
is 1.3 times its words takes every document once for certain and the other
0.3 by order sampling: documents are ranked by the odds of a uniform random
number over the odds of their inclusion probability, and the lowest ranks are
taken up to the target.

The random number is a hash of seed and doc_id, so reruns and recomputed
tasks agree. The ranks of one source are never sorted in one task: words are
summed in cells of the rank first, and only the cell that holds the cut is
ordered. Each document then decides by itself from one row per source.

Null or empty text has size 0 and takes no words. Null is a source of its
own, last in order. Rows that repeat a doc_id have equal random numbers and go
by their text; of rows alike in both that stand at the cut, as many are taken
as come nearest to the target. An empty table gives an empty result. Columns
of the input that are named like an added one are replaced.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from girder.session import settle

CELLS = 4096
# Sources up to this number are joined by broadcast (about 100 bytes each), more by an ordinary join.
BROADCAST_SOURCES = 100_000


def word_count(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def uniform(key: Column, seed: int) -> Column:
    """A number in (0, 1) that depends on ``key`` and ``seed`` alone."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit("")))
    return (F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("long") + F.lit(0.5)) / F.lit(float(1 << 52))


def source_targets(sizes: DataFrame, weights: Sequence[int], share: float, ceiling: int) -> DataFrame:
    """One row per source: its words and its target.

    The targets are found in closed form: sources in the order of ceiling over
    weight fill up first, and what is left is shared by weight among the rest.
    The windows run over one row per source.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(int(w)) for w in weights]), ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int"))
    totals = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.sum(F.col("size") * F.col("lean")).alias("leaning"))
    cap = F.col("source_size") * ceiling
    order = Window.orderBy(cap / F.col("weight"), F.col("source").asc_nulls_last())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    after = order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    whole = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    level = (F.sum("source_size").over(whole) * F.lit(share) - F.coalesce(F.sum(cap).over(before), F.lit(0))) / F.sum("weight").over(after)
    levels = totals.withColumn("weight", weight).withColumn("level", level)
    open_level = F.when(cap / F.col("weight") > F.col("level"), F.col("level"))
    return levels.withColumn("shared", F.first(open_level, ignorenulls=True).over(whole)).select(
        "source",
        "source_size",
        "leaning",
        F.least(cap.cast("double"), F.coalesce(F.col("shared") * F.col("weight"), cap.cast("double"))).alias("target"),
    )


def _ranked(rows: DataFrame, seed: int) -> DataFrame:
    """Adds whole copies, the words still needed, and each document's rank value and cell."""
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    part = F.col("ratio") - F.col("whole")
    mean = F.col("leaning") / F.col("source_size")
    chance = F.col("part") + F.col("part") * (1.0 - F.col("part")) * (F.col("lean") - mean) / 1000.0
    rank = (F.col("draw") * (1.0 - F.col("chance"))) / ((1.0 - F.col("draw")) * F.col("chance"))
    even = F.col("rank") * F.col("part") / (1.0 - F.col("part"))
    return (
        rows.withColumn("ratio", ratio)
        .withColumn("whole", F.floor("ratio").cast("long"))
        .withColumn("part", part)
        .withColumn("needed", F.col("target") - F.col("whole") * F.col("source_size"))
        .withColumn("draw", uniform(F.col("doc_id"), seed))
        .withColumn("chance", F.when((F.col("part") > 0) & (F.col("size") > 0), chance))
        .withColumn("rank", rank)
        .withColumn("cell", F.floor(even / (1.0 + even) * CELLS).cast("int"))
    )


def _join_sources(rows: DataFrame, sources: DataFrame, broadcast: bool) -> DataFrame:
    named = sources.withColumnRenamed("source", "named_source")
    return rows.join(F.broadcast(named) if broadcast else named, F.col("source").eqNullSafe(F.col("named_source")), "left").drop("named_source")


def _place() -> Column:
    """Where a row stands in its source: by rank value, id and text; only rows alike in all three stand together."""
    return F.struct(F.col("rank"), F.coalesce("doc_id", F.lit(-(1 << 63))).alias("doc_id"), F.col("mark"))


def mix_sources(
    docs: DataFrame, weights: Sequence[int] = (3, 1, 2), share: float = 1.5, ceiling: int = 2, seed: int = 17
) -> DataFrame:
    """``docs`` with size, source_size, target, copies and taken (words over all copies).

    The inclusion probabilities lean towards short documents, by at most the
    factor that keeps them between 0 and 1, and sum to the words needed. A
    source's taken words miss its target by half a document at most.
    """
    added = ("size", "source_size", "target", "copies", "taken")
    own = [c for c in docs.columns if c.lower() not in added]
    lean = F.floor(F.lit(100_000) / (F.col("size") + 100)).cast("long")
    # Own columns travel in a struct, where no name meets one used here.
    sized = docs.select(
        F.struct(*own).alias("own"), F.col("doc_id").cast("long").alias("doc_id"), "source", F.xxhash64("text").alias("mark"), word_count(F.col("text")).alias("size")
    ).withColumn("lean", lean)
    slim = settle(sized.select("doc_id", "source", "mark", "size", "lean"))
    targets = settle(source_targets(slim, weights, share, ceiling))
    small = targets.count() <= BROADCAST_SOURCES

    ranked = _ranked(_join_sources(slim, targets, small), seed).where("chance is not null")
    cells = ranked.groupBy("source", "cell").agg(F.sum("size").alias("words"), F.first("needed").alias("needed"))
    running = F.sum("words").over(Window.partitionBy("source").orderBy("cell"))
    cut_cells = (
        cells.withColumn("upto", running)
        .where((F.col("upto") >= F.col("needed")) & (F.col("upto") - F.col("words") < F.col("needed")))
        .select(F.col("source").alias("named_source"), F.col("cell").alias("cut_cell"), (F.col("upto") - F.col("words")).alias("below"))
    )
    cut_cells = F.broadcast(cut_cells) if small else cut_cells
    inside = ranked.join(cut_cells, F.col("source").eqNullSafe(F.col("named_source")) & (F.col("cell") == F.col("cut_cell")))
    # Rows that repeat are one place with a number of rows, of which as many are taken as fit.
    places = inside.groupBy("source", _place().alias("place"), "size").agg(
        F.count("*").alias("held"), F.first("below").alias("below"), F.first("needed").alias("needed")
    )
    before = F.sum(F.col("size") * F.col("held")).over(Window.partitionBy("source").orderBy("place").rowsBetween(Window.unboundedPreceding, -1))
    room = (F.col("needed") - F.col("below") - F.coalesce(before, F.lit(0))) / F.col("size") + 0.5
    fit = F.greatest(F.lit(0), F.least(F.col("held"), F.floor(room).cast("long")))
    last = places.withColumn("fit", fit).where("fit > 0").groupBy("source").agg(F.max(F.struct("place", "fit", "held")).alias("last"))
    cuts = (
        targets.join(cut_cells, F.col("source").eqNullSafe(F.col("named_source")), "left")
        .drop("named_source")
        .join(last.withColumnRenamed("source", "last_source"), F.col("source").eqNullSafe(F.col("last_source")), "left")
        .drop("last_source")
    )
    cuts = settle(cuts)

    decided = _ranked(_join_sources(sized, cuts, small), seed)
    at_cut = F.col("cell") == F.col("cut_cell")
    torn = F.col("chance").isNotNull() & at_cut & (_place() == F.col("last.place")) & (F.col("last.fit") < F.col("last.held"))
    torn = F.coalesce(torn, F.lit(False))
    drawn = (F.col("cell") < F.col("cut_cell")) | (at_cut & (_place() <= F.col("last.place")))
    taken = F.col("chance").isNotNull() & F.coalesce(drawn, F.lit(False))
    if cuts.where("last.fit < last.held").isEmpty():
        decided = decided.withColumn("taken", taken)
    else:
        decided = decided.where(~torn).withColumn("taken", taken).unionByName(_first_of_equals(decided.where(torn)))
    copies = F.col("whole") + F.when(F.col("taken"), 1).otherwise(0)
    return decided.select(
        *[F.col("own")[c].alias(c) for c in own],
        "size",
        "source_size",
        "target",
        copies.cast("int").alias("copies"),
        (copies * F.col("size")).cast("long").alias("taken"),
    )


def _first_of_equals(rows: DataFrame) -> DataFrame:
    """Takes ``last.fit`` of the equal rows at the cut of each source; which of them is all the same.

    They are numbered within the parts they come in, and the parts by their
    counts, so that no task sees all of them.
    """
    parts = settle(rows).withColumn("part", F.spark_partition_id())
    counts = settle(parts.groupBy("source", "part").agg(F.count("*").alias("here")))
    before = F.sum("here").over(Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    ahead = counts.select(F.col("source").alias("of_source"), F.col("part").alias("of_part"), F.coalesce(before, F.lit(0)).alias("ahead"))
    number = F.row_number().over(Window.partitionBy("source", "part").orderBy("mark"))
    joined = parts.withColumn("number", number).join(ahead, F.col("source").eqNullSafe(F.col("of_source")) & (F.col("part") == F.col("of_part")))
    taken = F.col("ahead") + F.col("number") <= F.col("last.fit")
    return joined.withColumn("taken", taken).drop("part", "number", "of_source", "of_part", "ahead")
