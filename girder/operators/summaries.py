"""Shares, histograms, pivots, correlation, concentration, top-k and cards."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from girder.functions.exprs import safe_div


def share_of_total(
    df: DataFrame,
    keys: Sequence[str],
    value: Column,
    name: str,
    within: Sequence[str] = (),
) -> DataFrame:
    """Aggregate per key with its percentage of the total, or of the total in ``within``.

    Totals are taken from the same aggregate, whose shuffle Spark reuses, as a
    scalar subquery or a join; no task receives all groups of a total.
    """
    grouped = df.groupBy(*within, *keys).agg(value.alias(name))
    if not within:
        total = grouped.agg(F.sum(name)).scalar()
        return grouped.withColumn("share_pct", safe_div(F.col(name), total) * 100)
    totals = grouped.groupBy(*within).agg(F.sum(name).alias("_total"))
    return (
        grouped.join(totals, list(within))
        .withColumn("share_pct", safe_div(F.col(name), F.col("_total")) * 100)
        .drop("_total")
    )


def histogram(df: DataFrame, value: str, bins: int, by: Sequence[str]) -> DataFrame:
    """Equal-width bins over each group's own [min, max]; the last bin is closed.

    A group with a single distinct value falls into bin 1. Only non-empty bins
    are returned.
    """
    known = df.select(*by, value).filter(F.col(value).isNotNull())
    bounds = known.groupBy(*by).agg(F.min(value).alias("_lo"), F.max(value).alias("_hi"))
    x, lo, hi = (F.col(c).cast("double") for c in (value, "_lo", "_hi"))
    bin_no = F.when(lo == hi, F.lit(1)).otherwise(F.least(F.width_bucket(x, lo, hi, F.lit(bins)), F.lit(bins)))
    width = (hi - lo) / bins
    return (
        known.join(bounds, list(by))
        .groupBy(*by, bin_no.cast("int").alias("bin"), lo.alias("_lo"), width.alias("_width"))
        .agg(F.count("*").alias("row_count"))
        .select(
            *by,
            "bin",
            (F.col("_lo") + (F.col("bin") - 1) * F.col("_width")).alias("bin_from"),
            (F.col("_lo") + F.col("bin") * F.col("_width")).alias("bin_to"),
            "row_count",
        )
    )


def pivot_count(df: DataFrame, rows: Sequence[str], column: str, values: Sequence[str]) -> DataFrame:
    """Row counts with one column per listed value, empty cells 0."""
    return df.groupBy(*rows).pivot(column, list(values)).agg(F.count(F.lit(1))).fillna(0, subset=list(values))


def pivot_sum(df: DataFrame, rows: Sequence[str], column: str, values: Sequence[str], amount: str) -> DataFrame:
    return df.groupBy(*rows).pivot(column, list(values)).agg(F.sum(amount)).fillna(0, subset=list(values))


def correlation_pairs(df: DataFrame, measures: Sequence[str]) -> DataFrame:
    """Full Pearson matrix as (measure_a, measure_b, correlation) rows.

    Each pair uses the rows where both are known. All coefficients come from
    one aggregate.
    """
    pairs = list(combinations(measures, 2))
    doubles = df.select(*[F.col(m).cast("double").alias(m) for m in measures])
    known = [F.when(F.count(m) > 0, F.lit(1.0)).alias(m) for m in measures]
    one = doubles.agg(*[F.corr(a, b).alias(f"{a}|{b}") for a, b in pairs], *known)

    def cell(a: str, b: str, source: str) -> Column:
        return F.struct(
            F.lit(a).alias("measure_a"), F.lit(b).alias("measure_b"), F.col(f"`{source}`").alias("correlation")
        )

    cells = [cell(m, m, m) for m in measures]
    for a, b in pairs:
        cells += [cell(a, b, f"{a}|{b}"), cell(b, a, f"{a}|{b}")]
    return one.select(F.explode(F.array(*cells)).alias("c")).select("c.*")


def concentration(df: DataFrame, group: Sequence[str], part: str, amount: str, name: str = "hhi") -> DataFrame:
    """Sum of squared shares per group with its total; 0 when the total is not positive."""
    parts = df.groupBy(*group, part).agg(F.sum(amount).alias("_part"))
    share = F.col("_part").cast("double")
    total = F.sum("_part")
    index = F.when(total > 0, F.sum(share * share) / (total.cast("double") * total.cast("double"))).otherwise(F.lit(0.0))
    return parts.groupBy(*group).agg(total.alias("total"), index.alias(name))


def top_k(df: DataFrame, by: str, k: int, tie: Sequence[str], descending: bool = True) -> DataFrame:
    """The k rows with the largest (or smallest) known value, ties by ``tie``."""
    order = F.col(by).desc() if descending else F.col(by).asc()
    return df.filter(F.col(by).isNotNull()).orderBy(order, *tie).limit(k)


def relative_size(df: DataFrame, value: str, scale: float = 300, name: str = "bubble_size") -> DataFrame:
    """Value as a fraction of the table's maximum, times ``scale``."""
    largest = df.agg(F.max(value)).scalar()
    return df.withColumn(name, F.col(value) / largest * scale)


def standardize(df: DataFrame, cols: Sequence[str], suffix: str = "_z") -> DataFrame:
    """(x - mean) / population standard deviation; a constant column becomes 0."""
    moments = [F.struct(F.avg(c).alias("mean"), F.stddev_pop(c).alias("std")).alias(c) for c in cols]
    stats = df.agg(F.struct(*moments).alias("stats")).scalar()

    def scaled(c: str) -> Column:
        return F.coalesce(safe_div(F.col(c) - stats[c]["mean"], stats[c]["std"]), F.lit(0.0))

    return df.withColumns({c + suffix: scaled(c) for c in cols})


AGGREGATES = {"sum": F.sum, "avg": F.avg, "max": F.max, "min": F.min, "count": F.count}


def cards(df: DataFrame, measures: Mapping[str, tuple[str, str]]) -> DataFrame:
    """One row of score cards; ``measures`` maps the card to (aggregate, column)."""
    return df.agg(*[AGGREGATES[how](c).alias(name) for name, (how, c) in measures.items()])


def chart(df: DataFrame, dims: Sequence[str], measures: Mapping[str, tuple[str, str]]) -> DataFrame:
    """Chart series: measures per dimension value."""
    return df.groupBy(*dims).agg(*[AGGREGATES[how](c).alias(name) for name, (how, c) in measures.items()])
