"""Daily data-quality figures."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F


def quality_report(
    df: DataFrame,
    table: str,
    not_null: Sequence[str] = (),
    ranges: Mapping[str, tuple[float | None, float | None]] | None = None,
    max_null_pct: float = 0.0,
    max_out_pct: float = 0.0,
) -> DataFrame:
    """Null rate and out-of-range rate of each checked column, with an alert flag.

    One pass over the table, whatever the number of checks.
    """
    checks = _checks(not_null, ranges or {}, max_null_pct, max_out_pct)
    return _report(df.agg(*_counts(checks)), table, checks)


Checks = list[tuple[str, str, Column, float]]


def _checks(not_null: Sequence[str], ranges: Mapping[str, tuple[float | None, float | None]], max_null_pct: float, max_out_pct: float) -> Checks:
    checks: Checks = [(c, "null", F.col(c).isNull(), max_null_pct) for c in not_null]
    for c, (low, high) in ranges.items():
        bad = F.lit(False)
        if low is not None:
            bad = bad | (F.col(c) < low)
        if high is not None:
            bad = bad | (F.col(c) > high)
        checks.append((c, "range", bad, max_out_pct))
    return checks


def _counts(checks: Checks) -> list[Column]:
    return [F.count(F.lit(1)).alias("_rows"), *[F.count(F.when(bad, F.lit(1))).alias(f"_bad{i}") for i, (_, _, bad, _) in enumerate(checks)]]


def _report(one: DataFrame, table: str, checks: Checks) -> DataFrame:
    rows = F.array(
        *[
            F.struct(
                F.lit(table).alias("table_name"),
                F.lit(c).alias("column_name"),
                F.lit(kind).alias("check"),
                F.col("_rows").alias("row_count"),
                F.col(f"_bad{i}").alias("bad_count"),
                F.lit(float(limit)).alias("limit_pct"),
            )
            for i, (c, kind, _, limit) in enumerate(checks)
        ]
    )
    rate = F.coalesce(F.try_divide("bad_count", "row_count") * 100, F.lit(0.0))
    return (
        one.select(F.explode(rows).alias("r"))
        .select("r.*")
        .withColumn("bad_pct", rate)
        .withColumn("is_alert", F.when(F.col("bad_pct") > F.col("limit_pct"), 1).otherwise(0))
    )


def write_checked(
    df: DataFrame,
    write: Callable[[DataFrame], None],
    table: str,
    not_null: Sequence[str] = (),
    ranges: Mapping[str, tuple[float | None, float | None]] | None = None,
    max_null_pct: float = 0.0,
    max_out_pct: float = 0.0,
) -> DataFrame:
    """Writes ``df`` by ``write`` and returns the quality report of what went through.

    The counts are taken on the pass that writes, so the rows are not computed
    or read again. ``write`` runs one job over all rows of the frame it is
    given. In a stream this is called with each micro-batch.
    """
    checks = _checks(not_null, ranges or {}, max_null_pct, max_out_pct)
    seen = Observation()
    write(df.observe(seen, *_counts(checks)))
    names = [f"_bad{i}" for i in range(len(checks))]
    counted = seen.get
    one = df.sparkSession.createDataFrame([tuple(counted[n] for n in ("_rows", *names))], ", ".join(f"{n} long" for n in ("_rows", *names)))
    return _report(one, table, checks)
