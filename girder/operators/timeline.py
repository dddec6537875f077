"""Month axes, activity counts and window measures over monthly rows.

The windows take an already aggregated monthly table. Without ``by`` it has one
row per calendar month, which is why gathering it in one task is safe; with
``by`` every series is a separate partition.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from girder.functions.exprs import ColumnLike, as_col, first_of_month


def by_time(order: ColumnLike, by: Sequence[str] = ()) -> WindowSpec:
    return Window.partitionBy(*by).orderBy(order)


def trailing_mean(value: ColumnLike, w: WindowSpec, rows: int = 3) -> Column:
    """Mean of the ``rows`` rows before the current one; NULL on the first."""
    return F.avg(as_col(value)).over(w.rowsBetween(-rows, -1))


def rolling_mean(value: ColumnLike, w: WindowSpec, rows: int = 3) -> Column:
    """Mean of the current row and the ones before it, shorter at the start."""
    return F.avg(as_col(value)).over(w.rowsBetween(1 - rows, 0))


def running_total(value: ColumnLike, w: WindowSpec) -> Column:
    return F.sum(as_col(value)).over(w.rowsBetween(Window.unboundedPreceding, 0))


def opening_balance(value: ColumnLike, w: WindowSpec) -> Column:
    """Running total up to the previous row, 0 on the first."""
    before = F.sum(as_col(value)).over(w.rowsBetween(Window.unboundedPreceding, -1))
    return F.coalesce(before, F.lit(0))


def change(value: ColumnLike, w: WindowSpec) -> Column:
    """Difference to the previous row, 0 on the first."""
    return F.coalesce(as_col(value) - F.lag(as_col(value)).over(w), F.lit(0))


def previous(value: ColumnLike, w: WindowSpec, rows: int = 1) -> Column:
    return F.lag(as_col(value), rows).over(w)


def month_axis(df: DataFrame, month: str = "month", by: Sequence[str] = ()) -> DataFrame:
    """Every calendar month between the first and the last one, per series."""
    bounds = df.groupBy(*by).agg(F.min(month).alias("_first"), F.max(month).alias("_last"))
    return bounds.filter(F.col("_first").isNotNull()).select(
        *by, F.explode(F.expr("sequence(_first, _last, interval 1 month)")).alias(month)
    )


def on_axis(
    df: DataFrame,
    axis: DataFrame,
    values: Sequence[str],
    month: str = "month",
    by: Sequence[str] = (),
) -> DataFrame:
    """Monthly rows laid on a full axis; a missing month counts as 0."""
    return axis.join(df, [*by, month], "left").fillna(0, subset=list(values))


def future_months(df: DataFrame, ahead: int, month: str = "month", by: Sequence[str] = ()) -> DataFrame:
    """The ``ahead`` months after the last observed one, with their distance."""
    last = df.groupBy(*by).agg(F.max(month).alias("_last"))
    return last.select(*by, "_last", F.explode(F.sequence(F.lit(1), F.lit(ahead))).alias("step")).select(
        *by, "step", F.add_months("_last", F.col("step")).alias(month)
    )


def activity_changes(projects: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Net change in running projects at each month, two rows per project at most.

    A project runs in month m when start <= first day of m <= end, so one that
    starts after the first of a month counts from the next. Counting arrivals and
    departures keeps the data proportional to the projects, however long they
    run, where pairing every month with every project would not. With a
    ``project_id`` column, rows of one project count once in a month that several
    of them cover.
    """
    begin = first_of_month("start_date")
    begin = F.when(F.col("start_date") == begin, begin).otherwise(F.add_months(begin, 1))
    until = first_of_month("end_date")
    key = ["project_id"] if "project_id" in projects.columns else []
    terms = projects.select(*by, *key, begin.alias("_from"), until.alias("_to")).filter(F.col("_from") <= F.col("_to"))
    return (
        (_merged_terms(terms, [*by, *key]) if key else terms)
        .select(
            *by,
            F.explode(
                F.array(
                    F.struct(F.col("_from").alias("month"), F.lit(1).alias("delta")),
                    F.struct(F.add_months("_to", 1).alias("month"), F.lit(-1).alias("delta")),
                )
            ).alias("c"),
        )
        .select(*by, "c.month", "c.delta")
    )


def _merged_terms(terms: DataFrame, key: Sequence[str]) -> DataFrame:
    """Terms [_from, _to] of one key that touch or overlap as one."""
    w = Window.partitionBy(*key).orderBy("_from", "_to")
    reached = F.max("_to").over(w.rowsBetween(Window.unboundedPreceding, -1))
    starts = F.when(F.col("_from") <= F.add_months(reached, 1), 0).otherwise(1)
    return (
        terms.withColumn("_starts", starts)
        .withColumn("_run", F.sum("_starts").over(w.rowsBetween(Window.unboundedPreceding, 0)))
        .groupBy(*key, "_run")
        .agg(F.min("_from").alias("_from"), F.max("_to").alias("_to"))
    )


def active_projects(projects: DataFrame, months: DataFrame, month: str = "month", by: Sequence[str] = ()) -> DataFrame:
    """Projects running on the first day of each of the given months."""
    asked = months.select(*by, F.col(month).alias("month")).distinct()
    marks = asked.withColumn("delta", F.lit(0)).withColumn("asked", F.lit(1))
    moves = activity_changes(projects, by).withColumn("asked", F.lit(0))
    w = by_time("month", by)
    return (
        moves.unionByName(marks)
        .groupBy(*by, "month")
        .agg(F.sum("delta").alias("delta"), F.max("asked").alias("asked"))
        .withColumn("active_project_count", running_total("delta", w))
        .filter(F.col("asked") == 1)
        .select(*by, F.col("month").alias(month), "active_project_count")
    )


def same_month_last_year(df: DataFrame, values: Sequence[str], month: str = "month", by: Sequence[str] = ()) -> DataFrame:
    """Adds ``<value>_last_year`` from the row twelve months earlier, NULL if none.

    A series has one row per month. The frame is the one month a year back, so
    the source is read once.
    """
    number = F.year(month) * 12 + F.month(month)
    year_ago = Window.partitionBy(*by).orderBy(number).rangeBetween(-12, -12)
    return df.withColumns({f"{v}_last_year": F.max(v).over(year_ago) for v in values})


def asof_join(
    left: DataFrame, right: DataFrame, time: str, values: Sequence[str], by: Sequence[str] = (), span: str = "year"
) -> DataFrame:
    """Rows of ``left`` with the ``values`` of the latest row of ``right`` of their key that is not later.

    Both sides are stacked and the last values are carried forward, so a row is
    sorted once and never paired. A key is cut into ranges of time of one
    ``span``: within a range the values are carried by a window, and what was
    known before a range comes from one row per key and range, so a key that
    holds most rows does not end in one task. Rows of ``right`` at one time go
    by the largest values. A NULL key matches nothing, a row without time
    neither; where nothing is known the values are NULL.
    """
    by = list(by)
    value = F.struct(*[F.col(c) for c in values])
    known = right.dropna(subset=[time, *by]).select(
        *by, F.col(time).alias("_time"), F.lit(0).alias("_side"), value.alias("_value"), F.lit(None).cast(left.select(F.struct("*")).schema[0].dataType).alias("_row")
    )
    asked = left.select(
        *by, F.col(time).alias("_time"), F.lit(1).alias("_side"), F.lit(None).cast(known.schema["_value"].dataType).alias("_value"), F.struct("*").alias("_row")
    )
    stacked = known.unionByName(asked).withColumn("_range", F.date_trunc(span, "_time"))
    # NULL keys stand together in a group and a window, but have no known value there.
    within = Window.partitionBy(*by, "_range").orderBy("_time", "_side", "_value").rowsBetween(Window.unboundedPreceding, 0)
    carried = stacked.withColumn("_here", F.last("_value", ignorenulls=True).over(within)).filter("_side = 1 and _row is not null")
    latest = F.max_by("_value", F.when(F.col("_side") == 0, F.struct("_time", "_value"))).alias("_last")
    ranges = stacked.groupBy(*by, "_range").agg(latest)
    before = F.last("_last", ignorenulls=True).over(Window.partitionBy(*by).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1))
    ranges = ranges.select(*[F.col(c).alias(f"_{c}") for c in by], F.col("_range").alias("_of"), before.alias("_before"))
    same = F.col("_range") == F.col("_of")
    for c in by:
        same = same & (F.col(c) == F.col(f"_{c}"))
    found = F.coalesce(F.col("_here"), F.col("_before"))
    joined = carried.join(ranges, same, "left").withColumn("_found", F.when(F.col("_time").isNotNull(), found))
    kept = [c for c in left.columns if c not in values or c in by]
    return joined.select(*[F.col("_row")[c].alias(c) for c in kept], *[F.col("_found")[c].alias(c) for c in values if c not in by])
