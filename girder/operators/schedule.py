"""Receipt schedules: milestones of a contract and delayed receipts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from girder.functions.exprs import month_diff, month_key, month_start

# Milestone names and their parts of the contract amount.
MILESTONES = (("前払金", 0.4), ("中間金", 0.2), ("完成金", 0.4))


def expand_milestones(projects: DataFrame, keep: Sequence[str] = ("project_id",)) -> DataFrame:
    """Three receipts per contract: a month after start, halfway, a month after the end."""
    (advance, a_part), (interim, i_part), (final, f_part) = MILESTONES
    half = F.floor(F.greatest(F.lit(1), month_diff("end_date", "start_date")) / 2).cast("int")

    def receipt(name: str, part: float, due) -> F.Column:
        return F.struct(
            F.lit(name).alias("milestone"),
            (F.col("contract_amount_kpy") * F.lit(part)).cast("long").alias("expected_amount_kpy"),
            due.alias("expected_date"),
        )

    return (
        projects.select(
            *keep,
            F.explode(
                F.array(
                    receipt(advance, a_part, F.add_months("start_date", 1)),
                    receipt(interim, i_part, F.add_months("start_date", half)),
                    receipt(final, f_part, F.add_months("end_date", 1)),
                )
            ).alias("r"),
        )
        .select(*keep, "r.*")
        .withColumn("deposit_month", month_key("expected_date"))
    )


def delay_receipts(cash_in: DataFrame, months: int, **chosen) -> DataFrame:
    """Unpaid receipts of the chosen projects moved ``months`` later.

    ``chosen`` maps a column of the schedule to the values to delay; money that
    has already arrived stays where it is.
    """
    hit = F.col("actual_amount_kpy").isNull()
    for col, values in chosen.items():
        hit = hit & F.col(col).isin(list(values) if isinstance(values, (list, tuple, set)) else [values])
    later = month_key(F.add_months(month_start("deposit_month"), months))
    return cash_in.withColumn("deposit_month", F.when(hit, later).otherwise(F.col("deposit_month")))
