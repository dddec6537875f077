"""Monthly cash frame, its features, danger months and alerts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from girder.functions.exprs import div_or_one, month_key, month_start, zero
from girder.operators.summaries import concentration, pivot_sum
from girder.operators.timeline import by_time, change, rolling_mean, running_total
from girder.plans.explore import CATEGORIES
from girder.sources.sinks import json_of


def monthly_cash(cash_in: DataFrame, costs: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Inflow, outflow, net, cumulative net and payment concentration per month.

    ``by`` names series columns both tables have. The concentration index comes
    from the same aggregate as the outflow and is NULL in a month without costs.
    """
    inflow = cash_in.groupBy(*by, F.col("deposit_month").alias("month")).agg(
        F.sum("expected_amount_kpy").alias("inflow")
    )
    dated = costs.withColumnRenamed("payment_due_month", "month")
    outflow = concentration(dated, [*by, "month"], "category", "amount_kpy").withColumnRenamed("total", "outflow")
    net = F.col("net_cashflow")
    return (
        inflow.join(outflow, [*by, "month"], "full")
        .withColumns({"month": month_start("month"), "inflow": zero("inflow"), "outflow": zero("outflow")})
        .withColumn("net_cashflow", F.col("inflow") - F.col("outflow"))
        .withColumn("cumulative_cashflow", running_total(net, by_time("month", by)))
        .select(*by, "month", "inflow", "outflow", "net_cashflow", "cumulative_cashflow", "hhi")
    )


def outflow_by_category(cash: DataFrame, costs: DataFrame, categories: Sequence[str] = CATEGORIES) -> DataFrame:
    """Payments by category for every month of the cash frame, 0 where none."""
    wide = pivot_sum(
        costs.withColumn("month", month_start("payment_due_month")), ["month"], "category", categories, "amount_kpy"
    )
    return cash.select("month").join(wide, "month", "left").fillna(0, subset=list(categories))


CASH_FEATURES = ("net_cashflow", "inflow_outflow_ratio", "mom_change", "diff_from_3m_avg", "hhi")


def cash_features(cash: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Ratio, month-over-month change and deviation from the rolling mean."""
    w = by_time("month", by)
    net = F.col("net_cashflow")
    return (
        cash.withColumn("inflow_outflow_ratio", div_or_one("inflow", "outflow", only_zero=True))
        .withColumn("mom_change", change(net, w))
        .withColumn("rolling_3m_avg", rolling_mean(net, w, 3))
        .withColumn("diff_from_3m_avg", net - F.col("rolling_3m_avg"))
        .withColumn("hhi", F.coalesce("hhi", F.lit(0.0)))
    )


def danger_months(cash: DataFrame) -> DataFrame:
    """Months whose cumulative cash is below zero."""
    return cash.filter(F.col("cumulative_cashflow") < 0)


def anomaly_details(scored: DataFrame) -> DataFrame:
    """The flagged months, figures rounded to two decimals."""
    return scored.filter("is_anomaly").select(
        "month",
        *[
            F.round(F.col(c).cast("double"), 2).alias(c)
            for c in ("inflow", "outflow", "net_cashflow", "mom_change", "anomaly_score")
        ],
    )


# Alert kinds and message formats.
ANOMALY_TYPE = "異常値検知"
SHORTAGE_TYPE = "資金ショート警戒"
ANOMALY_MESSAGE = (
    "通常と異なるキャッシュフロー変動を検知しました。入出金バランス(Net: %s千円)の確認を推奨します。"
)
SHORTAGE_MESSAGE = (
    "累計キャッシュフローが警戒ライン(%s千円)を下回っています！至急、資金調達または支払延期の調整が必要です。"
)


def cash_alerts(scored: DataFrame, threshold: int = -50000, by: Sequence[str] = ()) -> DataFrame:
    """Alert rows of every month, warning first; a month can raise both.

    One pass: each month carries an array of its possible alerts, of which the
    ones that apply are exploded.
    """
    warning = F.struct(
        F.lit("WARNING").alias("level"),
        F.lit(ANOMALY_TYPE).alias("type"),
        F.format_string(ANOMALY_MESSAGE, F.format_number("net_cashflow", 0)).alias("message"),
        json_of(
            F.col("inflow"), F.col("outflow"), F.round("anomaly_score", 3).alias("anomaly_score")
        ).alias("details"),
    )
    critical = F.struct(
        F.lit("CRITICAL").alias("level"),
        F.lit(SHORTAGE_TYPE).alias("type"),
        F.format_string(SHORTAGE_MESSAGE, F.format_number(F.lit(threshold), 0)).alias("message"),
        json_of(F.col("cumulative_cashflow")).alias("details"),
    )
    raised = F.array_compact(
        F.array(
            F.when(F.col("is_anomaly"), warning),
            F.when(F.col("cumulative_cashflow") < threshold, critical),
        )
    )
    return scored.select(*by, month_key("month").alias("month"), F.posexplode(raised).alias("seq", "a")).select(
        *by, "a.level", "a.type", "month", "a.message", "a.details"
    )
