"""KPI documents, report prompts and delivery payloads as JSON or text columns."""

from __future__ import annotations

from collections.abc import Mapping
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from girder.functions.exprs import ColumnLike, as_col, category_budget, month_key, month_start, pct, sum_where, zero
from girder.operators.summaries import top_k
from girder.sources.sinks import json_of

BUSINESSES = ("建設事業", "不動産事業", "SaaS事業", "施設運営")


def _one(df: DataFrame, *cols: Column) -> Column:
    """The columns of a one-row frame as a struct, usable in another query."""
    return df.select(F.struct(*cols)).scalar()


def kpi_document(
    month: str,
    dashboard: DataFrame,
    business: DataFrame,
    summary: DataFrame,
    cashflow: DataFrame,
    saas: DataFrame,
    facilities: DataFrame,
    properties: DataFrame | None = None,
    notable: int = 3,
    ahead: int = 3,
) -> DataFrame:
    """One JSON document with the figures of a ``YYYY-MM`` month.

    Every block is a one-row aggregate read as a scalar subquery. Only the
    ``notable`` projects and the ``ahead`` months are gathered into arrays. A
    notable project's issue is the cost category furthest beyond its budget, the
    warning names the months with a deficit, and the occupancy is that of the
    ``properties`` that are let.
    """
    day = F.to_date(F.lit(month + "-01"))
    company = dashboard.filter(F.col("sales_month") == day).agg(
        F.sum("total_sales").alias("sales"), F.sum("forecast_sales").alias("target")
    )
    units = business.filter(F.col("month") == day).agg(
        *[sum_where(F.col("business") == b, "sales_kpy").alias(b) for b in BUSINESSES]
    )
    over = F.col("total_cost_kpy") - F.col("contract_amount_kpy") * F.col("target_cost_rate") / 100
    high = F.col("risk_level") == "緊急"
    risk = summary.agg(
        F.count(F.when(high, 1)).alias("projects"),
        zero(F.sum(F.when(high, F.round(over).cast("long")))).alias("amount"),
    )
    worst = top_k(summary, "cost_rate_gap", notable, ["project_id"])
    listed = worst.agg(
        F.sort_array(
            F.collect_list(
                F.struct(
                    (-F.col("cost_rate_gap")).alias("k"),
                    "project_id",
                    F.col("project_name").alias("name"),
                    F.col("effective_cost_rate").alias("cost_rate"),
                    F.col("cost_rate_gap").alias("gap"),
                    main_issue().alias("issue"),
                )
            )
        ).alias("rows")
    )
    coming = cashflow.filter((F.col("cf_date") > day) & (F.col("cf_date") <= F.add_months(day, ahead)))
    outlook = coming.agg(
        F.sort_array(
            F.collect_list(F.struct(month_key("cf_date").alias("month"), F.col("net_cashflow_kpy").alias("net_cashflow")))
        ).alias("rows"),
        F.count(F.when(F.col("net_cashflow_kpy") < 0, 1)).alias("negative"),
        F.array_sort(F.collect_list(F.when(F.col("net_cashflow_kpy") < 0, F.col("cf_date")))).alias("short"),
    )
    short = F.transform("short", lambda d: F.date_format(d, "yyyy年MM月"))
    warning = F.when(F.size("short") > 0, F.concat(F.array_join(short, "、"), F.lit("は単月赤字の見込み"))).otherwise("")
    balance = cashflow.filter(F.col("cf_date") == day).agg(F.sum("ending_balance_kpy").alias("balance"))
    subscribed = saas.filter(month_start("month") == day).agg(
        zero(F.sum("mrr_kpy")).alias("mrr"),
        F.round(F.avg("churn_rate_pct"), 2).alias("churn"),
        zero(F.sum("new_customers")).alias("new"),
    )
    visited = facilities.filter(month_start("month") == day).agg(
        zero(F.sum("visitors")).alias("visitors"), zero(F.sum("revenue_kpy")).alias("revenue")
    )
    blocks = {
        "company_summary": _one(
            company,
            F.col("sales").alias("total_revenue"),
            pct("sales", "target").alias("target_achievement_rate"),
        ),
        "revenue_by_bu": _one(units, *[F.col(b) for b in BUSINESSES]),
        "cost_risk_summary": _one(
            risk, F.col("projects").alias("high_risk_projects_count"), F.col("amount").alias("total_risk_amount")
        ),
        "notable_projects": listed.select(
            F.transform("rows", lambda r: F.struct(r["name"].alias("name"), r["cost_rate"].alias("cost_rate"), r["gap"].alias("gap"), r["issue"].alias("issue")))
        ).scalar(),
        "current_balance": balance.scalar(),
        "next_months_forecast": outlook.select("rows").scalar(),
        "negative_months": outlook.select("negative").scalar(),
        "warning": outlook.select(warning).scalar(),
        "saas_metrics": _one(
            subscribed,
            F.col("mrr"),
            (F.col("mrr") * 12).alias("arr"),
            F.col("churn").alias("churn_rate_percent"),
            F.col("new").alias("new_acquisitions"),
        ),
        "facility_operations": _one(
            visited, F.col("visitors").alias("visitors_last_month"), F.col("revenue").alias("revenue_last_month")
        ),
    }
    if properties is not None:
        let = properties.filter(F.col("monthly_rental_income_kpy") > 0)
        blocks["occupancy_rate_percent"] = let.agg(F.round(F.avg("occupancy_rate"), 1)).scalar()
    spark = dashboard.sparkSession
    return spark.range(1).select(
        F.lit(month).alias("report_month"),
        json_of(F.lit(month).alias("report_month"), *[c.alias(k) for k, c in blocks.items()]).alias("kpi_json"),
    )


def main_issue() -> Column:
    """The cost category of a project summary that is furthest beyond its budget; empty if none is."""
    costs = {"外注費": "outsourcing_cost_kpy", "材料費": "material_cost_kpy", "労務費": "labor_cost_kpy", "経費": "expense_cost_kpy"}
    excess = {
        name: F.col(cost) - category_budget("contract_amount_kpy", "target_cost_rate", F.lit(name)) for name, cost in costs.items()
    }
    most = F.greatest(*excess.values(), F.lit(0.0))
    issue = F.when(most == 0, "")
    for name, amount in excess.items():
        issue = issue.when(most == amount, f"{name}の予算超過")
    return issue


def report_body(report_type: ColumnLike, document: str = "kpi_json", month: str = "report_month") -> Column:
    """A short Markdown report made of the KPI document itself, for use where no language model writes one."""
    field = lambda path: F.coalesce(F.get_json_object(document, "$." + path), F.lit(""))
    warning = field("warning")
    lines = [
        F.concat(F.lit("# "), as_col(report_type), F.lit(" "), F.col(month), F.lit("\n")),
        F.concat(F.lit("- 売上: "), field("company_summary.total_revenue"), F.lit(" 千円 (達成率 "), field("company_summary.target_achievement_rate"), F.lit("%)")),
        F.concat(F.lit("- 高リスク工事: "), field("cost_risk_summary.high_risk_projects_count"), F.lit(" 件")),
        F.concat(F.lit("- 資金残高: "), field("current_balance"), F.lit(" 千円")),
        F.concat(F.lit("- 資金見通し: "), F.when(warning == "", "赤字の月はありません").otherwise(warning)),
        F.concat(F.lit("- 稼働率: "), field("occupancy_rate_percent"), F.lit("%")),
    ]
    return F.concat_ws("\n", *lines)


# Instruction per report type; an unknown type gets the data without one.
SYSTEM_INSTRUCTION = "あなたは総合建設企業の経営企画を補佐するアシスタントです。次のKPIデータだけを根拠に、経営陣向けの簡潔な報告をMarkdownで作成してください。"
INSTRUCTIONS: Mapping[str, str] = {
    "weekly_summary": "週次の経営サマリーを作成してください。売上と達成率、各事業の状況、資金の見通し、推奨アクションを含めます。",
    "risk_alert": "リスク報告を作成してください。原価超過の工事、資金面の警告、対策案を含め、重要な点を強調します。",
    "area_roi": "エリア別の投資回収を評価する報告を作成してください。施設運営と新規事業の状況を合わせて今後の方向性を述べます。",
}


def report_prompts(
    documents: DataFrame,
    report_type: ColumnLike,
    document: str = "kpi_json",
    system: str = SYSTEM_INSTRUCTION,
    instructions: Mapping[str, str] = INSTRUCTIONS,
) -> DataFrame:
    """Adds the prompt text for a report type next to its KPI document."""
    chain = F
    for kind, text in instructions.items():
        chain = chain.when(as_col(report_type) == kind, F.lit("【指示】\n" + text))
    base = F.concat(F.lit(system + "\n\n【KPIデータ】\n"), F.col(document), F.lit("\n\n"))
    return documents.withColumn("prompt", F.concat(base, chain.otherwise(F.lit(""))))


def delivery_payloads(
    reports: DataFrame,
    to: str,
    channel: str,
    subject: Column,
    body: ColumnLike,
    urgency: str = "normal",
) -> DataFrame:
    """One JSON payload per report, ready for a mail or chat sender."""
    return reports.select(
        json_of(
            F.lit(to).alias("to"),
            subject.alias("subject"),
            as_col(body).alias("body_markdown"),
            F.lit(channel).alias("channel"),
            F.lit(urgency).alias("urgency"),
        ).alias("payload")
    )


def prediction_documents(scored: DataFrame, factors: DataFrame, at: str) -> DataFrame:
    """One JSON document per project: forecast, interval, risk, top factors and when it was made.

    ``factors`` has project_id and ``top_risk_factors``, an array of
    (factor, contribution). ``at`` is a time with its zone offset, as
    2000-01-01T09:00:00+09:00.
    """
    if datetime.fromisoformat(at).tzinfo is None:
        raise ValueError(f"{at} has no zone offset")
    return scored.join(factors, "project_id", "left").select(
        "project_id",
        json_of(
            F.col("project_id"),
            F.col("predicted_cost_rate").alias("predicted_final_cost_rate"),
            F.col("prediction_interval_lower"),
            F.col("prediction_interval_upper"),
            F.col("risk_score"),
            F.col("risk_level"),
            F.col("top_risk_factors"),
            F.lit(at).alias("prediction_timestamp"),
        ).alias("document"),
    )
