import datetime as dt
import json

from helpers import cash, cost, costs, receipts

from girder.plans import cash as plans
from girder.plans import documents


def frame(spark):
    r = receipts(spark, cash("a", 100, "2024-01"), cash("a", 100, "2024-02"), cash("a", 10, "2024-04"))
    c = costs(spark, cost("a", 30, due="2024-01"), cost("a", 30, "経費", due="2024-01"), cost("a", 60200, due="2024-03"))
    return plans.monthly_cash(r, c)


def test_months_of_either_side_and_concentration(spark):
    rows = frame(spark).orderBy("month").collect()
    assert [(r.inflow, r.outflow, r.hhi) for r in rows] == [(100, 60, 0.5), (100, 0, None), (0, 60200, 1.0), (10, 0, None)]
    assert [r.cumulative_cashflow for r in rows] == [40, 140, -60060, -60050]


def test_features(spark):
    rows = plans.cash_features(frame(spark)).orderBy("month").collect()
    assert [r.hhi for r in rows] == [0.5, 0.0, 1.0, 0.0]
    assert [r.mom_change for r in rows] == [0, 60, -60300, 60210]
    assert rows[1].inflow_outflow_ratio == 100.0
    assert rows[1].rolling_3m_avg == 70.0 and rows[1].diff_from_3m_avg == 30.0
    assert [r.month.month for r in plans.danger_months(frame(spark)).orderBy("month").collect()] == [3, 4]


def test_a_month_can_raise_both_alerts(spark):
    df = spark.createDataFrame(
        [(dt.date(2024, 1, 1), 1, 2, -1, -60000, -0.61239, True), (dt.date(2024, 2, 1), 1, 2, -1, -50000, -0.4, False)],
        "month date, inflow long, outflow long, net_cashflow long, cumulative_cashflow long, anomaly_score double, is_anomaly boolean",
    )
    rows = plans.cash_alerts(df).collect()
    assert [r.level for r in rows] == ["WARNING", "CRITICAL"]
    assert json.loads(rows[0].details) == {"inflow": 1, "outflow": 2, "anomaly_score": -0.612}
    assert "Net: -1千円" in rows[0].message and "-50,000千円" in rows[1].message


def test_unknown_report_type_gets_the_data_only(spark):
    df = spark.createDataFrame([("risk_alert", "{}"), ("x", "{}")], "report_type string, kpi_json string")
    rows = {r.report_type: r.prompt for r in documents.report_prompts(df, "report_type").collect()}
    assert documents.INSTRUCTIONS["risk_alert"] in rows["risk_alert"]
    assert rows["x"].endswith("{}\n\n")
