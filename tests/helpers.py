from datetime import date

PROJECT = "project_id string, project_name string, division string, client_type string, contract_amount_kpy long, start_date date, end_date date, target_cost_rate double, progress_rate double, status string, pm_name string"
COST = "project_id string, category string, amount_kpy long, status string, accrual_month string, payment_due_month string"
CASH = "project_id string, milestone string, expected_amount_kpy long, actual_amount_kpy long, deposit_month string, status string"


def project(pid, contract=1000, start=date(2024, 1, 1), end=date(2024, 12, 31), target=80.0, progress=50.0, status="進行中", name="三島市新築工事", division="建築", client="民間", pm="A"):
    return (pid, name, division, client, contract, start, end, target, progress, status, pm)


def cost(pid, amount, category="外注費", status="確定請求", month="2024-03", due="2024-04"):
    return (pid, category, amount, status, month, due)


def cash(pid, amount, month, actual=None, status="予定", milestone="前払金"):
    return (pid, milestone, amount, actual, month, status)


def projects(spark, *rows):
    return spark.createDataFrame(list(rows), PROJECT)


def costs(spark, *rows):
    return spark.createDataFrame(list(rows), COST)


def receipts(spark, *rows):
    return spark.createDataFrame(list(rows), CASH)


def by(df, key):
    return {r[key]: r for r in df.collect()}
