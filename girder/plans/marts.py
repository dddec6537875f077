"""Views kept up to date by signed changes in place of a recomputation.

A change is a row of a base table with a ``sign``: 1 where it appears, -1 where
it goes; an update is one of each. What a view needs of the fact tables are
sums, so a batch of changes becomes a few signed sums per month or project,
which are merged into a dated table of sums. The view is then computed from
that table alone: it equals the view over the base tables after the same
changes, in any order and in any batches, and a batch that runs again is not
added twice. Work follows the changes and the buckets they touch, not history.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from girder.plans.views import TERMS, CostTerms, cashflow_of, cost_summary_of, monthly_cash_sums, project_costs
from girder.streaming.snapshots import SnapshotTable


def changes(added: DataFrame | None = None, removed: DataFrame | None = None) -> DataFrame:
    """Rows that appear and rows that go as one frame of changes."""
    parts = [df.withColumn("sign", F.lit(sign)) for df, sign in ((added, 1), (removed, -1)) if df is not None]
    if not parts:
        raise ValueError("no rows that appear and none that go")
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])


class CashMart:
    """Receipts and payments per month."""

    def __init__(self, spark: SparkSession, path: str, terms: CostTerms = TERMS, buckets: int = 4) -> None:
        self.terms = terms
        self.table = SnapshotTable(spark, path, ["month_str"], buckets)

    def apply(self, cash_in: DataFrame, costs: DataFrame, batch: int) -> None:
        """Changes of receipts and of costs, one batch."""
        self.table.merge(monthly_cash_sums(cash_in, costs, self.terms, sign=F.col("sign")), batch, count="entries")

    def cashflow(self) -> DataFrame:
        return cashflow_of(self.table.read().drop("entries"))


class CostMart:
    """Cost totals per project."""

    def __init__(self, spark: SparkSession, path: str, terms: CostTerms = TERMS, buckets: int = 64) -> None:
        self.terms = terms
        self.table = SnapshotTable(spark, path, ["project_id"], buckets)

    def apply(self, costs: DataFrame, batch: int) -> None:
        self.table.merge(project_costs(costs, self.terms, sign=F.col("sign")), batch, count="record_count")

    def summary(self, projects: DataFrame) -> DataFrame:
        """The cost summary of the project table as it is now; only the costs come from the mart."""
        return cost_summary_of(projects, self.table.read())
