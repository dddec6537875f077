"""Intermediate tables of one operator run, in the shared folder, deleted when the run ends."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from girder.session import scratch_path

# Ids up to this number (8 bytes each) are broadcast to pick rows, more are joined by shuffle.
BROADCAST_IDS = 500_000


@contextmanager
def scratch(spark: SparkSession) -> Iterator[Callable[[DataFrame], DataFrame]]:
    """A function that writes a frame as a table and rereads it.

    Frames that leave the block must not depend on such tables: ``settle`` them.
    """
    root = scratch_path(spark, "operator")
    made = 0

    def store(df: DataFrame) -> DataFrame:
        nonlocal made
        made += 1
        path = f"{root}/{made}"
        df.write.parquet(path)
        return spark.read.schema(df.schema).parquet(path)

    try:
        yield store
    finally:
        path = spark._jvm.org.apache.hadoop.fs.Path(root)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def rows_of_ids(docs: DataFrame, ids: DataFrame, keep: bool = True) -> DataFrame:
    """Rows of ``docs`` whose values are in ``ids`` (or are not): distinct rows, doc_id as a rule, that have been written already."""
    small = ids.count() <= BROADCAST_IDS
    return docs.join(F.broadcast(ids) if small else ids, ids.columns, "left_semi" if keep else "left_anti")
