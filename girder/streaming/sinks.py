"""Running a stream over what has arrived and reading its result table.

A micro-batch may run again after a failure. The append sink leaves no trace of
a repeated batch, and the change table writes each batch to a folder of its own
number, so a repeat replaces itself. A stream that runs for long merges into a
table of current rows instead, see :mod:`girder.streaming.snapshots`.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from girder.session import SETTINGS

STATE_STORE = "spark.sql.streaming.stateStore.providerClass"


@contextmanager
def state_in_rocksdb(spark: SparkSession) -> Iterator[None]:
    """RocksDB holds the state of streams started inside, whatever the session says.

    A stream with several kinds of state per key needs it; the store that Spark
    takes by itself keeps one kind.
    """
    before = spark.conf.get(STATE_STORE, None)
    spark.conf.set(STATE_STORE, SETTINGS[STATE_STORE])
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(STATE_STORE)
        else:
            spark.conf.set(STATE_STORE, before)


def run_append(stream: DataFrame, path: str, checkpoint: str) -> None:
    """Everything available appended to a parquet table."""
    (
        stream.writeStream.format("parquet")
        .outputMode("append")
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start(path)
        .awaitTermination()
    )


def run_changes(
    stream: DataFrame,
    path: str,
    checkpoint: str,
    shape: Callable[[DataFrame], DataFrame] = lambda batch: batch,
) -> None:
    """The rows changed by each batch, shaped by ``shape``, into a change table."""

    def write(batch: DataFrame, batch_id: int) -> None:
        shape(batch).write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    (
        stream.writeStream.outputMode("update")
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .foreachBatch(write)
        .start()
        .awaitTermination()
    )


def latest(changes: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Current row of each key in a change table."""
    values = [c for c in changes.columns if c not in keys and c != "batch"]
    newest = F.max_by(F.struct(*values), "batch").alias("v")
    return changes.groupBy(*keys).agg(newest).select(*keys, "v.*")
