"""Session settings and the shared folder for checkpoints and intermediate tables."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Adaptive execution does the size-dependent work at run time: it turns a join
# side that proved small into a broadcast, splits skewed join partitions and
# merges small shuffle partitions.
SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # Checkpoints of results no longer referenced are deleted.
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
    # Running totals keep a row of state per key for good; RocksDB holds it off the heap.
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    # Spares a stack inspection per column expression while a plan is built.
    "spark.python.sql.dataFrameDebugging.enabled": "false",
}


def build_session(
    app: str = "girder",
    master: str | None = None,
    shuffle_partitions: int | None = None,
    **conf: str,
) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {**SETTINGS, **conf}
    if shuffle_partitions:
        settings["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach, as named by ``spark.checkpoint.dir``.

    A single-machine session without the setting gets a temporary folder. On a
    cluster that folder would not survive the loss of an executor, so the
    setting is required there.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    context = spark.sparkContext
    if not context.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder shared by all executors")
    current = context.getCheckpointDir()
    if current:
        return current
    folder = tempfile.mkdtemp(prefix="girder-")
    context.setCheckpointDir(folder)
    return context.getCheckpointDir()


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    folder = shared_dir(spark)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(folder)


def settle(df: DataFrame) -> DataFrame:
    """The rows written once to the shared checkpoint folder, for a small result read several times."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint()


ROWS_A_TASK = 1 << 15


def packed(df: DataFrame, rows: int | None = None) -> DataFrame:
    """Settled rows in as many partitions as their number needs, for jobs that read them very often."""
    rows = df.count() if rows is None else rows
    return df.coalesce(max(1, -(-rows // ROWS_A_TASK)))


def scratch_path(spark: SparkSession, name: str) -> str:
    """New path for one run's intermediate table below the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
