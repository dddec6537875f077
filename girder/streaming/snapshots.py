"""A table of current rows by key that streams merge into and readers see one version of.

Rows lie in buckets by a hash of their key. A merge reads the buckets that a
batch touches, writes them anew into a folder of its own, and publishes a
manifest: the number of the version, the batch it came from and the folder of
every bucket. Nothing that a manifest names is ever changed, and a manifest
appears as a whole by a rename, so a reader that has taken a version keeps
seeing it while merges go on. A batch that runs again after a failure finds its
own number in the newest manifest and does nothing.

One stream writes a table, with one checkpoint: numbers of batches only grow,
so a stream that starts anew needs a new table. The bytes rewritten per batch are those of the
touched buckets; choose ``buckets`` so that one is a few hundred megabytes.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


@dataclass(frozen=True)
class Version:
    number: int
    batch: int
    schema: str
    folders: dict[int, str] = field(default_factory=dict)


class SnapshotTable:
    def __init__(self, spark: SparkSession, path: str, keys: Sequence[str], buckets: int = 64) -> None:
        self.spark, self.path, self.keys, self.buckets = spark, path.rstrip("/"), list(keys), buckets
        root = spark._jvm.org.apache.hadoop.fs.Path(self.path)
        self._files = root.getFileSystem(spark._jsc.hadoopConfiguration())

    def _place(self, *names: object):
        return self.spark._jvm.org.apache.hadoop.fs.Path("/".join([self.path, *map(str, names)]))

    def versions(self) -> list[int]:
        """Numbers of the published versions, the newest last."""
        folder = self._place("_versions")
        if not self._files.exists(folder):
            return []
        names = [s.getPath().getName() for s in self._files.listStatus(folder)]
        return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json") and not n.startswith("."))

    def version(self, number: int | None = None) -> Version | None:
        """A published version, the newest by default."""
        if number is None:
            number = next(reversed(self.versions()), None)
        if number is None:
            return None
        text = self.spark.read.text(self._place("_versions", f"{number:012d}.json").toString(), wholetext=True).first()[0]
        found = json.loads(text)
        return Version(found["number"], found["batch"], found["schema"], {int(b): f for b, f in found["folders"].items()})

    def _publish(self, version: Version) -> None:
        """The manifest written beside its place and renamed into it; an existing one is never replaced."""
        name = f"{version.number:012d}.json"
        draft, final = self._place("_versions", f".{name}.draft"), self._place("_versions", name)
        out = self._files.create(draft, True)
        try:
            out.write(bytearray(json.dumps(version.__dict__).encode()))
        finally:
            out.close()
        if self._files.exists(final) or not self._files.rename(draft, final):
            raise RuntimeError(f"version {version.number} of {self.path} was published by another writer")

    def read(self, number: int | None = None) -> DataFrame:
        """The rows of one version; an empty frame without columns if there is none yet."""
        version = self.version(number)
        if version is None:
            return self.spark.createDataFrame([], T.StructType())
        schema = T.StructType.fromJson(json.loads(version.schema))
        folders = sorted(set(version.folders.values()))
        if not folders:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*[f"{self.path}/{f}" for f in folders])

    def merge(self, rows: DataFrame, batch: int, newest: Column | None = None, count: str | None = None) -> Version:
        """Publishes the table with ``rows`` in the place of those of the same key, or added to them.

        With ``count`` all values are sums of signed changes: those of the batch
        are added to the table's, and a key whose ``count`` column comes to 0 goes.
        ``newest`` is the column that decides between rows of one key, of the
        batch or of the table; without it a row of the batch replaces the one in
        the table, and the batch holds a key once.
        """
        before = self.version()
        if before is not None and batch <= before.batch:
            return before  # the batch has been merged
        schema = rows.schema if before is None else T.StructType.fromJson(json.loads(before.schema))
        number = 1 if before is None else before.number + 1
        bucket = F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")
        marked = rows.select(*schema.names).withColumn("_bucket", bucket).withColumn("_new", F.lit(1))
        touched = sorted(r[0] for r in marked.select("_bucket").distinct().collect())
        held = [before.folders[b] for b in touched if before is not None and b in before.folders]
        if held:
            old = self.spark.read.schema(schema).parquet(*[f"{self.path}/{f}" for f in held])
            marked = marked.unionByName(old.withColumn("_bucket", bucket).withColumn("_new", F.lit(0)))
        values = [c for c in schema.names if c not in self.keys]
        grouped = marked.groupBy("_bucket", *self.keys)
        if count:
            kinds = {f.name: f.dataType for f in schema}
            merged = grouped.agg(*[F.sum(c).cast(kinds[c]).alias(c) for c in values]).filter(F.col(count) != 0).select("_bucket", *schema.names)
        else:
            order = F.struct(*([] if newest is None else [newest]), F.col("_new"))
            chosen = F.max_by(F.struct(F.lit(1).alias("_row"), *values), order).alias("v")
            merged = grouped.agg(chosen).select("_bucket", *[F.col(c) if c in self.keys else F.col(f"v.{c}") for c in schema.names])
        folders = dict(before.folders) if before is not None else {}
        if touched:
            # A folder of this attempt alone: what an attempt that failed left behind is in nobody's way.
            own = f"data/v{number:012d}-{self.spark._jvm.java.util.UUID.randomUUID().toString()}"
            merged.repartition("_bucket").write.partitionBy("_bucket").parquet(f"{self.path}/{own}")
            # A bucket of which nothing is left has no folder.
            left = {b for b in touched if self._files.exists(self._place(own, f"_bucket={b}"))}
            folders = {b: f for b, f in folders.items() if b not in touched} | {b: f"{own}/_bucket={b}" for b in left}
        version = Version(number, batch, json.dumps(schema.jsonValue()), folders)
        self._publish(version)
        return version

    def expire(self, keep: int = 2) -> None:
        """Deletes all versions but the newest ``keep`` and the folders that only they name.

        Readers of an expired version fail; keep as many as the longest read takes.
        """
        numbers = self.versions()
        kept = [self.version(n) for n in numbers[-keep:]]
        if not kept:
            return
        used = {f.split("/")[1] for v in kept for f in v.folders.values()}
        newest = kept[-1].number
        for n in numbers[:-keep]:
            self._files.delete(self._place("_versions", f"{n:012d}.json"), False)
        data = self._place("data")
        for status in self._files.listStatus(data) if self._files.exists(data) else []:
            name = status.getPath().getName()
            # A folder of a later number belongs to a merge that is under way.
            if name not in used and int(name[1:13]) <= newest:
                self._files.delete(status.getPath(), True)


def run_merges(
    stream: DataFrame,
    table: SnapshotTable,
    checkpoint: str,
    shape: Callable[[DataFrame], DataFrame] = lambda batch: batch,
    keep: int = 0,
) -> None:
    """The rows changed by each batch, shaped by ``shape``, merged into the table; old versions expire beyond ``keep``."""

    def write(batch: DataFrame, batch_id: int) -> None:
        # The batch is read twice, for its buckets and for the merge.
        rows = shape(batch).persist()
        try:
            table.merge(rows, batch_id)
        finally:
            rows.unpersist()
        if keep:
            table.expire(keep)

    (
        stream.writeStream.outputMode("update")
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .foreachBatch(write)
        .start()
        .awaitTermination()
    )
