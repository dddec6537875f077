"""Writing results."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Excel opens a UTF-8 file correctly only with this mark. Spark writes CSV as a
# folder of part files, so the mark goes in front of the first header name.
BYTE_ORDER_MARK = "﻿"


def write_csv(df: DataFrame, path: str, mode: str = "overwrite", byte_order_mark: bool = False) -> None:
    """CSV part files with a header each, optionally starting with a byte-order mark."""
    if byte_order_mark:
        df = df.withColumnRenamed(df.columns[0], BYTE_ORDER_MARK + df.columns[0])
    df.write.mode(mode).option("header", True).csv(path)


def write_table(
    df: DataFrame,
    path: str,
    partition_by: Sequence[str] = (),
    mode: str = "overwrite",
) -> None:
    """Parquet mart; ``partition_by`` lets later reads prune whole folders.

    With overwrite only the partitions present in ``df`` are replaced, so a
    nightly run keeps the earlier days.
    """
    writer = df.write.mode(mode)
    if partition_by:
        writer = writer.partitionBy(*partition_by).option("partitionOverwriteMode", "dynamic")
    writer.parquet(path)


def write_bucketed(df: DataFrame, table: str, key: str, buckets: int, mode: str = "overwrite") -> None:
    """Catalog table bucketed and sorted by the join key.

    Fact tables that are joined or grouped by the same key night after night
    then need no shuffle for it.
    """
    df.write.mode(mode).bucketBy(buckets, key).sortBy(key).saveAsTable(table)


def to_payload(df: DataFrame, cols: Sequence[str] | None = None, name: str = "payload") -> DataFrame:
    """One JSON object per row; NULL fields are kept."""
    return df.select(json_of(*[F.col(c) for c in (cols or df.columns)]).alias(name))


def json_of(*cols: Column) -> Column:
    return F.to_json(F.struct(*cols), {"ignoreNullFields": "false"})


def write_json(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).option("ignoreNullFields", False).json(path)
