"""Reading the seven base tables and exposing views by name."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from girder import schemas


def read_csv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """CSV with a header line; a line that does not fit the schema fails the read, it is never lost as NULLs.

    Spark drops a UTF-8 byte-order mark by itself.
    """
    return spark.read.option("header", True).option("mode", "FAILFAST").schema(schema).csv(path)


def read_parquet(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    reader = spark.read if schema is None else spark.read.schema(schema)
    return reader.parquet(path)


def load_tables(
    spark: SparkSession,
    folder: str,
    names: Iterable[str] = tuple(schemas.TABLES),
    fmt: str = "parquet",
) -> dict[str, DataFrame]:
    """The base tables under ``folder``, one ``<name>.<fmt>`` each, schemas fixed."""
    read = read_csv if fmt == "csv" else read_parquet
    return {n: read(spark, f"{folder}/{n}.{fmt}", schemas.TABLES[n]) for n in names}


def table_profile(tables: Mapping[str, DataFrame]) -> DataFrame:
    """Row and column count of every table."""
    parts = [
        df.agg(F.count("*").alias("row_count")).select(
            F.lit(name).alias("table_name"),
            "row_count",
            F.lit(len(df.columns)).alias("column_count"),
        )
        for name, df in tables.items()
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def register_views(views: Mapping[str, DataFrame | Callable[[], DataFrame]], prefix: str = "vw_") -> list[str]:
    """Make each plan queryable as ``<prefix><name>`` from SQL."""
    names = []
    for name, view in views.items():
        df = view() if callable(view) else view
        df.createOrReplaceTempView(prefix + name)
        names.append(prefix + name)
    return names
