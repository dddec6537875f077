"""A training corpus from raw documents: stages that each write their rows for the next.

Every stage reads all its predecessor kept, and its decisions take effect: the
rows it rejects and the lines it cuts are gone for the stages after it. All
stages but the last return the columns of ``documents``.

Null or empty texts are documents like others: the classifier finds no fault
in them, they have no lines, shingles or benchmark items, and the mix takes no
words of them. Rows without doc_id are never near duplicates or contaminated.
Rows that repeat a doc_id are one document from the near-duplicate stage on.
Columns beyond those of ``documents`` are carried along; the last stage
replaces those named like its own. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from girder.llm import decontaminate, jaccard, lines, mixture, quality
from girder.llm.scratch import rows_of_ids
from girder.session import scratch_path, settle


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier finds neither junk nor abusive."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic")
    others = [c for c in docs.columns if c not in ("doc_id", "text")]
    packed = [F.struct(*others).alias("others")] if others else []
    kept = quality.classify(docs.select("doc_id", "text", *packed), labels).where("keep")
    return kept.select(*[F.col(c) if c in ("doc_id", "text") else F.col("others")[c].alias(c) for c in docs.columns])


def cut_shared_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that ten documents or more share are cut from all of them."""
    others = [c for c in docs.columns if c not in ("doc_id", "text", "n_chars")]
    kept = lines.dedup_lines(docs.select("doc_id", "text", F.struct(*others).alias("others")), min_docs=10, min_chars=1)
    columns = {c: F.col("others")[c].alias(c) for c in others} | {"doc_id": F.col("doc_id"), "text": F.col("text")}
    columns["n_chars"] = F.length("text").cast("long").alias("n_chars")
    return kept.select(*[columns[c] for c in docs.columns])


def keep_one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The smallest doc_id of every group of documents with 80 % of their 5-word shingles in common."""
    groups = settle(jaccard.similar_components(docs.select("doc_id", "text"), size=5, percent=80))
    gone = settle(groups.where("doc_id <> component_id").select("doc_id").distinct())
    kept = rows_of_ids(docs, gone, keep=False)
    repeated = settle(groups.where("doc_id = component_id").groupBy("doc_id").count().where("count > 1").select("doc_id"))
    if repeated.isEmpty():
        return kept
    return rows_of_ids(kept, repeated, keep=False).unionByName(rows_of_ids(kept, repeated).dropDuplicates(["doc_id"]))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix to target weights takes, with their number of copies."""
    return mixture.mix_sources(docs).where("copies > 0")


STAGES = [
    ("quality classifier", keep_quality),
    ("line dedup", cut_shared_lines),
    ("n-gram Jaccard join", keep_one_of_near_copies),
    ("benchmark decontamination", drop_contaminated),
    ("source mixture", mix),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to ``documents``, each written below the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        path = scratch_path(spark, f"corpus-stage-{i}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs


# The first stage is a fitted model, which SQL cannot express.
ORACLE_SQL = None
