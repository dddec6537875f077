"""The registered queries: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from girder.llm import (
    centroids,
    decontaminate,
    fuzzy,
    jaccard,
    language,
    licenses,
    lines,
    mixture,
    quality,
    ranking,
    repeats,
    secrets,
    toxicity,
)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


def table(spark: SparkSession, folder: str, name: str = "documents") -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


@query
def op1_secret_scan(spark: SparkSession, folder: str) -> DataFrame:
    """Secrets in every document, and the weak candidates that complete each other."""
    found = secrets.scan(table(spark, folder).select("doc_id", "text"))
    counts = [secrets.count_kind(F.col("base"), k).alias(f"n_{k}") for k in ("assign", "access", "hex")]
    digest = F.sha2(secrets.listing(F.col("base")), 256)
    return found.select("doc_id", *counts, digest.alias("base_sha256"), secrets.listing(F.col("spans")).alias("spans"))


@query
def op2_source_mixture(spark: SparkSession, folder: str) -> DataFrame:
    """Words that a mix of the sources to target weights takes of every document."""
    docs = table(spark, folder).select("doc_id", "text", "source")
    return mixture.mix_sources(docs).select("doc_id", "size", "source_size", "target", "taken", "copies")


@query
def op3_language_profiles(spark: SparkSession, folder: str) -> DataFrame:
    """Language of every document; two of three documents with a language are learned from."""
    docs = table(spark, folder).select("doc_id", "text", "lang")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False))
    profiles = language.learn_profiles(docs.where(~held_out))
    return language.identify(docs.select("doc_id", held_out.alias("held_out"), "text"), profiles).drop("text")


@query
def op9_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """Lines of every document before, and its text after, removing lines found in ten documents or more."""
    kept = lines.dedup_lines(table(spark, folder).select("doc_id", "text"), min_docs=10, min_chars=1)
    digest = F.sha2(F.coalesce("text", F.lit("")), 256)
    return kept.select("doc_id", "n_lines", "n_dropped", digest.alias("kept_sha256"))


@query
def op6_piecewise_fingerprints(spark: SparkSession, folder: str) -> DataFrame:
    """Fingerprint of every document and of its edited text, and their likeness."""
    return fuzzy.compare_neighbours(table(spark, folder).select("doc_id", "text"))


@query
def op5_ngram_jaccard(spark: SparkSession, folder: str) -> DataFrame:
    """Component of every document under links of 85 % Jaccard similarity on 4-word shingles."""
    return jaccard.similar_components(table(spark, folder).select("doc_id", "text"), size=4, percent=85)


@query
def op8_suffix_array_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """Bytes of every document left after removing 50-byte strings that start in a smaller doc_id too."""
    kept = repeats.drop_repeats(table(spark, folder).select("doc_id", "text"), length=50)
    size = F.octet_length(F.coalesce("text", F.lit(""))).cast("long")
    return kept.select("doc_id", size.alias("n_bytes"), "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


@query
def op4_quality_classifier(spark: SparkSession, folder: str) -> DataFrame:
    """Chance of junk and of abuse, quality, and whether to keep every document."""
    docs = table(spark, folder).select("doc_id", "text")
    return quality.classify(docs, table(spark, folder, "labels").select("doc_id", "toxic")).drop("text")


@query
def op10_benchmark_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    """Documents that hold four fifths or more of a benchmark item's 5-word shingles."""
    docs = table(spark, folder).select("doc_id", "text")
    return decontaminate.contained(docs, table(spark, folder, "benchmark").select("item_id", "text"))


@query
def op7_license_scan(spark: SparkSession, folder: str) -> DataFrame:
    """License texts and notices found in every document."""
    found = licenses.scan(table(spark, folder).select("doc_id", "text"))
    return found.select("doc_id", "license", "template_size", "shared", "containment")


@query
def op11_centroid_clusters(spark: SparkSession, folder: str) -> DataFrame:
    """Cluster of every vector after five rounds from 40 first centroids."""
    found = centroids.cluster(table(spark, folder, "embeddings").select("vec_id", "embedding"), k=40, size=64, rounds=5, seed=2)
    listed = F.array_join(F.transform("centroid", lambda x: x.cast("string")), ",")
    return found.select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", F.sha2(listed, 256).alias("centroid_sha256"))


@query
def op12_lexical_search(spark: SparkSession, folder: str) -> DataFrame:
    """The ten best documents of every benchmark item."""
    docs = table(spark, folder).select("doc_id", "text")
    return ranking.search(docs, table(spark, folder, "benchmark").select("item_id", "text"), top=10)


@query
def op13_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    """Toxicity of every document; four of five labelled documents are learned from."""
    docs = table(spark, folder).select("doc_id", "text")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))
    labels = table(spark, folder, "labels").select("doc_id", "toxic")
    return toxicity.score(docs, labels, held_out).select("doc_id", held_out.alias("held_out"), "score", "predicted")
