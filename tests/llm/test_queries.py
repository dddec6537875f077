"""Queries against their SQL on the small tables, and every operator on hard, repeated and empty rows."""

import math
import re
import subprocess
import sys
from pathlib import Path

import duckdb
import numpy as np
import pytest
from cases import DOCS, docs_frame, hard_rows
from pyspark.sql import functions as F

import corpus_pipeline
from girder.llm import (
    ORACLES,
    QUERIES,
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

TABLES = "documents benchmark labels embeddings".split()


def rounded(row):
    return tuple(round(x, 9) if isinstance(x, float) else x for x in row)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_its_sql(spark, sf, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    got = QUERIES[name](spark, sf)
    columns = sorted(got.columns)
    want = con.sql(ORACLES[name])
    assert sorted(want.columns) == columns
    mine = sorted(rounded(r) for r in got.select(*columns).collect())
    theirs = sorted(rounded(r) for r in want.project(", ".join(columns)).fetchall())
    assert mine == theirs


def test_every_number_has_one_query():
    numbers = sorted(int(n[2:].split("_")[0]) for n in QUERIES)
    assert numbers == list(range(1, 14))


ITEMS = [(1, "tok10 tok11 tok12 tok13 tok14 tok15 tok16"), (1, "tok10 tok11 tok12 tok13 tok14 tok15 tok16"), (2, None), (3, ""), (None, "x"), (4, "short text")]

OPERATORS = {
    "secrets": lambda docs, items, labels: secrets.scan(docs),
    "mixture": lambda docs, items, labels: mixture.mix_sources(docs),
    "language": lambda docs, items, labels: language.identify(docs, language.learn_profiles(docs)),
    "quality": lambda docs, items, labels: quality.classify(docs, labels),
    "jaccard": lambda docs, items, labels: jaccard.similar_components(docs),
    "fuzzy": lambda docs, items, labels: fuzzy.compare_neighbours(docs),
    "licenses": lambda docs, items, labels: licenses.scan(docs),
    "repeats": lambda docs, items, labels: repeats.drop_repeats(docs),
    "lines": lambda docs, items, labels: lines.dedup_lines(docs, min_docs=2),
    "decontaminate": lambda docs, items, labels: decontaminate.contained(docs, items),
    "decontaminate_rows": lambda docs, items, labels: decontaminate.clean(docs, items),
    "ranking": lambda docs, items, labels: ranking.search(docs, items),
    "toxicity": lambda docs, items, labels: toxicity.score(docs, labels, F.lit(False)),
}
ROW_FOR_ROW = {"secrets", "mixture", "language", "quality", "jaccard", "fuzzy", "repeats", "lines", "toxicity"}


def small(spark, rows):
    docs = docs_frame(spark, rows)
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    labels = spark.createDataFrame([(1, 0), (3, 1), (3, 1), (None, 1), (4, None), (999, 1)], "doc_id long, toxic int")
    return docs, items, labels


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_hard_rows_and_clashing_columns(spark, name):
    """Nulls, empty and long texts, ties, repeats; extra columns named like those an operator adds or uses inside."""
    docs, items, labels = small(spark, hard_rows())
    clash = ("size", "copies", "n_lines", "score", "keep", "ranges", "token", "component", "fingerprint", "row_key", "anchors")
    wide = docs.select("*", *[F.lit(-5).alias(c) for c in clash])
    rows = OPERATORS[name](wide, items, labels).collect()
    if name in ROW_FOR_ROW:
        ids = sorted((r["doc_id"] for r in rows), key=lambda x: (x is None, x))
        assert ids == [1, 2, 2, 3, 4, 5, 6, 7, 8, 9, 10, None]
    twice = [r for r in rows if r["doc_id"] == 2]
    if name not in ("mixture", "fuzzy", "ranking"):  # a mix may take one of two equal rows, what follows them differs, and so do ranks
        assert len(twice) < 2 or twice[0] == twice[1]


def names_in(module):
    """Every name that stands in quotes in an operator's code: what it adds, or uses inside."""
    source = Path(module.__file__).read_text()
    return sorted({n.lower() for n in re.findall(r"[\"']([a-z_][a-z_0-9]*)[\"']", source, re.I)} - set("doc_id text lang source n_chars".split()))


CARRIES = {
    "secrets": secrets, "mixture": mixture, "language": language, "quality": quality, "repeats": repeats, "lines": lines, "toxicity": toxicity,
}
ADDED = {
    "secrets": {"base", "spans"}, "mixture": {"size", "source_size", "target", "copies", "taken"}, "language": {"lang_pred", "score"},
    "quality": {"p_junk", "p_abuse", "quality", "keep"}, "repeats": {"n_removed", "n_spans", "kept"}, "lines": {"n_lines", "n_dropped"},
    "toxicity": {"evidence", "score", "predicted"},
}


@pytest.mark.parametrize("name", ["mixture", "repeats", "lines", "quality", "toxicity"])
def test_own_columns_come_back(spark, name):
    """Columns named like anything in the operator's code keep their values, but for those it says it adds."""
    docs, items, labels = small(spark, hard_rows())
    inner = [n for n in names_in(CARRIES[name]) if n not in ADDED[name] and not n.startswith("_")]
    assert len(inner) > 5
    wide = docs.select("*", *[F.lit(i).alias(n) for i, n in enumerate(inner)])
    rows = OPERATORS[name](wide, items, labels).collect()
    assert len(rows) == len(hard_rows())
    assert {tuple(r[n] for n in inner) for r in rows} == {tuple(range(len(inner)))}


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_empty_table(spark, name):
    docs, items, labels = small(spark, hard_rows())
    assert OPERATORS[name](docs.where("false"), items, labels).collect() == []


@pytest.mark.parametrize("stage", [s for s, _ in corpus_pipeline.STAGES])
def test_stage_on_hard_and_empty_rows(spark, tmp_path, stage):
    docs, items, labels = small(spark, hard_rows())
    items.write.parquet(str(tmp_path / "benchmark.parquet"))
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    f = dict(corpus_pipeline.STAGES)[stage]
    wide = docs.withColumn("n_lines", F.lit("mine")).withColumn("_extra", F.lit(1))
    kept = f(spark, wide, str(tmp_path))
    if stage != corpus_pipeline.STAGES[-1][0]:
        assert kept.columns == wide.columns
        assert {r["n_lines"] for r in kept.collect()} == {"mine"}
    assert f(spark, docs.where("false"), str(tmp_path)).collect() == []


def test_no_items_match_nothing(spark):
    docs, items, labels = small(spark, hard_rows())
    assert decontaminate.contained(docs, items.where("false")).collect() == []
    assert {(r["doc_id"], r["item_id"]) for r in decontaminate.contained(docs, items).collect()} == {
        (1, 1), (2, 1), (3, 1), (8, 4)
    }


def test_mixture_reaches_targets(spark, sf):
    rows = QUERIES["op2_source_mixture"](spark, sf).collect()
    source = {}
    for r in rows:
        assert 0 <= r["taken"] <= 2 * r["size"]
    docs = {r["doc_id"]: r["source"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    largest = {}
    for r in rows:
        s = docs[r["doc_id"]]
        taken, target = source.get(s, (0, r["target"]))
        source[s] = (taken + r["taken"], target)
        largest[s] = max(largest.get(s, 0), r["size"])
    assert all(abs(taken - target) <= largest[s] / 2 for s, (taken, target) in source.items())
    assert math.isclose(sum(t for _, t in source.values()), 1.5 * sum(r["size"] for r in rows))


@pytest.mark.parametrize("partitions", [1, 5])
def test_mixture_of_repeated_rows(spark, partitions):
    """Many rows of one id and one text at the cut: half a document off at most, which of them is all the same."""
    text = " ".join(["w"] * 100)
    rows = [(7, text, "en", "a", 1)] * 300 + [(i, text, "en", "b", 1) for i in range(300)] + [(7, text + f" x{i}", "en", "c", 1) for i in range(50)]
    docs = docs_frame(spark, rows).repartition(partitions)
    got = mixture.mix_sources(docs).groupBy("source").agg(F.sum("taken").alias("taken"), F.first("target").alias("target"), F.count("*").alias("n")).collect()
    assert {r["source"]: r["n"] for r in got} == {"a": 300, "b": 300, "c": 50}
    for r in got:
        assert abs(r["taken"] - r["target"]) <= 51


def test_repeats_of_one_id_with_two_texts(spark):
    """A row loses what stands in its own text only, whole or in part."""
    shared, own = "s" * 20 + "h" * 20 + "a" * 30, "o" * 30 + "w" * 40
    rows = [(1, shared), (2, shared), (2, own), (2, "x" + shared + "y"), (3, own + own)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r["doc_id"], r["text"], r["n_removed"]) for r in repeats.drop_repeats(docs).collect())
    assert got == sorted([(1, shared, 0), (2, shared, 70), (2, own, 0), (2, "x" + shared + "y", 70), (3, own + own, 140)])


def test_short_words_of_a_lexicon(spark):
    none = np.zeros(0, np.uint64)
    read = quality.Reader().read([b"you big OX you", b"big oxen", b"scoundrels all", b"all fine"])
    votes = quality.abuse_votes(read, np.sort(quality._begin_hashes(("ox", "scoundrel"))), none, none)
    assert votes[:, 0].tolist() == [quality.BAD, quality.GOOD, quality.BAD, quality.GOOD]
    docs = docs_frame(spark, [(1, "you big ox you", "en", "s", 1), (2, "fine", "en", "s", 1)])
    wide = docs.withColumn("toxic", F.lit("mine"))
    labels = spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, toxic int")
    assert {r["toxic"] for r in quality.classify(wide, labels).collect()} == {"mine"}


def test_workers_need_no_copy_of_the_package(tmp_path, sf):
    """Every query runs in a folder where the package cannot be imported by the workers."""
    root = Path(__file__).resolve().parents[2]
    code = f"""
import sys
sys.path.insert(0, {str(root)!r})
import corpus_pipeline
from girder.llm import QUERIES
from girder.session import build_session
spark = build_session(master="local[2]", shuffle_partitions=2, **{{"spark.ui.enabled": "false", "spark.checkpoint.dir": {str(tmp_path / 'c')!r}}})
for name, query in sorted(QUERIES.items()):
    print(name, query(spark, {sf!r}).count() >= 0)
"""
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, timeout=900)
    assert done.stdout.split().count("True") == len(QUERIES), done.stderr[-3000:]


def test_mixture_does_not_depend_on_partitions(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    one = {(r["doc_id"], r["copies"]) for r in mixture.mix_sources(docs).collect()}
    two = {(r["doc_id"], r["copies"]) for r in mixture.mix_sources(docs.repartition(7)).collect()}
    assert one == two


def test_schemas_are_the_contracts(spark, sf):
    want = {
        "op1_secret_scan": {"doc_id": "bigint", "n_assign": "bigint", "n_access": "bigint", "n_hex": "bigint", "base_sha256": "string", "spans": "string"},
        "op2_source_mixture": {"doc_id": "bigint", "size": "bigint", "source_size": "bigint", "target": "double", "taken": "bigint"},
        "op3_language_profiles": {"doc_id": "bigint", "held_out": "boolean", "lang_pred": "string", "score": "double"},
        "op6_piecewise_fingerprints": {
            "doc_id": "bigint", "n_chars": "bigint", "edited_sha256": "string", "fingerprint": "string", "edited_fingerprint": "string",
            "near_edited": "double", "near_next": "double",
        },
        "op9_line_dedup": {"doc_id": "bigint", "n_lines": "bigint", "n_dropped": "bigint", "kept_sha256": "string"},
        "op11_centroid_clusters": {
            "vec_id": "bigint", "cluster": "int", "distance": "bigint", "cluster_inertia": "bigint", "inertia": "bigint", "centroid_sha256": "string",
        },
        "op12_lexical_search": {"item_id": "bigint", "rank": "int", "doc_id": "bigint", "score": "bigint"},
        "op13_toxicity": {"doc_id": "bigint", "held_out": "boolean", "score": "double", "predicted": "int"},
    }
    for name, columns in want.items():
        assert columns.items() <= dict(QUERIES[name](spark, sf).dtypes).items()


assert DOCS
