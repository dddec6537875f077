"""The similarity join checks as few whole sets as join a group, and loses no link by it."""

import random

from cases import brute_components

from girder.llm import jaccard
from girder.llm.components import components

SCHEMA = "doc_id long, text string"


def edited(rng, words, changes):
    out = list(words)
    for _ in range(changes):
        out[rng.randrange(len(out))] = f"x{rng.randrange(10**6)}"
    return " ".join(out)


def test_near_copies_are_joined_by_few_checks(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "STAR", 4)
    rng = random.Random(5)
    words = [f"w{i}" for i in range(300)]
    rows = [(i, edited(rng, words, 1)) for i in range(30)] + [(100, "something else altogether")]
    docs = spark.createDataFrame(rows, SCHEMA)
    pairs = spark.createDataFrame([(a, b) for a in range(30) for b in range(a)] + [(100, 0)], "doc_id long, other long")
    links = jaccard._verify(pairs, docs, 4, 85, False, stepwise=True)
    assert links.count() < 60  # of 435 pairs
    assert {(r["node"], r["component"]) for r in components(links).collect()} == {(i, 0) for i in range(30)}
    assert jaccard._verify(pairs, docs, 4, 85, False).count() == 435


def test_stepwise_checks_lose_no_link(spark, monkeypatch):
    for name, value in (("STAR", 2), ("BLOCK", 8), ("FEW", 3)):
        monkeypatch.setattr(jaccard, name, value)
    rng = random.Random(9)
    rows = []
    for group in range(6):
        words = [f"g{group}w{i}" for i in range(120)]
        rows += [(len(rows) + i, edited(rng, words, rng.choice([0, 1, 2, 4, 6, 9]))) for i in range(14)]
    rng.shuffle(rows)
    got = jaccard.similar_components(spark.createDataFrame(rows, SCHEMA), 4, 85).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == brute_components(rows, 4, 85)


def test_a_repeated_id_with_an_empty_text_keeps_its_links(spark):
    text = " ".join(f"w{i}" for i in range(80))
    rows = [(1, text), (2, text + " more"), (2, ""), (2, None)]
    got = jaccard.similar_components(spark.createDataFrame(rows, SCHEMA).repartition(3), 4, 85).collect()
    assert sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got) == [(1, 77, 1), (2, 0, 2), (2, 0, 2), (2, 78, 1)]
