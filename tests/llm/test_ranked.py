"""Centroid clusters, lexical search and toxicity: brute force, hard rows, held-out labels."""

import hashlib
import math
import re

import duckdb
import numpy as np
import pytest
from cases import docs_frame, hard_rows
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from girder.llm import QUERIES, centroids, ranking, toxicity
from girder.llm.oracles import ranking_sql

# 11 centroid clusters


def all_distances(points, vectors):
    gaps = vectors[:, None, :] - points[None, :, :]
    return (gaps * gaps).sum(axis=2)


@settings(max_examples=80, deadline=None)
@given(st.integers(1, 40), st.integers(1, 4), st.integers(0, 10_000), st.sampled_from([1, 3, 1000, 1 << 26]))
def test_tree_search_equals_all_distances(k, size, seed, spread):
    rng = np.random.default_rng(seed)
    points = rng.integers(-spread, spread + 1, (k, size))
    vectors = np.concatenate([rng.integers(-spread, spread + 1, (60, size)), points])
    which, best = centroids.nearest(centroids.build_tree(points), points, vectors)
    want = all_distances(points, vectors)
    assert best.tolist() == want.min(axis=1).tolist()
    assert which.tolist() == want.argmin(axis=1).tolist()  # argmin takes the first of equals


def test_search_leaves_nodes_out():
    """Well-separated centroids: most nodes are cut, so fewer distances are taken than there are centroids."""
    rng = np.random.default_rng(3)
    points = rng.integers(-100_000, 100_000, (200, 3))
    vectors = points[rng.integers(0, 200, 500)] + rng.integers(-5, 6, (500, 3))
    taken = []
    plain = centroids.squared
    tree = centroids.build_tree(points)
    try:
        centroids.squared = lambda v, c: (taken.append(len(v)), plain(v, c))[1]
        centroids.nearest(tree, points, vectors)
    finally:
        centroids.squared = plain
    assert sum(taken) < 0.25 * 500 * 200


def test_components_without_a_distance_stop_the_run():
    points = np.zeros((1, 2), np.int64)
    with pytest.raises(ValueError, match="64-bit"):
        centroids.nearest(centroids.build_tree(points), points, np.array([[1 << 40, 0]]))


VECTORS = "vec_id long, embedding array<float>, label int"


def brute_clusters(rows, k, size, rounds, seed=2, scale=256):
    kept = [
        (i, [math.floor(scale * np.float64(np.float32(x))) for x in v])
        for i, v in rows
        if v is not None and len(v) == size and all(x is not None and math.isfinite(x) for x in v)
    ]
    named = sorted((hashlib.sha256(f"{seed}:{i}".encode()).hexdigest(), v) for i, v in kept if i is not None)
    points = [v for _, v in named[:k]]

    def assign():
        return [min((sum((a - b) ** 2 for a, b in zip(v, p, strict=True)), c) for c, p in enumerate(points)) for _, v in kept]

    for _ in range(rounds):
        found = assign()
        for c in range(len(points)):
            mine = [v for (_, v), (_, at) in zip(kept, found, strict=True) if at == c]
            if mine:
                points[c] = [sum(column) // len(mine) for column in zip(*mine, strict=True)]
    return sorted((i is None, i or 0, c, d, points[c]) for (i, _), (d, c) in zip(kept, assign(), strict=True))


def test_clusters_equal_brute_force_on_hard_vectors(spark):
    rng = np.random.default_rng(5)
    rows = [(i, [float(x) for x in rng.normal(0, 1, 3)]) for i in range(60)]
    same = [0.5, -0.25, 0.0]
    rows += [(100 + i, same) for i in range(40)] + [(7, same), (7, [1.0, 1.0, 1.0])]
    rows += [(None, [0.1, 0.2, 0.3]), (200, None), (201, []), (202, [1.0, 2.0]), (203, [1.0, None, 2.0]), (204, [math.nan, 0.0, 0.0])]
    rows += [(205, [math.inf, 0.0, 0.0]), (206, [1.0, 2.0, 3.0, 4.0])]
    wide = spark.createDataFrame([(i, v, 1) for i, v in rows], VECTORS).withColumn("Cluster", F.lit("mine")).withColumn("place", F.lit(9))
    got = centroids.cluster(wide, k=12, size=3, rounds=4).collect()
    want = brute_clusters(rows, 12, 3, 4)
    mine = sorted((r["vec_id"] is None, r["vec_id"] or 0, r["cluster"], r["distance"], list(r["centroid"])) for r in got)
    assert mine == want
    assert {(r["label"], r["place"]) for r in got} == {(1, 9)}
    sums = {}
    for _, _, c, d, _ in want:
        sums[c] = sums.get(c, 0) + d
    assert all(r["cluster_inertia"] == sums[r["cluster"]] and r["inertia"] == sum(sums.values()) for r in got)


def test_few_and_no_vectors(spark):
    few = spark.createDataFrame([(1, [0.0, 1.0], 0), (2, [5.0, 1.0], 0)], VECTORS)
    assert {r["distance"] for r in centroids.cluster(few, k=40, size=2).collect()} == {0}
    none = centroids.cluster(few.where("false"), k=40, size=2)
    assert none.collect() == [] and set(none.columns) >= {"vec_id", "cluster", "inertia"}
    assert centroids.cluster(few, k=40, size=64).collect() == []


# 12 lexical search


@settings(max_examples=150, deadline=None)
@given(st.lists(st.dictionaries(st.integers(0, 12), st.integers(1, 3), min_size=1, max_size=10), min_size=1, max_size=8), st.integers(0, 999))
def test_sharing_graph_keeps_every_sum(items, seed):
    """What a query adds up over the graph is the sum over its terms."""
    graph = ranking.share_terms([(q, t, n) for q, terms in enumerate(items) for t, n in terms.items()], len(items))
    assert all(len(level) for level in graph["levels"])
    parts = {made: two for level in graph["levels"] for made, *two in level}
    for made in parts:  # a set is made only if two queries share it
        holders = 0
        for sets in graph["queries"]:
            below = list(sets)
            while below and made not in below:
                below = [p for s in below for p in parts.get(s, ())]
            holders += made in below
        assert holders >= 2
    rng = np.random.default_rng(seed)
    value = rng.integers(0, 1000, (13, 3))
    postings = np.array([(d, t, value[t, d]) for t in range(13) for d in range(3) if value[t, d] % 3], np.int64).reshape(-1, 3).T
    got = ranking.score_block(ranking._arrays(graph, 13), tuple(postings), 3)
    want = [[sum(n * value[t, d] for t, n in terms.items() if value[t, d] % 3) for d in range(3)] for terms in items]
    assert got.tolist() == [[int(x) for x in row] for row in want]


def test_shared_terms_are_added_once():
    common = [(q, t, 1) for q in range(20) for t in range(10)]
    graph = ranking.share_terms([*common, *((q, 10 + q, 1) for q in range(20))], 20)
    assert graph["classes"] == 21 and all(len(q) == 2 for q in graph["queries"])


HARD_ITEMS = [
    (1, "tok10 tok11 tok12 TOK10"), (1, "tok10 tok11 tok12 TOK10"), (2, None), (3, ""), (None, "tok1"), (4, "short Text, text"), (5, "word1x1 tok1"),
    (6, "!?"), (7, "ünïcödé ßtraße"), (1, "tok20"), (8, "nowhere"),
]


def ranked_by_sql(docs, items):
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.execute("CREATE TABLE benchmark (item_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", docs)
    con.executemany("INSERT INTO benchmark VALUES (?, ?)", items)
    return sorted(con.sql(ranking_sql()).fetchall())


@pytest.mark.parametrize("block_terms", [4, ranking.BLOCK_TERMS])
def test_search_equals_sql_on_hard_rows(spark, block_terms):
    """Also with queries in several blocks; extra columns named like the result's do no harm."""
    rows = hard_rows()
    docs = docs_frame(spark, rows).withColumn("rank", F.lit(-1)).withColumn("score", F.lit("x")).withColumn("item_id", F.lit(0))
    items = spark.createDataFrame(HARD_ITEMS, "item_id long, text string").withColumn("doc_id", F.lit(0))
    got = sorted(tuple(r) for r in ranking.search(docs, items, block_terms=block_terms).collect())
    assert got == ranked_by_sql([r[:2] for r in rows], HARD_ITEMS)
    assert {r[0] for r in got} == {1, 4, 5, 7}


def test_ties_beyond_the_top_and_without_id(spark):
    rows = [(i, "alpha beta", "en", "s", 10) for i in (*range(300, 0, -1), None)] + [(None, "gamma", "en", "s", 5), (5, "gamma", "en", "s", 5)]
    items = [(1, "alpha"), (2, "gamma delta")]
    docs = docs_frame(spark, rows).repartition(7)
    got = sorted(tuple(r) for r in ranking.search(docs, spark.createDataFrame(items, "item_id long, text string")).collect())
    assert [r[2] for r in got if r[0] == 1] == list(range(1, 11))
    assert [r[2] for r in got if r[0] == 2] == [5, None]
    assert got == ranked_by_sql([r[:2] for r in rows], items)


def test_search_of_nothing(spark):
    docs = docs_frame(spark, hard_rows())
    items = spark.createDataFrame(HARD_ITEMS, "item_id long, text string")
    assert ranking.search(docs.where("false"), items).collect() == []
    assert ranking.search(docs, items.where("false")).collect() == []


# 13 toxicity


def test_spellings_of_words():
    words = [b"ab", "é".encode(), b"c" * 11]
    grams, owner = toxicity._grams(words, 4)
    want = []
    for w in words:
        whole = b" " + w + b"\n"
        want += [int.from_bytes(whole[max(0, i - 3) : i + 1], "big") for i in range(1, len(whole))]
    assert grams.tolist() == want and np.bincount(owner).tolist() == [3, 3, 12]


def test_words_of_a_text():
    fold = toxicity._fold()
    assert toxicity._distinct_words("B a, b É! b", fold) == [b"b", b"a", "é".encode()]
    assert toxicity._distinct_words(None, fold) == [] == toxicity._distinct_words("-- ", fold)
    assert sum(len(w) for w in toxicity._distinct_words("x" * 300 + "y" * 300, fold)) == 600


def brute_difference(word, toxic, plain, everywhere):
    """The model's formulas over plain dictionaries; each list holds the set of words of every document."""
    order, discount = toxicity.ORDER, toxicity.DISCOUNT

    def spelled(w, n):
        whole = b" " + w + b"\n"
        return [whole[max(0, i - n + 1) : i + 1] for i in range(1, len(whole))]

    def count(docs, n):
        out = {}
        for words in docs:
            for w in words:
                for g in spelled(w, n):
                    out[g] = out.get(g, 0) + 1
        return out

    six = count(everywhere, toxicity.LOWER_ORDER)

    def chance(gram):
        found = 1 / 256
        for n in toxicity.SHARED:
            amount = {}
            for g in {g[-(n + 1) :] for g in six}:
                low = g[-n:]
                # short of n bytes, or beginning with the word: nothing before it
                if n > 1 and (len(low) < n or low[0] == 0x20):
                    amount[low] = sum(c for x, c in six.items() if x[-n:] == low)
                else:
                    amount[low] = amount.get(low, 0) + 1
            low = gram[-n:]
            same = {g: a for g, a in amount.items() if g[:-1] == low[:-1]}
            found = (max(amount[low] - discount, 0) + discount * len(same) * found) / sum(same.values())
        return found

    counts = [count(docs, order) for docs in (toxic, plain)]
    total = 0.0
    for g in spelled(word, order):
        context = [{x: c for x, c in found.items() if x[:-1] == g[:-1]} for found in counts]
        if not all(context):
            continue
        free = [discount * len(c) / sum(c.values()) for c in context]
        if any(g in c for c in context):
            low = chance(g)
            p = [max(c.get(g, 0) - discount, 0) / sum(c.values()) + f * low for c, f in zip(context, free, strict=True)]
            total += math.log(p[0]) - math.log(p[1])
        else:
            total += math.log(free[0]) - math.log(free[1])
    return total


TOXIC_ROWS = [
    (1, "you utter trashling", 1), (2, "trash and moronic trash", 1), (3, "the moron utters", 1), (4, "the utter thing and the thin", 0),
    (5, "and then the thing", 0), (6, "trains and tracks utter", 0), (7, "more of the same and more", 0), (8, "unlabelled morning trash", None),
]


def test_differences_equal_the_formulas(spark):
    """Kneser-Ney chances by joins against plain dictionaries, for words seen and not."""
    rows = spark.createDataFrame([(t, None if y is None else 1 - y) for _, t, y in TOXIC_ROWS], "text string, kind int")
    counted = toxicity._count(rows)
    chances = toxicity._shared_chances(counted.where("lower").select("gram", "n"))
    full = counted.where("not lower").withColumn("low", toxicity._last(F.col("gram"), toxicity.SHARED[-1]))
    table = toxicity.differences(full.join(chances, "low"), F.col("toxic_early"), F.col("plain_early")).collect()
    keys = np.array([r["gram"] for r in table], np.int64).view(np.uint64)
    values = np.array([r["value"] for r in table])
    order = np.argsort(keys)
    words = [b"trash", b"moron", b"the", b"utter", b"thing", b"morning", b"trashy", b"unseen", b"and"]
    got = toxicity._word_sums(words, keys[order], values[order])
    docs = [(set(t.lower().encode().split()), y) for _, t, y in TOXIC_ROWS]
    groups = [[w for w, y in docs if y == k] for k in (1, 0)]
    want = [brute_difference(w, *groups, [w for w, _ in docs]) for w in words]
    assert got == pytest.approx(want)
    assert got[0] > 0 > got[2]


def test_sum_of_a_document():
    d = np.array([-3.0, 8.0, 7.0, -1.0, -2.0])
    gains = [math.log(1 - toxicity.SHARE + toxicity.SHARE * math.exp(x)) for x in d]
    best = max(sum(gains[i:j]) for i in range(6) for j in range(i, 6))
    assert toxicity._document_sum(d) == pytest.approx(best - math.log(5 + toxicity.SHORT))
    assert toxicity._document_sum(np.zeros(0)) == pytest.approx(-math.log(toxicity.SHORT))


def held_out_of():
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))


def test_held_out_labels_do_not_count(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf}/labels.parquet").select("doc_id", "toxic")
    turned = labels.withColumn("toxic", F.when(held_out_of(), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    one, two = (sorted(tuple(r) for r in toxicity.score(docs, x, held_out_of()).select("doc_id", "score", "predicted").collect()) for x in (labels, turned))
    assert one == two


def test_held_out_toxic_documents_are_found(spark):
    """Labels that no count or curve saw: four of five toxic documents, one clean one in fifty at most."""
    folder = "/root/testdata/sf0.1"
    rows = QUERIES["op13_toxicity"](spark, folder)
    assert dict(rows.dtypes) == {"doc_id": "bigint", "held_out": "boolean", "score": "double", "predicted": "int"}
    labels = spark.read.parquet(f"{folder}/labels.parquet").select("doc_id", "toxic")
    found = rows.join(labels, "doc_id").where("held_out").groupBy("toxic").agg(F.avg("predicted").alias("share")).collect()
    share = {r["toxic"]: r["share"] for r in found}
    assert share[1] >= 0.8 and share[0] <= 0.02


def test_joined_scores_equal_the_table(spark, sf):
    docs = docs_frame(spark, hard_rows()).select("doc_id", "text").unionByName(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text"))
    labels = spark.read.parquet(f"{sf}/labels.parquet").select("doc_id", "toxic")
    one, two = (
        sorted(((r["doc_id"] is None, r["doc_id"] or 0, r["score"]) for r in toxicity.score(docs, labels, held_out_of(), n).collect()))
        for n in (toxicity.TABLE_BYTES, 0)
    )
    assert len(one) == docs.count()
    assert [r[:2] for r in one] == [r[:2] for r in two]
    assert [r[2] for r in one] == pytest.approx([r[2] for r in two])


def test_no_labels_no_toxicity(spark):
    docs = docs_frame(spark, hard_rows())
    for labels in ([], [(1, 1)], [(1, 0), (3, None), (None, 1), (8, 7)]):
        frame = spark.createDataFrame(labels, "doc_id long, toxic int")
        got = toxicity.score(docs.withColumn("Score", F.lit("old")), frame, F.lit(False))
        assert {(r["score"], r["predicted"]) for r in got.collect()} == {(0.0, 0)}
        assert "Score" not in got.columns


def test_search_terms_are_runs():
    pattern = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
    text = "A-b_c9 É ß\u0085x y z\x7fq"
    found = text.encode().translate(ranking._fold()).split()
    assert [t.decode() for t in found] == [w.translate({c: c + 32 for c in range(65, 91)}) for w in pattern.findall(text)]
