"""Vantage-point trees, ranked search and the Merkle manifest against plain versions."""

import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from skyledger.llm import merkle, ranked, vptree
from tests.llm import plain

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string"


# ---- vantage-point trees

def points(n=700, size=12, seed=5, spread=True):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, size))
    if spread:
        x *= rng.uniform(0.2, 3.0, (n, 1))
    return x.astype(np.float32).astype(float)


def table(spark, rows):
    return spark.createDataFrame(
        [(i, None if v is None else [None if c is None else float(c) for c in v]) for i, v in rows],
        "vec_id long, embedding array<float>")


def expected(rows, k, every):
    """{query: [(id, product)]} by comparing all, rows being (id, vector) without odd ones."""
    out = {}
    for i, v in rows:
        if i % every == 0:
            scores = []
            for j, w in rows:
                if j != i:
                    total = 0.0
                    for a, b in zip(v, w):
                        total += a * b
                    scores.append((-total, j))
            out[i] = [(j, -s) for s, j in sorted(scores)[:k]]
    return out


def lists(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r.query_id, r["rank"])):
        assert r["rank"] == len(out.setdefault(r.query_id, [])) + 1
        out[r.query_id].append((r.vec_id, r.score))
    return out


@pytest.mark.parametrize("spread", [True, False])
def test_factor_one_is_exact_for_any_norms(spark, spread):
    rows = list(enumerate(points(spread=spread).tolist()))
    got = lists(vptree.search(table(spark, rows), k=7, every=25, factor=1.0, shard_rows=200, block_bytes=900))
    assert got == expected(rows, 7, 25)


def test_factor_trades_recall_for_visits():
    x = points(4000, 16, spread=False)
    x /= np.linalg.norm(x, axis=1)[:, None]
    tree = vptree.plant(np.column_stack([x, np.zeros(len(x))]))
    q, true = x[::40], np.argsort(-(x[::40] @ x.T), axis=1)[:, :10]
    last = None
    for factor, least in ((1.0, 1.0), (2.0, 0.97), (3.0, 0.9)):
        who, row, visits = vptree.nearest(x, tree, q, 1.0, 10, factor)
        found = set(zip(who.tolist(), row.tolist()))
        assert np.mean([(i, j) in found for i in range(len(q)) for j in true[i]]) >= least
        assert last is None or visits < last
        last = visits


def test_clustered_vectors_are_pruned_at_factor_one():
    rng = np.random.default_rng(1)
    x = np.repeat(rng.normal(size=(40, 16)), 100, axis=0) + 0.01 * rng.normal(size=(4000, 16))
    x /= np.linalg.norm(x, axis=1)[:, None]
    tree = vptree.plant(np.column_stack([x, np.zeros(len(x))]))
    _, _, visits = vptree.nearest(x, tree, x[::40], 1.0, 10, 1.0)
    assert visits < 0.3 * len(x[::40]) * (len(tree.leaf) - 1)


def test_bounds_hold_for_every_vector():
    x, q = points(500, 6), points(30, 6, seed=9)
    m2 = (x**2).sum(axis=1).max()
    lifted = np.column_stack([x, np.sqrt(np.maximum(m2 - (x**2).sum(axis=1), 0))])
    tree = vptree.plant(lifted, leaf=16)
    assert sorted(tree.rows.tolist()) == list(range(500))
    far = np.sqrt(((np.column_stack([q, np.zeros(30)])[:, None] - lifted[None]) ** 2).sum(axis=2))
    bounds = vptree.leaf_bounds(tree, far[:, tree.vantage])
    for leaf in range(len(tree.leaf) - 1):
        assert (bounds[:, leaf, None] <= far[:, tree.rows[tree.leaf[leaf] : tree.leaf[leaf + 1]]] + 1e-9).all()


def test_odd_vectors(spark):
    x = points(60, 4).tolist()
    rows = list(enumerate(x))
    odd = [(100, None), (120, [0.0] * 4), (140, [1.0, None, 2.0, 3.0]), (160, [float("nan"), 1, 1, 1]),
           (180, [float("inf"), 1, 1, 1]), (None, x[0]), (200, [1.0, 2.0]), (20, x[20])]
    df = table(spark, rows + odd).withColumns({c: F.lit("other") for c in ("id", "v", "query", "shard", "score", "rank")})
    assert lists(vptree.search(df, k=5, factor=1.0, shard_rows=16)) == expected(rows, 5, 20)


def test_few_and_no_candidates(spark):
    x = points(3, 4).tolist()
    assert lists(vptree.search(table(spark, [(20, x[0]), (7, x[1]), (9, x[2])]))) == expected(list(zip([20, 7, 9], x)), 20, 20)
    assert vptree.search(table(spark, [(20, x[0])])).count() == 0
    assert vptree.search(table(spark, [])).count() == 0
    assert vptree.search(table(spark, [(20, None)])).count() == 0


def test_a_vector_that_many_rows_share(spark):
    x = points(90, 4).tolist()
    rows = [(i, x[i] if i % 3 else x[0]) for i in range(90)]
    points_ = vptree.build_index(vptree.valid(table(spark, rows), "embedding", "vec_id"), 4, 1000)
    assert max(len(r.ids) for r in points_.points.collect()) == 5
    assert lists(vptree.search(table(spark, rows), k=4, every=3, factor=1.0, shard_rows=20)) == expected(rows, 4, 3)


# ---- ranked search

def found(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r.item_id, r["rank"])):
        assert r["rank"] == len(out.setdefault(r.item_id, [])) + 1
        out[r.item_id].append((r.doc_id, r.score))
    return out


def prose(n, words, seed):
    rng = random.Random(seed)
    stock = [f"w{i}" for i in range(words)]
    weight = [1 / (i + 1) for i in range(words)]
    return [" ".join(rng.choices(stock, weight, k=rng.choice([0, 1, 5, 40, 200]))) for _ in range(n)]


def items_of(spark, items):
    return spark.createDataFrame(items, "item_id long, text string")


def test_ranks_equal_a_plain_scan(spark, documents, corpus):
    items = [(10, corpus[70][1]), (9, "the THE der, that-er in;ion"), (8, None), (7, " ."), (6, "nowhere"), (None, "the"), (9, "x")]
    got = found(ranked.search(documents.withColumn("item_id", F.lit("x")), items_of(spark, items), k=10))
    assert got == plain.ranked(corpus, items, 10) and set(got) == {10, 9}


@pytest.mark.parametrize("limit", [500_000, 12])
def test_ranks_of_many_documents_and_blocks_of_queries(spark, limit):
    docs = list(enumerate(prose(600, 300, 1)))
    items = list(enumerate(prose(25, 300, 2)))
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    assert found(ranked.search(df, items_of(spark, items), k=8, limit=limit)) == plain.ranked(docs, items, 8)


def test_accumulators_are_limited_and_the_result_is_exact():
    rng = np.random.default_rng(2)
    docs, size = 3000, 40
    tf = rng.integers(0, 4, (docs, size)) * (rng.random((docs, size)) < np.linspace(0.01, 1, size))
    n = tf.sum(axis=1) + 10
    doc, term = np.nonzero(tf)
    df = (tf > 0).sum(axis=0)
    weights = np.floor(1000 * np.log((2 * docs + 2) / (2 * df + 1))).astype(np.int64)
    shard = ranked.Shard(n, (tf > 0).sum(axis=1), term, tf[doc, term].astype(np.int64), weights, docs, int(n.sum()))
    terms = np.argsort(df, kind="stable")
    place, score, made = shard.search(terms, 10, 1)
    whole = np.zeros(docs, np.int64)
    np.add.at(whole, shard.docs, shard.gain)
    assert made < 0.8 * len(shard.docs) and len(place) < docs
    ids, scores = ranked.best(place, score, 10)
    order = np.lexsort((np.arange(docs), -whole))[:10]
    assert ids.tolist() == order.tolist() and scores.tolist() == whole[order].tolist()
    later, high, fewer = shard.search(terms, 10, int(scores[-1]))
    assert fewer <= made and ranked.best(later, high, 10)[0].tolist() == ids.tolist()


def test_equal_scores_go_to_the_smaller_id(spark):
    docs = [(i, "alpha beta") for i in range(90, 30, -1)] + [(5, None), (6, ""), (None, "alpha"), (31, "alpha beta")]
    items = [(1, "alpha"), (2, "beta gamma")]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(6)
    got = found(ranked.search(df, items_of(spark, items)))
    assert got == plain.ranked(docs, items) and [d for d, _ in got[1]][:3] == [31, 31, 32]


def test_search_of_nothing(spark, empty):
    assert ranked.search(empty, items_of(spark, [(1, "a")])).count() == 0
    docs = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    assert ranked.search(docs, items_of(spark, [])).count() == 0


def test_a_very_long_text(spark):
    docs = [(1, "ab cd " * 300_000), (2, "ab"), (3, "x" * 500_000), (4, "zz")]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    items = [(1, "ab zz"), (2, "x" * 500_000)]
    assert found(ranked.search(df, items_of(spark, items))) == plain.ranked(docs, items)


# ---- manifest

def tampered(row):
    d, source, lang, n, text = row
    if d is not None and zlib.crc32(str(d).encode()) % 3 == 0 and text is not None:
        text = text.translate(plain.LOWER)
    return d, source, lang, n, text


def rows_of(docs):
    return [(r.doc_id, r.source, r.lang, r.n_chars, r.text) for r in docs.collect()]


def proved(df):
    order = lambda r: (r[0] is not None, r[0] or 0, *r[1:])
    return sorted([(r.doc_id, r.leaf, r.subroot, r.root, r.proof_sha256, r.folded_root, r.verified) for r in df.collect()], key=order)


@pytest.mark.parametrize("levels", [1, 2, 4])
def test_proofs_equal_a_plain_tree(spark, documents, levels):
    """Few levels a builder: several rounds."""
    clashing = documents.withColumns({c: F.lit("x") for c in ("tree", "p", "n", "log", "leaf", "id")})
    got = proved(merkle.prove(clashing, levels=levels))
    assert got == sorted(plain.merkle(rows_of(documents), tampered))
    assert 0 < sum(not r[-1] for r in got) < len(got)


def test_odd_rows(spark):
    rows = [(5, None, None, None, None), (1, "s", "", 3, "ABC"), (None, "s", "en", 1, "A"), (2, "s", "en", 1, "É:-"), (2, "s", "en", 1, "É:-"),
            (3, "", "-", 0, ""), (-7, "-", "é", 9, "x" * 3_000_000), (4, "s", "2:en", 1, None), (5, "s", "en", 2, "AB"), (5, "s", "en", 2, "Ab")]
    assert proved(merkle.prove(spark.createDataFrame(rows, SCHEMA))) == sorted(
        plain.merkle(rows, tampered), key=lambda r: (r[0] is not None, r[0] or 0, *r[1:]))


def test_one_row_and_none(spark):
    rows = [(1, "s", "en", 3, "abc")]
    got = proved(merkle.prove(spark.createDataFrame(rows, SCHEMA)))
    assert got == plain.merkle(rows, tampered) and got[0][1] == got[0][3] and got[0][4] == plain.sha("")
    assert merkle.prove(spark.createDataFrame([], SCHEMA)).count() == 0


@pytest.mark.parametrize("leaves", [1, 2, 7, 8, 9, 64, 65, 100, 512, 513, 700])
def test_positions_are_places_of_the_log(leaves):
    names = [plain.sha(str(i)) for i in range(leaves)]
    for levels in {merkle.height(leaves), merkle.height(leaves) + 1}:
        body = merkle.append_log(names, levels)
        log = [body[i : i + 32].hex() for i in range(0, len(body), 32)]
        level, seen = names, []
        for up in range(levels + 1):
            at = [int(merkle.position(up, i, leaves, levels)) for i in range(len(level))]
            assert [log[p] for p in at] == level
            seen += at
            level = [plain.sha("".join(level[i : i + 8])) for i in range(0, len(level), 8)]
        assert sorted(seen) == list(range(len(log)))
