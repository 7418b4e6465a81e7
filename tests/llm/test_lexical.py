import collections
import math
import random
import re

import numpy as np
import pytest

from plumbline.llm import lexical

from corpus_fixtures import make_docs, odd_docs, texts  # noqa: F401

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return [t.translate({c: c + 32 for c in range(65, 91)}) for t in TERM.findall(text or "")]


def wanted(docs, items, top=10):
    vectors = [(i, collections.Counter(terms(t))) for i, t in docs]
    n_docs, n_terms = sum(1 for _, v in vectors if v), sum(sum(v.values()) for _, v in vectors)
    df = collections.Counter(t for _, v in vectors for t in v)
    asked = collections.defaultdict(collections.Counter)
    for i, t in set(items):
        asked[i].update(terms(t))
    out = []
    for item, q in asked.items():
        scores = []
        for d, v in vectors:
            n = sum(v.values())
            m = 100 - 75 + (75 * n * n_docs) // n_terms if n else 0
            score = sum(k * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10**9 * v[t]) // (1000 * v[t] + 8 * m)) for t, k in q.items() if v[t])
            if score > 0:
                scores.append((-score, d is None, d))
        for rank, (s, _, d) in enumerate(sorted(scores, key=lambda x: (x[0], x[1], x[2] or 0))[:top], 1):
            out.append((item, rank, d, -s))
    return sorted(out, key=repr)


def got(df):
    assert df.columns == ["item_id", "rank", "doc_id", "score"]
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.fixture(scope="module")
def make_items(spark):
    return lambda rows: spark.createDataFrame(rows, "item_id bigint, text string")


def random_rows(seed, n):
    r = random.Random(seed)
    word = lambda: f"W{min(int(r.paretovariate(0.6)), 400)}"
    docs = [(k, " ".join(word() for _ in range(r.choice([0, 1, 5, 40, 200])))) for k in range(n)]
    docs += [(n + k, docs[7][1] or "w1 w2") for k in range(n)]  # one text very often
    items = [(k, " ".join(word() for _ in range(r.choice([1, 6, 30])))) for k in range(25)]
    return docs, items


@pytest.mark.parametrize("limits", [{}, {"part_terms": 40, "entries": 500}])
def test_by_brute_force(make_docs, make_items, limits):
    docs, items = random_rows(5, 150)
    assert got(lexical.rank(make_docs(docs).repartition(3), make_items(items), **limits)) == wanted(docs, items)


def test_sample_by_brute_force(make_docs, spark, root, texts):
    items = [tuple(r) for r in spark.read.parquet(f"{root}/benchmark.parquet").select("item_id", "text").collect()]
    docs = [(i, t) for i, t, *_ in texts]
    assert got(lexical.rank(make_docs(docs), spark.createDataFrame(items, "item_id bigint, text string"))) == wanted(docs, items)


def test_bounds_hold_and_subtrees_are_left():
    r = np.random.default_rng(1)
    vectors = [np.unique(np.minimum(r.geometric(0.05, r.integers(1, 40)), 199)) for _ in range(600)]
    first = np.cumsum([0, *map(len, vectors)])
    rank, tf = np.concatenate(vectors), r.integers(1, 5, first[-1])
    m = r.integers(25, 300, 600)
    tree = lexical.Tree(np.arange(600), m, first, rank, tf, 201)
    items = [np.unique(r.integers(0, 200, 30)) for _ in range(8)]
    item = np.repeat(np.arange(8), [len(x) for x in items])
    queries = lexical.Queries(item, np.concatenate(items), r.integers(1, 9000, len(item)), 8)
    up = np.zeros(tree.inner + 600, np.int64)
    for v in range(tree.inner):
        up[tree.child[tree.first_child[v]:tree.first_child[v + 1]]] = v
    every = np.arange(1, tree.inner + 600)
    for q in range(8):
        bound = np.concatenate([[np.iinfo(np.int64).max], tree.bounds(queries, np.full(len(every), q), every)])
        assert (bound[every] <= bound[up[every]]).all()
    best = lexical.Best(8, 10)
    looked = lexical.search(tree, queries, best, 16)
    assert looked < 8 * len(every) and len(best.item) == 80


def test_odd_rows(odd_docs, make_items):
    docs = [(r.doc_id, r.text) for r in odd_docs.collect()]
    items = [(1, "ALPHA beta"), (1, "ALPHA beta"), (1, "beta é"), (2, None), (3, ""), (None, "twice the same row"), (4, "nowhere"), (5, "x" * 30_000)]
    clash = odd_docs.withColumnRenamed("lang", "item_id").withColumnRenamed("source", "score")
    assert got(lexical.rank(clash, make_items(items))) == wanted(docs, [(i, t) for i, t in items])
    assert lexical.rank(odd_docs.filter("false"), make_items(items)).count() == 0
    assert lexical.rank(odd_docs, make_items(items).filter("false")).count() == 0
