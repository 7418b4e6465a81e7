import brute
import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from plumbline.llm import decontaminate as D
from plumbline.llm.common import text_bytes

from corpus_fixtures import make_docs, odd_docs, texts  # noqa: F401

ITEMS = "item_id bigint, text string"
word = st.sampled_from(["a", "b", "c", "dé", "X", "longer" * 9])
sentence = st.lists(word, max_size=40).map(" ".join)


def longest(text, items, window):
    """Matches that can't grow to either side, by comparing every pair of places."""
    w, out = brute.WORD.findall(text.translate(brute.LOWER)), set()
    for i, x in items:
        own = brute.WORD.findall(x.translate(brute.LOWER))
        for a in range(len(w)):
            for j in range(len(own)):
                if w[a] == own[j] and not (a and j and w[a - 1] == own[j - 1]):
                    n = 0
                    while a + n < len(w) and j + n < len(own) and w[a + n] == own[j + n]:
                        n += 1
                    if n >= min(window, len(own)):
                        out.add((str(i), j, a, n))
    return out


@settings(max_examples=150, deadline=None)
@given(st.lists(sentence, min_size=1, max_size=6), st.lists(sentence, max_size=4))
def test_matches_by_brute_force(texts, items):
    bench = D.Benchmark([(k // 2, t.encode()) for k, t in enumerate(items)], 4)
    numbered = [(k // 2, t) for k, t in enumerate(items)]  # two texts with one id
    for t, (n, matches) in zip(texts, D.match(text_bytes(pa.array(texts)), bench)):
        want = brute.contamination(t, numbered, 4)
        assert (n, {k for a, b in D.runs_of(matches) for k in range(a, b)}, {int(m[0]) for m in matches}) == want
        assert set(matches) == longest(t, numbered, 4) and len(set(matches)) == len(matches)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(0, 3), max_size=120))
def test_suffix_array_order(ids):
    ids = np.array([*ids, 0], np.int32)
    array = D.suffix_array(ids, 3)

    def suffix(s):
        return ids[s:s + ids[s:].tolist().index(0)].tolist()

    assert array.tolist() == sorted(np.flatnonzero(ids).tolist(), key=lambda s: (suffix(s), s))


def rows_of(df):
    return sorted(((r.asDict(), sorted(m.matches)) for r, m in zip(D.digests(df.orderBy("doc_id")).collect(), df.orderBy("doc_id").collect())), key=repr)


def test_an_id_of_very_many_rows(spark, make_docs):
    """Every part holds some rows of the id, none all of them."""
    bench = spark.range(100_000).selectExpr("7L as item_id", "concat('word', id % 5000, ' next', id % 5000, ' last') as text")
    parts = D.benchmark_parts(bench, limit=20_000)
    sizes = [p.count() for p in parts]
    assert sum(sizes) == 5000 and max(sizes) < 3 * 5000 / len(parts)
    docs = make_docs([(1, "a word17 next17 last b word4999 next4999 last"), (2, "word17 next18 last")])
    out = {r.doc_id: r for r in D.digests(D.find(docs, bench, limit=60_000)).collect()}
    assert (out[1].n_hit, out[1].n_items, out[1].longest) == (6, 1, 3) and not out[2].contaminated


def test_query_by_brute_force(spark, root, make_docs, texts):
    items = [tuple(r) for r in spark.read.parquet(f"{root}/benchmark.parquet").select("item_id", "text").collect()]
    out = {r.doc_id: r for r in D.digests(D.find(make_docs(texts), spark.createDataFrame(items, ITEMS))).collect()}
    for i, t, *_ in texts:
        n, hit, found = brute.contamination(t, items)
        digest = brute.sha(",".join(sorted(map(str, found))).encode())
        assert (out[i].n_words, out[i].n_hit, out[i].n_items, out[i].items_sha256, out[i].contaminated) == (n, len(hit), len(found), digest, bool(hit))
    assert any(r.contaminated for r in out.values())


def test_a_large_benchmark_is_searched_in_parts(spark, root, make_docs, texts):
    docs, bench = make_docs(texts), spark.read.parquet(f"{root}/benchmark.parquet")
    assert len(D.benchmark_parts(bench, limit=2000)) > 2
    assert rows_of(D.find(docs, bench, limit=2000)) == rows_of(D.find(docs, bench))
    assert sorted(r.doc_id for r in D.clean(docs, bench, limit=2000).collect()) == sorted(r.doc_id for r in D.clean(docs, bench).collect())


def test_defined_results(spark, odd_docs):
    bench = spark.createDataFrame([(1, "twice the same row"), (1, "twice the same row"), (2, None), (None, "no id here"), (3, "?!")], ITEMS)
    out = {r.doc_id: r for r in D.digests(D.find(odd_docs, bench)).collect()}
    assert (out[6].n_words, out[6].n_hit, out[6].n_items, out[6].contaminated) == (4, 4, 1, True)
    assert (out[1].n_words, out[1].contaminated) == (0, False) and not out[None].contaminated
    assert D.find(odd_docs, bench).count() == odd_docs.count()
    assert D.find(odd_docs, bench.filter("false")).filter(F.size("runs") > 0).count() == 0
    assert D.find(odd_docs.filter("false"), bench).count() == 0
    clash = odd_docs.withColumn("match", F.lit(1))
    kept = D.clean(clash, bench)
    assert kept.columns == clash.columns and kept.count() == clash.count() - 2


@pytest.mark.parametrize("n", [1, 30, 4000])
def test_word_hashes_do_not_depend_on_the_place(n):
    data = np.frombuffer(b"x" + b"ab" * n + b" " + b"ab" * n, np.uint8)
    h = D.word_hashes(data, np.array([1, 2 * n + 2]), np.array([2 * n + 1, 4 * n + 2]))
    assert h[0] == h[1]
