import random

import brute
import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.llm import components as C
from plumbline.llm import simhash as S
from plumbline.llm.common import text_bytes
import pyarrow as pa

from corpus_fixtures import make_docs, odd_docs, rows, texts  # noqa: F401


def test_fingerprints_by_brute_force(texts):
    some = [t for _, t, *_ in texts[:40]] + ["", " \t", "one", "one two three four", "ÀB c D e", "a b c d " * 700]
    assert S.fingerprints(text_bytes(pa.array(some))).tolist() == [brute.fingerprint(t) for t in some]


def planted(n, seed=5):
    """Random fingerprints, chains of near ones, and a dense group."""
    r = random.Random(seed)
    out = [r.getrandbits(64) for _ in range(n)]
    for base in out[:10]:
        for _ in range(6):
            for _ in range(r.randint(1, 4)):
                base ^= 1 << r.randrange(64)
            out.append(base)
    dense = r.getrandbits(64)
    out += [dense ^ (1 << a) ^ (1 << b) for a in range(12) for b in range(a)]
    return sorted({*out, 0, 1, 2**64 - 1})


def test_bk_trees_find_all_pairs():
    values = np.array(planted(300), np.uint64)
    half = np.arange(len(values)) % 3
    order = np.argsort(half, kind="stable")
    values, shard = values[order], half[order]
    forest = S.Forest(values, shard)
    got = {(int(a), int(b)) for q, k in forest.search(values, shard, 4) for a, b in zip(q, k)}
    want = {(a, b) for a in range(len(values)) for b in range(len(values)) if shard[a] == shard[b] and int(values[a] ^ values[b]).bit_count() <= 4}
    assert got == want


@pytest.mark.parametrize("tree_nodes", [4096, 3])
def test_components_of_fingerprints(spark, tree_nodes):
    values = planted(200)
    signed = [(v - (1 << 64) if v >> 63 else v,) for v in values]
    links = S.links(spark.createDataFrame(signed, "fp bigint"), 4, tree_nodes)
    roots = {r.node % (1 << 64): r.root for r in C.components(links).collect()}
    want = brute.components(list(enumerate(values)))
    got = [roots.get(v, v - (1 << 64) if v >> 63 else v) for v in values]
    assert len(set(zip(got, want))) == len(set(got)) == len(set(want))


def test_long_chain_and_hub(spark):
    chain = [(k, k + 1) for k in range(200)]
    hub = [(1000, 1000 + k) for k in range(1, 400)]
    links = spark.createDataFrame([*chain, *hub, (5, 5), (None, 3)], "a bigint, b bigint")
    out = {r.node: r.root for r in C.components(links).collect()}
    assert out == {**{k: 0 for k in range(201)}, **{1000 + k: 1000 for k in range(400)}}
    assert C.components(links.filter("false")).count() == 0


def test_query_by_brute_force(make_docs, texts):
    prints = [(i, brute.fingerprint(t)) for i, t, *_ in texts]
    want = dict(zip((i for i, _ in prints), brute.components(prints)))
    out = S.near_duplicates(make_docs(texts)).collect()
    assert {r.doc_id: r.component_id for r in out} == want
    assert {r.doc_id: r.fingerprint for r in out} == {i: f"{p:016x}" for i, p in prints}


def test_defined_results(odd_docs):
    out = S.near_duplicates(odd_docs)
    assert out.count() == odd_docs.count()
    assert rows(out.filter("doc_id in (1, 2, 3)"), "fingerprint", "component_id") == [("0" * 16, 1)] * 3
    assert S.near_duplicates(odd_docs.filter("false")).count() == 0


def test_one_document_of_each_group_stays(odd_docs, make_docs):
    docs = odd_docs.withColumn("fp", F.lit(7)).withColumn("row_number", F.lit("x"))
    kept = S.distinct_documents(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect() if r.doc_id is not None) == [1, 4, 6, 7, 8]
    assert S.distinct_documents(docs.filter("false")).count() == 0
