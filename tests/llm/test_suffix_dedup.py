import random

import brute
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
import numpy as np

from plumbline.llm import suffix_dedup as S

from corpus_fixtures import make_docs, odd_docs, rows, texts  # noqa: F401


def check(docs, rows, length=100, gram=24, shard_reads=S.SHARD_READS):
    out = {r.doc_id: r for r in S.digests(S.dedup(docs, length=length, gram=gram, shard_reads=shard_reads)).collect()}
    assert len(out) == len(rows)
    for (i, _), (data, mark) in zip(rows, brute.repeated([t for _, t in rows], length)):
        left = bytes(b for b, m in zip(data, mark) if not m)
        got = (out[i].n_bytes, out[i].n_removed, out[i].n_spans, out[i].kept_sha256)
        assert got == (len(data), sum(mark), brute.runs(mark), brute.sha(left)), i


def test_sample_by_brute_force(make_docs, texts):
    rows = sorted((i, t) for i, t, *_ in texts)
    check(make_docs(rows), rows)


def test_sample_in_narrow_shards(make_docs, texts):
    rows = sorted((i, t) for i, t, *_ in texts)
    check(make_docs(rows), rows, shard_reads=0)


@pytest.mark.parametrize("seed,shard_reads", [(0, 2048), (1, 2048), (2, 1), (3, 0)])
def test_few_letters_short_windows(make_docs, seed, shard_reads):
    """Periods, overlaps and many different reads of one anchor."""
    r = random.Random(seed)
    pool = ["".join(r.choice("ab é") for _ in range(40)) for _ in range(6)]
    rows = [(i, "".join(r.choice(pool)[r.randrange(10):] for _ in range(r.randrange(6)))) for i in range(60)]
    rows += [(100, "a" * 300), (101, "a" * 40), (102, "ab" * 100), (103, "")]
    check(make_docs(r.sample(rows, len(rows))).repartition(5), rows, 20, 6, shard_reads)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.text(alphabet="abc", min_size=12, max_size=12), min_size=1, max_size=12), st.randoms())
def test_rounds_find_repeated_windows(reads, r):
    columns = np.array([list(x.encode()) for x in reads], np.uint8).T
    rank = np.array(r.sample(range(len(reads)), len(reads)))
    first, last = np.zeros(len(reads), int), np.full(len(reads), 8)
    last[::3] = 4
    out = S.repeated_windows(columns, first, last, rank, 4)
    for k in range(9):
        for a, x in enumerate(reads):
            want = last[a] >= k and any(last[b] >= k and rank[b] < rank[a] and y[k:k + 4] == x[k:k + 4] for b, y in enumerate(reads))
            assert out[k, a] == want


def test_defined_results(make_docs, odd_docs):
    out = S.digests(S.dedup(odd_docs))
    assert out.count() == odd_docs.count()
    one = {r.doc_id: r for r in out.collect()}
    assert (one[1].n_bytes, one[1].n_removed, one[1].n_spans, one[1].kept_sha256) == (0, 0, 0, brute.sha(b""))
    assert one[5].n_removed == one[5].n_bytes and one[5].n_spans == 1  # the text of 4
    assert S.dedup(odd_docs.filter("false")).count() == 0
    copies = make_docs([(3, "y" + "z1 x2 " * 30)] * 3).withColumn("d", F.lit(1)).withColumn("h", F.lit(2))
    assert len({tuple(r) for r in S.digests(S.dedup(copies)).collect()}) == 1


@pytest.mark.parametrize("shard_reads", [S.SHARD_READS, 0])
def test_rows_equal_in_id_and_text_are_one_document(make_docs, shard_reads):
    """The only occurrence of a text stays in every copy of its row; an other text of the id is compared with it."""
    r = random.Random(5)
    a, b, c = ("".join(r.choice("abcdefgh ") for _ in range(n)) for n in (300, 250, 220))
    single = [(None, b), (3, a), (4, "head " + a[40:200] + " tail"), (7, c), (7, c + c[:150]), (8, "z")]
    docs = make_docs([*single, (3, a), (3, a), (None, b), (7, c), (8, "z")]).repartition(4)
    out = S.digests(S.dedup(docs, shard_reads=shard_reads)).collect()
    # texts of one id follow in order of a digest, so either of the two of id 7 may be the earlier
    wants = []
    for order in (single, [*single[:3], single[4], single[3], single[5]]):
        want = {(i, len(data)): (sum(mark), brute.sha(bytes(x for x, m in zip(data, mark) if not m)))
                for (i, _), (data, mark) in zip(order, brute.repeated([t for _, t in order]))}
        wants.append(sorted([(i, n, *want[i, n]) for i, n in ((x.doc_id, x.n_bytes) for x in out)], key=repr))
    assert len(out) == 11 and {x.n_removed for x in out if x.doc_id in (None, 3)} == {0}
    assert sorted([(x.doc_id, x.n_bytes, x.n_removed, x.kept_sha256) for x in out], key=repr) in wants
