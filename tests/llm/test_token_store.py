import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from plumbline.llm import token_store as S
from plumbline.session import scratch_path

from corpus_fixtures import make_docs, odd_docs, rows, texts  # noqa: F401

WORDS = Tokenizer.from_file(S.tokenizer_path())
CHUNKS = S.ChunkEncoder(S.tokenizer_path(), remembered=50)


def plain(text):
    return WORDS.encode(text, add_special_tokens=False).ids


@settings(max_examples=500, deadline=None)
@given(st.one_of(st.text(max_size=60), st.text(alphabet="aAÉéßΣİı'sd .,!<|>\n\t\x1c\u00a0\u0301ﬁ1½", max_size=60)))
def test_chunks_give_the_ids_of_the_whole_text(text):
    assert np.frombuffer(CHUNKS.encode(text), "<u4").tolist() == plain(text)


CASED = st.sampled_from(["<|endoftext|>", "<|startoftext|>"]).flatmap(
    lambda t: st.lists(st.booleans(), min_size=len(t), max_size=len(t)).map(lambda up: "".join(c.upper() if u else c for c, u in zip(t, up))))


@settings(max_examples=500, deadline=None)
@given(st.lists(st.one_of(CASED, st.sampled_from(["a", "B", " ", "\n", "é", "İ", "Σ", "<|", "|>", "<", "e\u0301", "\u212a", "text|>", "<|endof", "<|endoftext|>"])), max_size=10).map("".join))
def test_special_tokens_in_any_casing(text):
    assert np.frombuffer(CHUNKS.encode(text), "<u4").tolist() == plain(text)


@pytest.mark.parametrize("text", ["<|endoftext|> a<|startoftext|>b", "it's we'll THEY'RE 's", "a" * 5000, "Straße GRÖSSE ÀÉ"])
def test_special_cases(text):
    assert np.frombuffer(CHUNKS.encode(text), "<u4").tolist() == plain(text)


@pytest.fixture(scope="module")
def stored(spark, make_docs, texts):
    path = scratch_path(spark, "tokens-test")
    S.write(make_docs(texts).repartition(7), path, S.tokenizer_path(), partitions=4)
    return path


def test_round_trip_in_order_of_id(spark, texts, stored):
    at = 0
    out = {r.doc_id: r for r in S.digests(S.read(spark, stored)).collect()}
    for i, t, *_ in sorted(texts):
        ids = plain(t) + [2]
        assert (out[i].start, out[i].n_tokens, out[i].ids_crc32) == (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)


def test_chosen_documents_keep_their_starts(spark, stored):
    every = {r.doc_id: r.start for r in S.read(spark, stored).collect()}
    low, high = sorted(every)[20], sorted(every)[30]
    assert {r.doc_id: r.start for r in S.read(spark, stored, low, high).collect()} == {i: s for i, s in every.items() if low <= i <= high}
    assert [(r.doc_id, r.start) for r in S.read(spark, stored, ids=[low]).collect()] == [(low, every[low])]
    plan = S.read(spark, stored, ids=[low])._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [" in plan and "EqualTo(doc_id" in plan or "In(doc_id" in plan


def test_files_are_sorted_runs(spark, stored):
    parts = spark.read.orc(stored).groupBy("part").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b")).orderBy("part").collect()
    assert len(parts) > 1 and all(x.b < y.a for x, y in zip(parts, parts[1:]))


def test_defined_results(odd_docs):
    out = S.round_trip(odd_docs)
    assert out.count() == odd_docs.count()
    empty = zlib.crc32(np.array([2], "<u4").tobytes())
    assert rows(out.filter("doc_id in (1, 2, 3)"), "n_tokens", "ids_crc32") == [(1, empty)] * 3
    starts = sorted((r.start, r.n_tokens) for r in out.collect())
    assert all(a + n == b for (a, n), (b, _) in zip(starts, starts[1:])) and starts[0][0] == 0
    assert S.round_trip(odd_docs.filter("false")).count() == 0
    clash = odd_docs.withColumn("part", F.lit(1)).withColumn("ids", F.lit("x"))
    assert S.round_trip(clash).count() == odd_docs.count()
