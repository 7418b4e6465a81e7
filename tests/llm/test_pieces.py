import collections
import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from plumbline.llm import pieces as P

from corpus_fixtures import make_docs, odd_docs, rows, texts  # noqa: F401

MODEL = P.Pieces(P.model_path())


def encoded(texts, keys):
    ids, counts = P.encode(MODEL, texts, np.array(keys, np.uint64))
    at = np.concatenate([[0], np.cumsum(counts)])
    return [ids[a:b].tolist() for a, b in zip(at, at[1:])]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.one_of(st.text(max_size=30), st.text(alphabet=" a▁\n\té中😀", max_size=40)), min_size=1, max_size=5))
def test_decoding_is_lossless(texts):
    for t, ids in zip(texts, encoded(texts, range(len(texts)))):
        assert MODEL.decode(ids) == t


def test_samples_follow_the_weights():
    known = {b.decode(): i for i, b in enumerate(MODEL.bytes) if b and not (len(b) == 1 and MODEL.byte_ids[b[0]] == i)}

    def all_of(s):
        if not s:
            yield ()
        for k in range(1, len(s) + 1):
            if s[:k] in known:
                for r in all_of(s[k:]):
                    yield (known[s[:k]], *r)

    weight = {x: math.exp(sum(MODEL.weight[i] for i in x)) for x in all_of(" hello")}
    n = 20_000
    got = collections.Counter(map(tuple, encoded(["hello"] * n, range(n))))
    assert set(got) <= set(weight)
    assert max(abs(got[x] / n - w / sum(weight.values())) for x, w in weight.items()) < 0.015


def test_keys_alone_decide():
    texts = ["some words of a text", "other words", "some words of a text"]
    alone = [encoded([t], [k])[0] for t, k in zip(texts, (3, 4, 3))]
    assert encoded(texts, (3, 4, 3)) == alone and alone[0] == alone[2]
    assert len({tuple(encoded([texts[0]], [k])[0]) for k in range(20)}) > 5


def test_long_chunks_do_not_underflow():
    text = "ab" * 20_000
    assert MODEL.decode(encoded([text], [1])[0]) == text


def test_query_and_partitioning(make_docs, texts):
    docs = make_docs(texts)
    one = rows(P.digests(docs.repartition(5)))
    assert one == rows(P.digests(docs.coalesce(1)))
    assert all(lossless for *_, lossless in one)
    out = P.sampled(docs)
    back = out.select("doc_id", "text", P.decode_column(P.model_path())("piece_ids").alias("back"))
    assert back.filter("text <> back").count() == 0


def test_defined_results(odd_docs):
    out = P.digests(odd_docs)
    assert out.count() == odd_docs.count() and out.filter("not lossless").count() == 0
    assert rows(out.filter("doc_id in (1, 2)"), "n_pieces") == [(0,)] * 2
    assert len(set(rows(out.filter("doc_id = 6")))) == 1
    assert P.digests(odd_docs.filter("false")).count() == 0
    clash = P.sampled(odd_docs.withColumn("piece_ids", F.lit(1)))
    assert clash.columns[-2:] == ["piece_ids", "_piece_ids"]


def test_a_model_without_byte_pieces_is_refused(monkeypatch):
    import sentencepiece

    monkeypatch.setattr(sentencepiece.SentencePieceProcessor, "is_byte", lambda self, i: False)
    with pytest.raises(ValueError):
        P.Pieces(P.model_path())


def test_a_lossy_row_fails(make_docs, monkeypatch):
    from plumbline.llm import pieces

    docs = make_docs([(1, "one two"), (2, None), (3, "")])
    assert sorted(len(r.piece_ids) > 0 for r in pieces.sampled(docs, verify=True).collect()) == [False, False, True]
    broken = pieces.encode_column(pieces.model_path(), verify=True).func
    monkeypatch.setattr(pieces.Pieces, "decode", lambda self, ids: "other")
    with pytest.raises(ValueError, match="decode"):
        import pyarrow as pa
        list(broken(iter([(pa.array(["one two"]), pa.array([1]))])))


def test_remembered_lattices_give_the_same():
    texts = ["often one often twice 中😀", "", "two twice three\n\n often  four é"] * 2 + ["often five 中😀 😀", "six twice", "ab" * 50 + " often"]
    wanted = [encoded([t], [k])[0] for k, t in enumerate(texts)]
    for limit in (0, 20, 60, 10**6):
        kept = P.Remembered(MODEL, limit)
        for k, t in enumerate(texts):
            assert P.encode(MODEL, [t], np.array([k], np.uint64), kept)[0].tolist() == wanted[k]
        assert kept.n_places == sum(map(len, kept.known)) and kept.last[-1] == kept.n_places - 1


def test_frequent_chunks_get_one_lattice(monkeypatch):
    built = []

    class Counted(P.Lattice):
        def __init__(self, pieces, chunks):
            built.extend(chunks)
            super().__init__(pieces, chunks)

    monkeypatch.setattr(P, "Lattice", Counted)
    monkeypatch.setattr(P, "LATTICE_BYTES", 40)
    import pyarrow as pa

    texts = [f"often again word{k} once{k}" for k in range(50)]
    kept = P.Remembered(MODEL, 200)
    list(P._encoded(MODEL, pa.array(texts), pa.array(range(50)), kept))
    assert built.count(" often") == built.count(" again") == 1 and kept.n_places < 400
