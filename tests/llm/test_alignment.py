import collections
import hashlib

import pyarrow as pa
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from plumbline.llm import alignment

from corpus_fixtures import make_docs, odd_docs, texts  # noqa: F401

COLUMNS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


class Plain:
    """Whole texts by the libraries, byte ranges from decoded bytes alone, all pairs compared."""

    def __init__(self):
        bpe, pieces = alignment.tokenizer_paths()
        self.a, self.b = Tokenizer.from_file(bpe), sentencepiece.SentencePieceProcessor(model_file=pieces)
        self.a.encode_special_tokens = True
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        self.byte = {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in plain)}

    def tokens(self, text):
        e = self.a.encode(" " + text, add_special_tokens=False)
        a = [(i, bytes(self.byte[c] for c in self.a.id_to_token(i))) for i in e.ids]
        b = []
        for i in self.b.encode(text):
            piece = self.b.id_to_piece(i)
            b.append((i, bytes([int(piece[3:-1], 16)]) if self.b.is_byte(i) else piece.replace("▁", " ").encode()))
        return a, b

    def align(self, text):
        """(A ids, B ids, groups text, links) of a text, or None."""
        if not text:
            return None
        a, b = self.tokens(text)
        want = (" " + text).encode()
        if b"".join(x for _, x in a) != want or b"".join(x for _, x in b) != want:
            return None

        def spans(tokens):
            out, at = [], 0
            for i, x in tokens:
                out.append((i, at, at + len(x)))
                at += len(x)
            return out

        a, b = spans(a), spans(b)
        return len(a), len(b), self.groups(a, b), self.links(a, b)

    def links(self, a, b):
        """By the tokens that cover each byte."""
        of_byte = [k for k, (_, s, e) in enumerate(b) for _ in range(s, e)]
        return [(i, b[k][0]) for i, s, e in a for k in sorted(set(of_byte[s:e]))]

    def groups(self, a, b):
        cuts = {x[2] for x in a} & {y[2] for y in b}

        def parts(tokens):
            out = [[]]
            for i, _, e in tokens:
                out[-1].append(str(i))
                if e in cuts:
                    out.append([])
            return out[:-1]

        return [",".join(x) + "|" + ",".join(y) for x, y in zip(parts(a), parts(b), strict=True)]


@pytest.fixture(scope="module")
def plain():
    return Plain()


@pytest.fixture(scope="module")
def aligner():
    return alignment.Aligner(*alignment.tokenizer_paths())


def wanted(plain, docs):
    found = [(i, plain.align(t)) for i, t in docs]
    counts = collections.Counter(x for _, f in found if f for x in f[3])
    best = collections.Counter()
    for (_, b), n in counts.items():
        best[b] = max(best[b], n)
    out = []
    for i, f in found:
        if f is None:
            out.append((i, 0, 0, 0, 0, 0, 0, ""))
        else:
            n_a, n_b, groups, links = f
            out.append((i, n_a, n_b, len(groups), len(links), sum(counts[x] == best[x[1]] for x in links), sum(counts[x] for x in links),
                        hashlib.sha256(";".join(groups).encode()).hexdigest()))
    return sorted(out, key=repr)


def got(df):
    assert df.columns == COLUMNS
    return sorted((tuple(r) for r in df.collect()), key=repr)


@settings(max_examples=400, deadline=None)
@given(st.text(st.sampled_from("ab cde  \n\t.,'s<|endoftext|>1234éß中😀𝔘▁\x00  ́ا"), max_size=40))
def test_chunks_give_the_whole_text(text):
    plain, aligner = Plain.kept, Aligner.kept
    want = plain.align(text)
    if not text:
        assert want is None and not aligner.chunks(text)
        return
    found = aligner.align(aligner.chunks(text))
    if want is None:
        assert not found.whole.all()
        return
    assert found.whole.all()
    assert (found.n_a.sum(), found.n_b.sum(), found.n_groups.sum(), found.n_links.sum()) == (*want[:2], len(want[2]), len(want[3]))
    assert ";".join(found.groups) == ";".join(want[2])
    assert sorted(divmod(int(x), 1 << 32) for x in found.links) == sorted(want[3])
    assert len(found.links) == found.n_links.sum()


class Aligner:
    kept = None


@pytest.fixture(autouse=True)
def keep(plain, aligner):
    Plain.kept, Aligner.kept = plain, aligner


def test_special_strings_are_text(aligner):
    assert aligner.align(["<|endoftext|>"]).n_a[0] > 1


def test_characters_in_several_tokens(aligner):
    one = aligner.align(["𝔘"])  # A cuts its four bytes, B writes each as a byte token
    assert one.whole[0] and one.n_b[0] >= 4 and one.n_groups[0] >= 1


def test_a_chunk_that_does_not_join_spoils_no_other(aligner):
    found = aligner.align(["one", "▁", "two"])
    assert found.whole.tolist() == [True, False, True] and found.groups[1] == ""


@pytest.mark.parametrize("shard_bytes", [alignment.SHARD_BYTES, 2000])
def test_query_by_brute_force(spark, make_docs, texts, plain, shard_bytes):
    docs = [(i, t) for i, t, *_ in texts]
    assert got(alignment.align(make_docs(docs).repartition(3), shard_bytes=shard_bytes)) == wanted(plain, docs)


def test_odd_rows(odd_docs, plain):
    docs = [(r.doc_id, r.text) for r in odd_docs.collect()]
    clash = odd_docs.withColumnRenamed("lang", "shard").withColumnRenamed("source", "kind")
    assert got(alignment.align(clash)) == wanted(plain, docs)
    assert alignment.align(odd_docs.filter("false")).count() == 0


def test_small_memory_gives_the_same(make_docs, aligner):
    sharder = alignment.Sharder(aligner, remembered=1)
    first = sharder.shard(0, pa.array([1, 2]), ["a b a", None])
    assert not sharder.known
    assert sharder.shard(0, pa.array([1, 2]), ["a b a", None]).equals(first)


def test_white_space_at_the_edges_of_neighbours(make_docs, plain):
    docs = list(enumerate(["foo\n", "\nbar", "foo ", "bar", " bar", "\n", " ", "a \n", "\t b", "foo\n ", "  bar ", "é \n中", "end."]))
    assert got(alignment.align(make_docs(docs).coalesce(1))) == wanted(plain, docs)


def test_chunks_met_often_stay_remembered(aligner):
    sharder, fresh = alignment.Sharder(aligner, remembered=4), alignment.Sharder(aligner)
    ids = pa.array([1, 2])
    sharder.shard(0, ids, ["often one often twice", "two é twice three four"])
    assert list(sharder.known) == ["often", "twice"]
    texts = ["twice five often\nsix  twice", "often ▁ one"]  # the second doesn't join
    assert sharder.shard(0, ids, texts).column("groups_sha256").equals(fresh.shard(0, ids, texts).column("groups_sha256"))
    sharder.shard(0, ids, ["seven often", "eight nine ten"])
    want, other = sharder.shard(0, ids, texts), fresh.shard(0, ids, texts)
    for k in ("n_a", "n_b", "n_groups", "n_links", "groups_sha256"):
        assert want.column(k).equals(other.column(k))
    pairs = [dict(zip(b.column("pairs")[0].as_py(), b.column("times")[0].as_py())) for b in (want, other)]
    assert pairs[0] == pairs[1] and pairs[0]


def test_groups_of_texts_that_end_with_the_shard(aligner, monkeypatch):
    ids, texts = pa.array([1, 2, 3]), ["one two", None, "two three"]
    want = alignment.Sharder(aligner).shard(0, ids, texts)
    monkeypatch.setattr(alignment, "GROUP_CHARS", 7)
    assert alignment.Sharder(aligner).shard(0, ids, texts).equals(want)
