import brute
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from plumbline.llm import pii

from corpus_fixtures import make_docs, odd_docs, rows, texts  # noqa: F401


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet="a@.1-+ (5é_0", max_size=60))
def test_base_is_what_the_patterns_find(text):
    assert pii.base_spans(text) == brute.pii_base(text)


@pytest.mark.parametrize("text,kind,span", [
    ("mail john [at] example (dot) com now", "email", "john [at] example (dot) com"),
    ("jane dot doe at mail dot example dot org.", "email", "jane dot doe at mail dot example dot org"),
    ("call plus one two one two five five five one two three four please", "phone", "plus one two one two five five five one two three four"),
    ("jоhn@exаmple.com", "email", "jоhn@exаmple.com"),
    ("ｊｏ＠ｅx.com", "email", "ｊｏ＠ｅx.com"),
    ("card 4 zero 6 8 five 1 six 8 9 two 5 0 five 4 6 8 x", "card", "4 zero 6 8 five 1 six 8 9 two 5 0 five 4 6 8"),
    ("jo​e@ex.com", "email", "jo​e@ex.com"),
])
def test_disguises_map_back_to_the_source(text, kind, span):
    at = text.index(span)
    assert (kind, at, at + len(span)) in pii.all_spans(text)


@pytest.mark.parametrize("text,kind,span", [
    ("host 192 dot 168 dot 1 dot 10 is up", "ip", "192 dot 168 dot 1 dot 10"),
    ("host 192[.]168[.]1[.]10 is up", "ip", "192[.]168[.]1[.]10"),
    ("host one nine two dot one six eight dot one dot one zero is up", "ip", "one nine two dot one six eight dot one dot one zero"),
    ("escribe a juan arroba ejemplo punto com hoy", "email", "juan arroba ejemplo punto com"),
    ("jean point petit arobase exemple point fr, merci", "email", "jean point petit arobase exemple point fr"),
    ("an hans punkt klein at beispiel punkt de, danke", "email", "hans punkt klein at beispiel punkt de"),
    ("to joe[@]example[.]com now", "email", "joe[@]example[.]com"),
    ("ask john dot doe at example.com now", "email", "john dot doe at example.com"),
    ("ask john dot doe@example.com now", "email", "john dot doe@example.com"),
    ("see a dot b dot c dot d dot e dot f at x dot com, ok", "email", "a dot b dot c dot d dot e dot f at x dot com"),
    ("see a at " + " dot ".join("bcdefghijklmnop") + " dot com, ok", "email", "a at " + " dot ".join("bcdefghijklmnop") + " dot com"),
    ("pin (four zero six eight five one six eight nine two five zero five four six eight)", "card",
     "four zero six eight five one six eight nine two five zero five four six eight"),
    ("call:plus one;plus one two one two five five five one two three four", "phone", "plus one two one two five five five one two three four"),
])
def test_whole_disguises(text, kind, span):
    at = text.index(span)
    assert (kind, at, at + len(span)) in pii.all_spans(text)


@pytest.mark.parametrize("text", [
    "we were at some point in doubt", "look at example.com", "the point is at example.com", "un punto y otro punto", "1 point 5 and 2 dot 3",
    "the point made at this point we know"])
def test_words_that_are_no_disguise(text):
    assert pii.all_spans(text) == []


def test_long_disguises_take_linear_time():
    for text in ("a dot " * 100_000, "a at b dot " * 50_000, "x " + " " * 200_000 + "[", "1 dot " * 100_000, "one dot " * 50_000, "( " * 100_000):
        pii.all_spans(text)


@pytest.mark.parametrize("text", ["see you at noon. A dot is small", "one two three", "meet at example dot", "", "null acht"])
def test_ordinary_text_stays(text):
    assert pii.all_spans(text) == []


def test_base_spans_stay_beside_disguised_ones():
    text = "a@b.cc and john [at] example [dot] com"
    assert [text[a:b] for _, a, b in pii.all_spans(text)] == ["a@b.cc", "john [at] example [dot] com"]


def test_long_runs_take_linear_time():
    assert pii.all_spans("a" * 200_000 + "@" + "b" * 200_000) == []
    assert pii.all_spans("1" * 200_000 + "." * 1000) == []


def test_query_rows(make_docs, texts, odd_docs):
    docs = make_docs(texts)
    for r in pii.digests(docs).collect():
        text = dict((i, t) for i, t, *_ in texts)[r.doc_id]
        base = brute.pii_base(text)
        assert r.base_sha256 == brute.sha(pii.joined(base).encode()) and r.n_email == sum(k == "email" for k, *_ in base)
    assert pii.digests(odd_docs).count() == odd_docs.count()
    assert pii.digests(odd_docs.filter("false")).count() == 0


def test_redaction_keeps_columns_and_rows(make_docs, odd_docs):
    docs = make_docs([(1, "write a@b.cc or call +1 (017) 555-7713 now"), (2, None), (3, "clean")])
    out = {r.doc_id: r for r in pii.redacted(docs).collect()}
    assert out[1].text == "write <EMAIL> or call <PHONE> now" and out[1].n_chars == len(out[1].text)
    assert out[2].text is None and out[3].text == "clean"
    assert pii.redacted(odd_docs).columns == odd_docs.columns and pii.redacted(odd_docs).count() == odd_docs.count()
    clash = docs.withColumn("clean", docs.doc_id)
    assert rows(pii.redacted(clash), "clean") == [(1,), (2,), (3,)]
