import zlib

import pytest
from pyspark.sql import functions as F

from plumbline.llm import language

from corpus_fixtures import make_docs, odd_docs, rows, texts  # noqa: F401


@pytest.fixture(scope="module")
def model(make_docs, texts):
    return language.train(make_docs(texts))


def test_held_out_accuracy(make_docs, texts, model):
    out = {r.doc_id: r for r in language.predict(make_docs(texts), model).select("doc_id", "language.*").collect()}
    kept = [t for t in texts if zlib.crc32(str(t[0]).encode()) % 4 == 2]
    assert sum(out[i].lang_pred == lang for i, _, lang, _ in kept) >= 0.95 * len(kept)
    assert all(0 <= r.score <= 1 for r in out.values())


def test_only_the_text_decides(make_docs, texts, model):
    some = [(i, t) for i, t, *_ in texts[:30]]
    one = rows(language.predict(make_docs(some), model).select("language.*"))
    other = rows(language.predict(make_docs([(i + 1000, t, "de", "x") for i, t in some]), model).select("language.*"))
    assert one == other


def test_training_leaves_out_held_out_rows(make_docs):
    out_id = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 4 == 2)
    docs = make_docs([(out_id, "held out words", "zz"), (None, "no id", "yy"), (None, None, "xx")])
    assert language.train(docs) == {}


def test_defined_results(odd_docs, model):
    out = language.predict(odd_docs, model).select("doc_id", "text", "language.*").collect()
    assert len(out) == odd_docs.count()
    for r in out:
        if not r.text or not any(map(str.isalpha, r.text)):
            assert (r.lang_pred, r.score, r.accepted) == ("und", 0.0, False)
        else:
            assert r.lang_pred in model
    assert language.Classifier(model).predict("123 45.") == ("und", 0.0)
    assert language.predict(odd_docs, {}).filter("language.lang_pred <> 'und'").count() == 0
    assert language.predict(odd_docs, {"en": b"the and of to in"}).filter("language.score > 1").count() == 0
    assert language.predict(odd_docs.filter("false"), model).count() == 0


def test_clashing_names_and_columns_stay(make_docs, texts):
    docs = make_docs(texts).withColumn("language", F.lit("mine"))
    kept = language.accepted(docs)
    assert kept.columns == docs.columns
    assert kept.select("language").distinct().collect()[0][0] == "mine"
    assert kept.count() >= 0.97 * docs.count()


def test_a_common_id_gives_one_text(make_docs):
    """An id of a hundred thousand rows, in a table of few others."""
    spark = make_docs([]).sparkSession
    ids = [i for i in range(400) if zlib.crc32(str(i).encode()) % 4 != 2][:60]
    few = make_docs([(i, f"word{i} " * 20, "en", "a") for i in ids[1:]])
    many = spark.range(100_000).selectExpr(f"{ids[0]}L as doc_id", "concat('common', id % 7) as text", "'en' as lang", "'a' as source", "1L as n_chars")
    model = language.train(few.unionByName(many))
    assert model["en"].count(b"common") == 1 and len(model["en"]) < 60 * 250
    assert model == language.train(many.unionByName(few).repartition(5))


def plain_prediction(text, dictionaries):
    """Sizes by zstandard piece by piece, without the operator's class."""
    import zstandard
    if not text or not any(c.isalpha() for c in text) or not dictionaries:
        return "und", 0.0
    data = " ".join("".join(c if c.isalpha() or ord(c) > 127 else " " for c in text.lower()).split()).encode()
    sizes = []
    for lang, content in dictionaries.items():
        d = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        c = zstandard.ZstdCompressor(level=language.LEVEL, dict_data=d, write_checksum=False, write_content_size=False, write_dict_id=False)
        sizes.append((sum(len(c.compress(data[k:k + language.PIECE])) for k in range(0, len(data), language.PIECE)), lang))
    best, second = sorted(sizes)[:2]
    return best[1], 1 - best[0] / second[0]


def test_query_by_brute_force(spark, make_docs, texts, model):
    some = [(i, t) for i, t, *_ in texts]
    out = {r.doc_id: r for r in language.predict(make_docs(some), model).select("doc_id", "language.*").collect()}
    wrong = [i for i, t in some if (out[i].lang_pred, round(out[i].score, 9)) != (plain_prediction(t, model)[0], round(plain_prediction(t, model)[1], 9))]
    assert not wrong
