import brute
import compare
import pytest

import __spark_entry__ as entry_module
import corpus_pipeline
from plumbline.llm import decontaminate, language, pieces, pii
from plumbline.llm.queries import ORACLES, QUERIES

from corpus_fixtures import make_docs, odd_docs, rows, texts  # noqa: F401
from test_near_copies import wanted as near_wanted


def test_every_operator_has_its_query():
    assert sorted(int(q[2:].split("_")[0]) for q in QUERIES) == list(range(1, 14))
    assert {*QUERIES, "pipeline"} <= set(entry_module.queries())
    assert set(corpus_pipeline.ORACLES) <= set(corpus_pipeline.QUERIES)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_sql(name, spark, root):
    assert compare.difference(QUERIES[name](spark, root), compare.connect(root), ORACLES[name]) is None


def test_run_by_brute_force(spark, root, make_docs, texts):
    model = language.Classifier(language.train(make_docs(texts)))
    kept = [(i, t) for i, t, *_ in texts if language.has_letter(t) and model.predict(t)[1] >= language.MARGIN]
    first = set(near_wanted(kept))
    kept = [x for x in kept if x[0] in first]
    items = [tuple(r) for r in spark.read.parquet(f"{root}/benchmark.parquet").select("item_id", "text").collect()]
    kept = [(i, t) for i, t in kept if not brute.contamination(t, items)[1]]
    want = {i: pii.redact(t, pii.all_spans(t)) for i, t in kept}
    out = corpus_pipeline.run(spark, root)
    assert out.columns == ["doc_id", "text", "lang", "source", "n_chars", "piece_ids"]
    rows = {r.doc_id: r for r in out.collect()}
    assert {i: r.text for i, r in rows.items()} == want
    decode = pieces.Pieces(pieces.model_path()).decode
    assert all(decode(r.piece_ids) == r.text and r.n_chars == len(r.text) for r in rows.values())


def test_stages_keep_the_columns_of_documents(spark, root, odd_docs):
    docs = odd_docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, root)
        assert docs.dtypes == odd_docs.dtypes
    empty = odd_docs.filter("false")
    for _, stage in corpus_pipeline.STAGES:
        empty = stage(spark, empty, root)
    assert empty.count() == 0


def test_window_of_the_benchmark():
    assert decontaminate.WINDOW == 10
