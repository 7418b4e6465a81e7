import pytest

from plumbline.llm import url_filter as U
from plumbline.llm.queries import RULES

PAGES = "page_id bigint, url string"
URLS = [
    (1, "https://Example.COM/en/a"), (2, "http://www.example.com/en/a?b#c"), (3, "http://x.www.example.com/en/"), (4, "http://a.net/es/x"),
    (5, "http://net/es/"), (6, "http://anet/es/"), (7, "http://a.com"), (8, "http://a.com/"), (9, None), (10, "no scheme"), (11, ""),
    (12, "http://b.org/p/?utm_source=x&q=1#top"), (13, "https://B.org/p?q=1"), (14, "http://b.org/p?q=2"), (15, "http://c.org?x://y/z"), (15, "http://c.org?x://y/z")]


def test_parts_rules_and_list(spark):
    pages = spark.createDataFrame(URLS, PAGES)
    listed = spark.createDataFrame([("http://b.org/p?q=1",), (None,), ("nothing",)], "url string")
    out = {r.page_id: r for r in U.judge(pages, RULES, listed).collect()}
    assert [(out[i].host, out[i].path) for i in (1, 2, 9, 10, 11, 15)] == [
        ("example.com", "/en/a"), ("www.example.com", "/en/a"), ("", ""), ("", ""), ("", ""), ("c.org", "")]
    assert [out[i].rule for i in range(1, 10)] == [
        "example.com/en/", "www.example.com/en/", "www.example.com/en/", "net/es/", "net/es/", None, None, "com/", None]
    assert [out[i].verdict for i in range(1, 10)] == ["block", "allow", "allow", "block", "block", "allow", "allow", "allow", "allow"]
    assert [out[i].verdict for i in (12, 13, 14)] == ["block", "block", "allow"]
    assert U.judge(pages, RULES, listed).count() == len(URLS)
    assert U.judge(pages, RULES, listed.filter("false")).filter("listed").count() == 0
    assert U.judge(pages.filter("false"), RULES, listed).count() == 0


@pytest.mark.parametrize("limit", [0, 1 << 18])
def test_filter_loses_nothing_and_join_removes_false_hits(spark, monkeypatch, limit):
    monkeypatch.setattr(U, "BROADCAST_BLOCKS", limit)
    pages = spark.range(4000).selectExpr("id as page_id", "concat('http://h', id % 7, '.org/', id) as url", "id as host", "'x' as canonical")
    out = U.judge(pages, [], pages.filter("page_id % 3 = 0"))
    assert out.filter("listed <> (page_id % 3 = 0)").count() == 0 and out.count() == 4000


def test_bloom_filter_rarely_passes_others(spark):
    listed = spark.range(3000).selectExpr("concat('u', id) as canonical")
    blocks = -(-3000 // U.URLS_PER_BLOCK)
    bits = U.bloom_filter(listed, "canonical", blocks)
    other = spark.range(3000, 9000).selectExpr("concat('u', id) as c")
    probe = other.withColumn("block", U._block(other.c, blocks)).join(bits, "block")
    for i, m in enumerate(U._masks(other.c)):
        probe = probe.filter(probe[f"w{i}"].bitwiseAND(m) == m)
    assert probe.count() < 0.05 * 6000


def test_no_python_on_the_main_path(spark):
    pages = spark.createDataFrame(URLS, PAGES)
    plan = U.judge(pages, RULES, pages)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Cartesian" not in plan
