import brute
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from plumbline.llm import quality

from corpus_fixtures import make_docs, odd_docs, rows, texts  # noqa: F401


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="ab \n\t#é\x1c\x85", max_size=80))
def test_measures_by_brute_force(text):
    assert quality.measures(text.encode()) == brute.measures(text)


def test_rows_of_the_sample(make_docs, texts):
    out = {r.doc_id: r for r in quality.judge(make_docs(texts)).collect()}
    assert len(out) == len(texts)
    for i, t, *_ in texts:
        e = brute.measures(t)
        assert tuple(out[i][f] for f in quality.FIELDS) == e
        assert out[i].base_failed == (e[0] < 50 or 100 * e[4] > 50 * e[0])
        assert out[i].kept == (not out[i].base_failed)  # no host of the sample is bad


def test_a_bad_host_takes_its_passing_documents_with_it(make_docs):
    good = " ".join(f"word{i}" for i in range(60))
    docs = [(i, good, None, f"host{i % 40}") for i in range(4000)]
    docs += [(10_000 + i, "short", None, "bad") for i in range(500)] + [(20_000, good, None, "bad"), (20_001, good, None, None)]
    docs += [(30_000, "short", None, "tiny"), (30_001, good, None, "tiny")]
    out = {r.doc_id: r for r in quality.judge(make_docs(docs)).collect()}
    assert not out[20_000].kept and not out[20_000].base_failed
    assert out[20_001].kept and out[5].kept
    assert out[30_001].kept and 0 < out[30_001].host_rates["base"] < 0.8  # one failure of two is shrunk
    assert set(out[20_000].blocked_by) == {"base", "few_words"} and out[20_001].host_rates is None


def brute_verdicts(docs, limit):
    """Kept documents and blocking rules, with counts, moments and rates in plain Python."""
    tests = {
        "base": lambda n, c, s, d, r: n < 50 or 100 * r > 50 * n, "few_words": lambda n, c, s, d, r: n < 50, "repeated_words": lambda n, c, s, d, r: 100 * r > 50 * n,
        "odd_words": lambda n, c, s, d, r: c < 2 * n or c > 20 * n, "symbols": lambda n, c, s, d, r: 10 * s > 3 * n, "repeated_lines": lambda n, c, s, d, r: 10 * d > n}
    measured = [(i, h, brute.measures(t or "")) for i, t, _, h in docs]
    hosts = sorted({h for _, h, _ in measured if h is not None})
    blocked = {h: set() for h in hosts}
    for rule, test in tests.items():
        n = {h: sum(x[1] == h for x in measured) for h in hosts}
        f = {h: sum(x[1] == h and test(*x[2]) for x in measured) for h in hosts}
        rates = [f[h] / n[h] for h in hosts]
        mean = min(max(sum(f.values()) / sum(n.values()), 1e-6), 1 - 1e-6)
        spread = sum((r - sum(rates) / len(rates)) ** 2 for r in rates) / len(rates) - mean * (1 - mean) * sum(1 / n[h] for h in hosts) / len(hosts)
        weight = min(max(mean * (1 - mean) / spread - 1, 2.0), 1000.0) if spread > 0 else 1000.0
        for h in hosts:
            if (f[h] + mean * weight) / (n[h] + weight) >= limit:
                blocked[h].add(rule)
    return {i: (not tests["base"](*m) and not blocked.get(h), blocked.get(h)) for i, h, m in measured}


def test_hosts_by_rule_by_brute_force(make_docs):
    good = " ".join(f"word{i}" for i in range(60))
    forms = [good, "short", "again and " * 40, "# " * 60 + good[:80], " ".join("x" * 30 + str(i) for i in range(55)), "a line\n" * 30 + good]
    docs = []
    for h in range(30):
        for k in range(1 + h % 7 * 6):
            docs.append((len(docs), forms[h % 6] if (k * 7 + h) % 10 < 9 - h % 3 else good, None, f"h{h}" if h != 5 else None))
    out = {r.doc_id: r for r in quality.judge(make_docs(docs).repartition(3), limit=0.6).collect()}
    want = brute_verdicts(docs, 0.6)
    for i, (kept, blocked) in want.items():
        assert out[i].kept == kept and (None if out[i].blocked_by is None else set(out[i].blocked_by)) == blocked
    assert len({tuple(sorted(b)) for _, b in want.values() if b}) >= 4  # several rules block, each some hosts


def test_prior(spark):
    schema = "host string, n bigint, " + ", ".join(f"{r} bigint" for r in quality.RULES)
    even = quality.fit_priors(spark.createDataFrame([("a", 100, 10, 20, 0, 0, 0, 0), ("b", 100, 10, 20, 0, 0, 0, 0)], schema))
    assert even["base"].a / (even["base"].a + even["base"].b) == pytest.approx(0.1) and even["base"].a + even["base"].b == pytest.approx(1000)
    assert even["few_words"].a == pytest.approx(200)
    assert all(p == quality.Prior(1.0, 1.0) for p in quality.fit_priors(spark.createDataFrame([], schema)).values())


def test_defined_results(odd_docs):
    assert quality.judge(odd_docs).count() == odd_docs.count()
    assert rows(quality.judge(odd_docs).filter("n_words = 0"), "kept") == [(False,)] * 4
    assert quality.judge(odd_docs.filter("false")).count() == 0
