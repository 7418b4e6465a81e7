"""Quality rules of documents, judged again by host: failures by domain, shrunk, joined back."""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import picked, text_bytes
from plumbline.session import cut_lineage

MIN_WORDS = 50
#: Percent of words in repeated three-word windows above which a document fails.
MAX_REPEAT = 50
#: A host is blocked if its shrunk failure rate reaches this.
HOST_RATE = 0.8

_SPACE = b" \t\n\r\x0b\x0c"
_SYMBOLS = b"#*$%&|<>"
FIELDS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
#: Rules by document whose failures are counted by host. Only the base decides on a document by itself.
RULES = {
    "base": lambda: F.col("base_failed"),
    "few_words": lambda: F.col("n_words") < MIN_WORDS,
    "repeated_words": lambda: 100 * F.col("n_repeat_words") > MAX_REPEAT * F.col("n_words"),
    "odd_words": lambda: (F.col("word_chars") < 2 * F.col("n_words")) | (F.col("word_chars") > 20 * F.col("n_words")),
    "symbols": lambda: 10 * F.col("n_symbols") > 3 * F.col("n_words"),
    "repeated_lines": lambda: 10 * F.col("n_dup_lines") > F.col("n_words"),
}


def repeat_words(words: list[bytes]) -> int:
    """Words inside three-word windows that occur at least twice in the text."""
    windows = list(zip(words, words[1:], words[2:]))
    counts = Counter(windows)
    if len(counts) == len(windows):
        return 0
    total, upto = 0, 0
    for i, w in enumerate(windows):
        if counts[w] > 1:
            total += i + 3 - max(i, upto)
            upto = i + 3
    return total


def measures(text: bytes) -> tuple[int, int, int, int, int]:
    """The values of ``FIELDS`` for a text in UTF-8."""
    words = text.split()
    points = len(text) if text.isascii() else len(text.decode())
    chars = points - (len(text) - len(text.translate(None, _SPACE)))
    symbols = len(text) - len(text.translate(None, _SYMBOLS))
    lines = [x for x in text.split(b"\n") if x.strip()]
    return len(words), chars, symbols, len(lines) - len(set(lines)), repeat_words(words)


def rules(docs: DataFrame, text: str = "text", **keep: str) -> DataFrame:
    """The measures of each whole text and ``base_failed``, with the columns ``keep`` (new name: column).

    A null text counts as empty: no words, so it fails. One row per row of ``docs``.
    """
    @F.arrow_udf("struct<" + ",".join(f"{f}:bigint" for f in FIELDS) + ">")
    def measured(texts: pa.Array) -> pa.Array:
        rows = [measures(t.as_py()) for t in text_bytes(texts)]
        return pa.StructArray.from_arrays([pa.array([r[i] for r in rows], pa.int64()) for i in range(5)], list(FIELDS))

    out = picked(docs, text=text, **keep).select(*keep, measured("text").alias("m")).select(*keep, "m.*")
    return out.withColumn("base_failed", (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT * F.col("n_words")))


@dataclass
class Prior:
    """Beta prior of the hosts' failure rates."""

    a: float
    b: float


def fit_priors(hosts: DataFrame) -> dict[str, Prior]:
    """For each of ``RULES`` the prior of its failure rates, by the method of moments over all hosts.

    Mean and spread of the hosts' rates beyond what counting noise explains; one row comes to the driver. With no host a
    prior is (1, 1); with no extra spread it is the overall rate with the weight of 1000 documents.
    """
    aggs = [F.count(F.lit(1)).alias("k"), F.sum("n").alias("n"), F.avg(1 / F.col("n")).alias("w")]
    for rule in RULES:
        aggs += [F.sum(rule).alias(f"{rule}_f"), F.var_pop(F.col(rule) / F.col("n")).alias(f"{rule}_v")]
    r = hosts.agg(*aggs).first()
    if not r["k"]:
        return {rule: Prior(1.0, 1.0) for rule in RULES}
    out = {}
    for rule in RULES:
        mean = min(max(r[f"{rule}_f"] / r["n"], 1e-6), 1 - 1e-6)
        extra = r[f"{rule}_v"] - mean * (1 - mean) * r["w"]
        weight = min(max(mean * (1 - mean) / extra - 1, 2.0), 1000.0) if extra > 0 else 1000.0
        out[rule] = Prior(mean * weight, (1 - mean) * weight)
    return out


def host_verdicts(judged: DataFrame, host: str = "host", limit: float = HOST_RATE) -> DataFrame:
    """(host, n, rates, blocked_by): each rule's shrunk failure rate, and the rules whose rate reaches the limit.

    Failures are counted by host and rule, and each rule has a prior of its own. Rows with a null host take no part.
    """
    hosts = judged.filter(F.col(host).isNotNull()).groupBy(host).agg(
        F.count(F.lit(1)).alias("n"), *[F.count_if(test()).alias(rule) for rule, test in RULES.items()])
    hosts = cut_lineage(hosts, "hosts")
    priors = fit_priors(hosts)
    rates = F.map_from_arrays(F.array(*map(F.lit, RULES)), F.array(*[(F.col(r) + p.a) / (F.col("n") + p.a + p.b) for r, p in priors.items()]))
    blocked = F.map_keys(F.map_filter("rates", lambda rule, rate: rate >= limit))
    return hosts.select(host, "n", rates.alias("rates")).withColumn("blocked_by", blocked)


def judge(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", host: str = "source", limit: float = HOST_RATE) -> DataFrame:
    """doc_id, host, the measures, base_failed, host_rates, blocked_by and ``kept``: one row per row of ``docs``.

    The measures are taken once and written without the texts. A document is kept if it passes and no rule
    blocks its host; a document with a null host is judged on its own.
    """
    judged = cut_lineage(rules(docs, text, doc_id=doc_id, host=host), "rules")
    verdicts = host_verdicts(judged, "host", limit).select("host", F.col("rates").alias("host_rates"), "blocked_by")
    joined = judged.join(verdicts, "host", "left")
    return joined.select(
        "doc_id", "host", *FIELDS, "base_failed", "host_rates", "blocked_by",
        (~F.col("base_failed") & (F.coalesce(F.size("blocked_by"), F.lit(0)) <= 0)).alias("kept"))
