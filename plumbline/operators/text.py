"""Audits of text corpora."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from plumbline.functions import fixed_values as V
from plumbline.functions import predicates as P
from plumbline.operators.spread import first_per_group, keyed_filter, sent_or_merged, top_per_group
from plumbline.session import cut_lineage

PatternRule = tuple[str, str, str | None]


def pattern_audit(df: DataFrame, text: str, rules: Iterable[PatternRule], lower: bool = True) -> DataFrame:
    """One row per (record, rule) hit; every rule is evaluated in the same scan of the text.

    Columns other than ``text`` are kept. A rule is (id, pattern, pattern that clears it or None).
    """
    subject = F.lower("_subject") if lower else F.col("_subject")
    hits = []
    for rule_id, pattern, negated in rules:
        cond = F.col("_t").rlike(pattern)
        if negated:
            cond = cond & ~F.col("_t").rlike(negated)
        hits.append(F.when(cond, F.lit(rule_id)))
    keep = [c for c in df.columns if c != text]
    return (
        df.select(*keep, F.col(text).alias("_subject")).withColumn("_t", subject)
        .select(*keep, F.explode(F.array_compact(F.array(*hits))).alias("rule_id"))
    )


def occurrence_audit(df: DataFrame, text: str, rules: Iterable[tuple[str, str, int]]) -> DataFrame:
    """Records in which a pattern occurs more than the allowed number of times."""
    keep = [c for c in df.columns if c != text]
    cells = F.array(*[
        F.struct(F.lit(rule_id).alias("rule_id"), F.regexp_count(F.col("_t"), F.lit(pattern)).alias("n_hits"),
                 F.lit(limit).alias("allowed")) for rule_id, pattern, limit in rules])
    return (
        df.select(*keep, F.lower(text).alias("_t")).select(*keep, F.inline(cells))
        .filter(F.col("n_hits") > F.col("allowed")).drop("allowed")
    )


# what counts as white space, beyond ASCII too
WHITE_SPACE = (
    " \t\n\r\f\v\u00A0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200A"
    "\u2028\u2029\u202F\u205F\u3000\uFEFF"
)


def normalized(text: Column) -> Column:
    """Lower case without white space; a character table is several times faster here than a pattern."""
    return F.translate(F.lower(text), WHITE_SPACE, "")


def normalized_duplicates(df: DataFrame, record: str, text: str, min_len: int = 5) -> DataFrame:
    """Groups of records whose texts agree up to case and white space.

    Grouped by a digest of the whole normalised text, so texts are not shuffled.
    """
    norm = normalized(F.col(text))
    return (
        df.select(record, norm.alias("_n")).filter(F.length("_n") > min_len)
        .groupBy(F.sha2("_n", 256).alias("digest"))
        .agg(F.count(F.lit(1)).alias("n_records"), F.min(record).alias("first_record"))
        .filter("n_records > 1")
    )


def alias_records(df: DataFrame, record: str, name: str, reference: Column | None = None) -> DataFrame:
    """Records that merely repeat another one.

    With ``reference`` (an expression such as the text between brackets) a record is an
    alias when it names another record; without it, when an earlier record has its name.
    """
    if reference is not None:
        # written, so that the join meets a plain table and a hot name can be split
        names = cut_lineage(df.groupBy(F.col(name).alias("_target")).agg(F.min(record).alias("target_record")), "names")
        pointed = df.withColumn("_target", reference).filter(F.col("_target").isNotNull() & (F.col("_target") != F.col(name)))
        return pointed.join(names, "_target").drop("_target")
    first = cut_lineage(df.groupBy(name).agg(F.min(record).alias("target_record")), "names")
    return df.join(first, name).filter(F.col(record) > F.col("target_record"))


def bracket_reference(text: Column) -> Column:
    """``X`` for a text that is exactly ``[X]``, else null."""
    found = F.regexp_extract(F.trim(text), r"^\[([^\]]+)\]$", 1)
    return F.when(found != "", found)


def missing_metadata(df: DataFrame, record: str, fields: list[str], visible: Column | None = None) -> DataFrame:
    """(record, field) for every blank field of a visible record; all fields in one scan."""
    rows = df if visible is None else df.filter(visible)
    blanks = F.array_compact(F.array(*[
        F.when(P.blank(F.col(f).cast("string")), F.lit(f)) for f in fields]))
    return rows.select(record, F.explode(blanks).alias("field"))


def without_part(df: DataFrame, record: str, parts: DataFrame, part_record: str) -> DataFrame:
    """Records that lack a part kept in another table (a label, a system turn, a description)."""
    return keyed_filter(df, parts, [(record, part_record)], keep=False)


def referenced_columns(df: DataFrame, record: str, text: str) -> DataFrame:
    """(record, column_name) for identifiers inside aggregate calls and ``by`` lists."""
    called = F.regexp_extract_all(F.col(text), F.lit(V.AGGREGATE_CALL), F.lit(1))
    lists = F.flatten(F.transform(F.regexp_extract_all(F.col(text), F.lit(V.BY_LIST), F.lit(1)), lambda x: F.split(x, ",")))
    listed = F.transform(lists, lambda x: F.split(F.trim(x), r"\s")[0])
    names = F.filter(F.array_distinct(F.concat(called, listed)), lambda x: x.rlike(r"^\w+$"))
    return df.select(record, F.explode(names).alias("column_name"))


def tokens(text: Column) -> Column:
    """Distinct lower-case ASCII words and numbers."""
    return F.array_distinct(F.filter(F.split(F.lower(text), r"[^a-z0-9]+"), lambda x: x != ""))


def overlap_pairs(
    texts: DataFrame, text_id: str, candidates: DataFrame, candidate_id: str, text: str = "text", min_score: float = 0.5,
) -> DataFrame:
    """All (text, candidate) pairs whose candidate holds at least ``min_score`` of the text's tokens.

    Exact, without comparing every pair. Say a text has n tokens and needs ``need`` of
    them. Of its n - need + k rarest tokens a matching candidate holds at least k, so
    only those are joined and only pairs with k hits go on; the frequent words, which
    fill most candidates, are looked up for those pairs alone.

    Candidates are tokenised once: their words that occur in any text are written to
    the shared folder and read by the three steps that need them. Written words are a few
    bits each, so their files look small enough to be sent to all tasks; they never are.
    """
    wanted = texts.select(F.col(text_id).alias("text_id"), tokens(F.col(text)).alias("_tokens"))
    text_words = wanted.select("text_id", F.size("_tokens").alias("n"), F.explode("_tokens").alias("token"))
    words = cut_lineage(
        candidates.select(F.col(candidate_id).alias("candidate_id"), F.explode(tokens(F.col(text))).alias("token"))
        .join(text_words.select("token").distinct(), "token", "left_semi"), "words")
    frequency = words.groupBy("token").agg(F.count(F.lit(1)).alias("df"))
    by_rarity = W.partitionBy("text_id").orderBy(F.coalesce("df", F.lit(0)), "token")
    # one text's own tokens per window group
    ranked = cut_lineage(
        text_words.join(frequency, "token", "left")
        .withColumn("need", F.ceil(F.col("n") * F.lit(min_score) - F.lit(1e-9)))
        .withColumn("k", F.greatest(F.ceil(F.col("need") * 0.25), F.lit(1)))
        .withColumn("_rare", F.row_number().over(by_rarity) <= F.col("n") - F.col("need") + F.col("k"))
        .select("text_id", "token", "n", "need", "k", "_rare"), "ranked")
    found = (
        sent_or_merged(ranked.filter("_rare"), words, ["token"]).groupBy("text_id", "candidate_id", "n", "need", "k")
        .agg(F.count(F.lit(1)).alias("hits")).filter("hits >= k").drop("k")
    )
    common = ranked.filter("not _rare").select("text_id", "token")
    more = (
        sent_or_merged(common, found, ["text_id"]).join(words.hint("merge"), ["candidate_id", "token"])
        .select("text_id", "candidate_id", "n", "need", F.lit(1).cast("bigint").alias("hits"))
    )
    return (
        found.unionByName(more).groupBy("text_id", "candidate_id", "n", "need").agg(F.sum("hits").alias("_shared"))
        .filter("_shared >= need")
        .select("text_id", "candidate_id", F.col("_shared").cast("int").alias("n_shared"), F.col("n").alias("n_tokens"),
                F.round(F.col("_shared") / F.col("n"), 4).alias("score"))
    )


def best_source_match(
    texts: DataFrame, text_id: str, candidates: DataFrame, candidate_id: str, text: str = "text", min_score: float = 0.5,
) -> DataFrame:
    """The candidate with the highest overlap per text, ties to the smallest candidate."""
    pairs = overlap_pairs(texts, text_id, candidates, candidate_id, text, min_score)
    return first_per_group(pairs, ["text_id"], [F.desc("n_shared"), F.asc("candidate_id")])


def format_inference(df: DataFrame, name: str, out: str = "format", expression: str | None = None) -> DataFrame:
    """Format from the name; a division with a percent sign in the name or percent in the expression is a percentage too."""
    low = F.lower(name)
    picks = [F.when(low.rlike(pattern), F.lit(fmt)) for pattern, fmt in V.FORMAT_CLASSES]
    if expression is not None:
        text = F.lower(expression)
        picks.insert(0, F.when(text.contains("divide") & (low.contains("%") | text.contains("percent")), F.lit(V.FORMAT_CLASSES[0][1])))
    return df.withColumn(out, F.coalesce(*picks, F.lit(V.FORMAT_DEFAULT)))


def rows_per_rule(hits: DataFrame, k: int = 3, record: str = "id") -> DataFrame:
    """Hits per rule with the first ``k`` records."""
    counts = hits.groupBy("rule_id").agg(F.count(F.lit(1)).alias("n_hits"))
    first = top_per_group(hits.select("rule_id", record), ["rule_id"], [F.asc(record)], k).groupBy("rule_id").agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(record)), lambda x: x.cast("string")), ", ").alias("first_records"))
    return counts.join(first, "rule_id")
