"""Findings to rule results to a report."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions import fixed_values as V
from plumbline.operators.spread import top_per_group

FINDING_COLUMNS = ("rule_id", "table_name", "column_name", "target", "detail", "level")


def findings(df: DataFrame, rule_id: str | Column, target: Column | None = None, detail: Column | None = None) -> DataFrame:
    """Shape the rows of any audit operator into findings.

    A column ``level`` that says FAIL raises the rule's status; a finding with a level and no target is no issue of its own.
    """
    table = F.col("table_name") if "table_name" in df.columns else F.lit(None).cast("string")
    column = F.col("column_name") if "column_name" in df.columns else F.lit(None).cast("string")
    name = F.concat(table, F.when(column.isNotNull(), F.concat(F.lit("["), column, F.lit("]"))).otherwise(F.lit("")))
    return df.select(
        (F.lit(rule_id) if isinstance(rule_id, str) else rule_id).alias("rule_id"), table.alias("table_name"), column.alias("column_name"),
        (name if target is None else target).cast("string").alias("target"),
        (F.lit(None).cast("string") if detail is None else detail.cast("string")).alias("detail"),
        (F.col("level") if "level" in df.columns else F.lit(None)).cast("string").alias("level"))


def union_findings(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def offender_sample(found: DataFrame, k: int = 5) -> DataFrame:
    """Per rule: how many findings, and the first ``k`` targets with "+n more".

    Counting is map-side; the sample ships at most ``k`` rows of a rule per task.
    """
    found = found if "level" in found.columns else found.withColumn("level", F.lit(None).cast("string"))
    issue = F.col("target").isNotNull() | F.col("level").isNull()
    counts = found.groupBy("rule_id").agg(
        F.count_if(issue).alias("n_issues"), F.max(F.col("level") == "FAIL").alias("raised"))
    shown = top_per_group(found.filter(issue).select("rule_id", "target"), ["rule_id"], [F.asc("target")], k)
    lists = shown.groupBy("rule_id").agg(F.sort_array(F.collect_list("target")).alias("sample"))
    more = F.when(F.col("n_issues") > k, F.concat(F.lit(" +"), (F.col("n_issues") - k).cast("string"), F.lit(" more")))
    return counts.join(lists, "rule_id", "left").select(
        "rule_id", "n_issues", F.coalesce("raised", F.lit(False)).alias("raised"),
        F.concat(F.array_join(F.coalesce("sample", F.array()), ", "), F.coalesce(more, F.lit(""))).alias("sample"))


def findings_to_rules(
    found: DataFrame, rules: DataFrame, absent: tuple[str, ...] = (), errors: dict[str, str] | None = None, k: int = 5,
) -> DataFrame:
    """One result row per rule.

    Hits give the rule's own status, no hits PASS, rules whose input is absent N/A,
    and rules whose input failed ERROR. ``rules`` is catalog-sized.
    """
    errors = errors or {}
    merged = rules.join(offender_sample(found, k), "rule_id", "left")
    n = F.coalesce("n_issues", F.lit(0))
    failed = F.col("rule_id").isin(list(errors)) if errors else F.lit(False)
    missing = F.col("rule_id").isin(list(absent)) if absent else F.lit(False)
    status = (F.when(failed, "ERROR").when(missing, "N/A").when(n == 0, "PASS")
              .when(F.col("raised"), "FAIL").otherwise(F.col("on_hit")))
    text = F.when(n == 0, "No issues found.").otherwise(
        F.concat(n.cast("string"), F.lit(" issue(s): "), F.coalesce("sample", F.lit(""))))
    if errors:
        pairs = [x for kv in errors.items() for x in (F.lit(kv[0]), F.lit(kv[1]))]
        text = F.coalesce(F.try_element_at(F.create_map(*pairs), F.col("rule_id")), text)
    return merged.select(
        "rule_id", "operator", "severity", status.alias("status"), n.cast("bigint").alias("n_issues"),
        text.alias("details"), "recommendation")


def status_summary(results: DataFrame) -> DataFrame:
    return results.agg(
        F.count(F.lit(1)).alias("n_rules"),
        *[F.count_if(F.col("status") == s).alias(name) for s, name in (
            ("PASS", "n_pass"), ("FAIL", "n_fail"), ("WARN", "n_warn"), ("N/A", "n_na"), ("ERROR", "n_error"))])


def _rank(column: str, order: tuple[str, ...]) -> Column:
    return F.array_position(F.array(*[F.lit(v) for v in order]), F.col(column)).cast("int")


def issue_table(results: DataFrame) -> DataFrame:
    """FAIL, ERROR and WARN results by status, severity and rule id."""
    return (
        results.filter(F.col("status").isin("FAIL", "ERROR", "WARN"))
        .orderBy(_rank("status", V.STATUS_ORDER), _rank("severity", V.SEVERITY_ORDER), "rule_id")
    )


def estate_report(items: DataFrame, workspace: str, kind: str, k: int = 3, name: str | None = None) -> DataFrame:
    """Items per workspace and type, with the share of the workspace; optionally the first ``k`` names."""
    by_type = items.groupBy(workspace, kind).agg(F.count(F.lit(1)).alias("n_items"))
    totals = by_type.groupBy(workspace).agg(F.sum("n_items").alias("n_total"))
    out = by_type.join(totals, workspace).withColumn("share", F.round(F.col("n_items") / F.col("n_total"), 4))
    if name is None:
        return out
    shown = top_per_group(items.select(workspace, kind, name), [workspace, kind], [F.asc(name)], k)
    lists = shown.groupBy(workspace, kind).agg(
        F.array_join(F.sort_array(F.collect_list(F.col(name).cast("string"))), ", ").alias("first_names"))
    return out.join(lists, [workspace, kind])


def write_findings(found: DataFrame, path: str, scan_date: str) -> None:
    """Append one scan's findings below ``path``, partitioned by scan date."""
    found.withColumn("scan_date", F.lit(scan_date).cast("date")).write.mode("append").partitionBy("scan_date").parquet(path)


def _cell(text: object) -> str:
    return str(text if text is not None else "-").replace("|", "\\|").replace("\n", " ")


def render(results: DataFrame, title: str, scan_time: str) -> str:
    """Markdown report. Only the catalog-sized result rows reach the driver."""
    s = status_summary(results).first()
    lines = [
        f"# {title}", "", f"_Scan at {scan_time}_", "",
        f"**{s.n_rules} rules**: {s.n_pass} passed, {s.n_fail} failed, {s.n_warn} warnings, "
        f"{s.n_na} not applicable, {s.n_error} errors", "",
    ]
    issues = issue_table(results).collect()
    if not issues:
        return "\n".join(lines + ["All rules passed."])
    lines += ["| Rule | Status | Severity | Finding | Recommendation |", "|---|---|---|---|---|"]
    lines += [f"| {r.rule_id} {r.operator} | {r.status} | {r.severity} | {_cell(r.details)} | {_cell(r.recommendation)} |"
              for r in issues]
    return "\n".join(lines)
