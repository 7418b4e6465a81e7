"""Report queries: findings drawn from the sample tables, rolled up by rule."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.operators import graph as G
from plumbline.operators import integrity as I
from plumbline.operators import report as R
from plumbline.plans.catalog import ADVICE, RULES, rules_frame
from plumbline.plans.registry import query
from plumbline.session import scratch_path

RULE_IDS = ["EH-007", "GW-002", "GW-010", "LH-S04", "SM-018", "WH-009", "WH-020", "WH-023"]
ABSENT = ("SM-018",)
ERRORS = {"LH-S04": "input unavailable"}


def sample_findings(t):
    """Slow events, stale users, duplicate parts, old versions and big customer groups."""
    slow = t.events.filter("value > 300").select(F.lit("events").alias("table_name"), "event_id")
    stale = (t.events.groupBy("user_id").agg(F.max("ts").alias("last"))
             .filter("last < timestamp_ntz '2024-01-30'").select(F.lit("events").alias("table_name"), "user_id"))
    twins = G.duplicate_records(t.part, ["p_name", "p_brand", "p_type"], "p_partkey").select(
        F.lit("part").alias("table_name"), "keep_id")
    crowds = G.excess_members(t.customer, ["c_nationkey", "c_mktsegment"], 5).select(
        F.lit("customer").alias("table_name"), "c_nationkey", "c_mktsegment")
    lost = I.orphan_rows(t.labels, t.documents, [("doc_id", "doc_id")]).select(
        F.lit("labels").alias("table_name"), "doc_id")
    old = t.part.filter("p_size < 2").select(F.lit("part").alias("table_name"), "p_partkey")
    return R.union_findings([
        R.findings(slow, "WH-023", F.concat(F.lit("event "), "event_id")),
        R.findings(stale, "EH-007", F.concat(F.lit("user "), "user_id")),
        R.findings(twins, "GW-010", F.concat(F.lit("part "), "keep_id")),
        R.findings(crowds, "WH-020", F.concat(F.lit("group "), "c_nationkey", F.lit(" "), "c_mktsegment")),
        R.findings(lost, "WH-009", F.concat(F.lit("label "), "doc_id")),
        R.findings(old, "GW-002", F.concat(F.lit("part "), "p_partkey")),
    ])


FINDINGS = """WITH found AS (
  SELECT 'WH-023' AS rule_id, 'event ' || CAST(event_id AS VARCHAR) AS target FROM events WHERE value > 300
  UNION ALL SELECT 'EH-007', 'user ' || CAST(user_id AS VARCHAR) FROM events GROUP BY user_id HAVING max(ts) < TIMESTAMP '2024-01-30'
  UNION ALL SELECT 'GW-010', 'part ' || CAST(min(p_partkey) AS VARCHAR) FROM part GROUP BY p_name, p_brand, p_type HAVING count(*) > 1
  UNION ALL SELECT 'WH-020', 'group ' || CAST(c_nationkey AS VARCHAR) || ' ' || c_mktsegment FROM customer
            GROUP BY c_nationkey, c_mktsegment HAVING count(*) > 5
  UNION ALL SELECT 'WH-009', 'label ' || CAST(doc_id AS VARCHAR) FROM labels l
            WHERE NOT EXISTS (SELECT 1 FROM documents d WHERE d.doc_id = l.doc_id)
  UNION ALL SELECT 'GW-002', 'part ' || CAST(p_partkey AS VARCHAR) FROM part WHERE p_size < 2
), ranked AS (SELECT rule_id, target, row_number() OVER (PARTITION BY rule_id ORDER BY target) AS n FROM found
), sampled AS (
  SELECT rule_id, n_issues, sample || CASE WHEN n_issues > 5 THEN ' +' || CAST(n_issues - 5 AS VARCHAR) || ' more' ELSE '' END AS sample
  FROM (SELECT rule_id, count(*) AS n_issues, string_agg(target, ', ' ORDER BY target) FILTER (WHERE n <= 5) AS sample
        FROM ranked GROUP BY rule_id)
)"""

RESULTS = FINDINGS + ", rules AS (SELECT * FROM (VALUES " + ", ".join(
    f"('{r}', '{s}', '{h}', '{o}', '{ADVICE[o]}')" for r, s, h, o in RULES if r in RULE_IDS).replace("record's", "record''s") + """
) AS r(rule_id, severity, on_hit, operator, recommendation)
), results AS (
  SELECT r.rule_id, r.operator, r.severity,
         CASE WHEN r.rule_id = 'LH-S04' THEN 'ERROR' WHEN r.rule_id = 'SM-018' THEN 'N/A'
              WHEN coalesce(n_issues, 0) = 0 THEN 'PASS' ELSE r.on_hit END AS status,
         coalesce(n_issues, 0) AS n_issues,
         CASE WHEN r.rule_id = 'LH-S04' THEN 'input unavailable' WHEN coalesce(n_issues, 0) = 0 THEN 'No issues found.'
              ELSE CAST(n_issues AS VARCHAR) || ' issue(s): ' || sample END AS details,
         r.recommendation
  FROM rules r LEFT JOIN sampled USING (rule_id)
)
"""


def sample_results(t):
    return R.findings_to_rules(sample_findings(t), rules_frame(t.spark, RULE_IDS), ABSENT, ERRORS)


@query("findings_to_rules", RESULTS + "SELECT * FROM results")
def findings_to_rules(t):
    return sample_results(t)


@query("status_summary", RESULTS + """
SELECT count(*) AS n_rules, count(*) FILTER (WHERE status = 'PASS') AS n_pass, count(*) FILTER (WHERE status = 'FAIL') AS n_fail,
       count(*) FILTER (WHERE status = 'WARN') AS n_warn, count(*) FILTER (WHERE status = 'N/A') AS n_na,
       count(*) FILTER (WHERE status = 'ERROR') AS n_error FROM results""")
def status_summary(t):
    return R.status_summary(sample_results(t))


@query("issue_table", RESULTS + """
SELECT * FROM results WHERE status IN ('FAIL', 'ERROR', 'WARN')
ORDER BY CASE status WHEN 'FAIL' THEN 0 WHEN 'ERROR' THEN 1 ELSE 2 END,
         CASE severity WHEN 'HIGH' THEN 0 WHEN 'MEDIUM' THEN 1 WHEN 'LOW' THEN 2 ELSE 3 END, rule_id""")
def issue_table(t):
    return R.issue_table(sample_results(t))


@query("offender_sample", FINDINGS + "SELECT rule_id, n_issues, sample FROM sampled")
def offender_sample(t):
    return R.offender_sample(sample_findings(t)).drop("raised")


@query("findings_sink", FINDINGS + "SELECT '2024-01-31' AS scanned, rule_id, target FROM found")
def findings_sink(t):
    """Findings appended to the shared folder by scan date and read back."""
    out = scratch_path(t.spark, "findings")
    R.write_findings(sample_findings(t), out, "2024-01-31")
    return t.spark.read.parquet(out).select(F.date_format("scan_date", "yyyy-MM-dd").alias("scanned"), "rule_id", "target")


@query("report_text", RESULTS + """
SELECT '| ' || rule_id || ' ' || operator || ' | ' || status || ' | ' || severity || ' | ' || replace(details, '|', '\\|') || ' | ' || recommendation || ' |' AS line
FROM results WHERE status IN ('FAIL', 'ERROR', 'WARN')""")
def report_text(t):
    """The issue lines of the rendered report."""
    lines = R.render(sample_results(t), "Audit", "2024-01-31").splitlines()
    return t.spark.createDataFrame([(x,) for x in lines if x.startswith("| ") and not x.startswith("| Rule")], "line string")
