"""Repair queries over the sample tables."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.functions.fixed_values import MB
from plumbline.operators import fixes as X
from plumbline.operators import integrity as I
from plumbline.operators import logs as L
from plumbline.operators import profile as P
from plumbline.operators import report as R
from plumbline.operators import statistics as ST
from plumbline.operators import storage as S
from plumbline.operators import text as TX
from plumbline.plans.apply import apply_plan as run_plan
from plumbline.plans.apply import transforms
from plumbline.plans.catalog import FIXES, fixes_frame
from plumbline.plans.corpus import EXPRESSIONS, OVERLAP, _expression, named_parts
from plumbline.plans.graph import FLAGGED, flagged_edges
from plumbline.plans.integrity import KEY_PROFILE, PAIRS, _pair_sql, key_profile
from plumbline.plans.logs import AS_OF, event_views
from plumbline.plans.registry import query
from plumbline.plans.report import FINDINGS, sample_findings
from plumbline.plans.sample_sql import columns_of, profile_cell, profile_sql
from plumbline.plans.storage import LOG, file_actions, log_events
from plumbline.session import cut_lineage, remove, scratch_path


def store_findings(t):
    """Settings findings for the stores with less than a fifth of signups."""
    quiet = (log_events(t).groupBy("table_name").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("event_type") == "signup").alias("k"))
        .filter("k * 5 < n").select("table_name"))
    return R.union_findings([R.findings(quiet, rule) for rule in ("LH-020", "LH-021", "LH-026")])


PLAN = FINDINGS + """, quiet AS (
  SELECT 'store_' || CAST(user_id % 20 AS VARCHAR) AS target FROM events GROUP BY 1
  HAVING count(*) FILTER (WHERE event_type = 'signup') * 5 < count(*)
), pairs AS (SELECT DISTINCT rule_id, target FROM found UNION ALL SELECT 'LH-020', target FROM quiet UNION ALL SELECT 'LH-021', target FROM quiet
), plan AS (
  SELECT fix_id, p.rule_id, target, replace(command, '{target}', target) AS command, command LIKE 'transform:%' AS is_transform
  FROM pairs p JOIN (VALUES
    ('auto-optimize', 'LH-020', 'ALTER TABLE {target} SET TBLPROPERTIES (''delta.autoOptimize.optimizeWrite'' = ''true'', ''delta.autoOptimize.autoCompact'' = ''true'')'),
    ('retention', 'LH-021', 'ALTER TABLE {target} SET TBLPROPERTIES (''delta.logRetentionDuration'' = ''interval 30 days'', ''delta.deletedFileRetentionDuration'' = ''interval 7 days'')'),
    ('WH-009', 'WH-009', 'transform:drop_orphans {target}'), ('GW-010', 'GW-010', 'transform:dedup_records {target}')
  ) f(fix_id, rule_id, command) ON f.rule_id = p.rule_id
)
"""


def sample_plan(t):
    return X.fix_plan(sample_findings(t).unionByName(store_findings(t)), fixes_frame(t.spark))


@query("fix_plan", PLAN + "SELECT * FROM plan")
def fix_plan(t):
    return sample_plan(t)


@query("fix_summary", PLAN + """
SELECT fix_id, count(*) AS n_targets, count(*) FILTER (WHERE length(target) % 3 = 0) AS n_fixed,
       count(*) FILTER (WHERE length(target) % 3 = 1) AS n_failed, count(*) FILTER (WHERE length(target) % 3 = 2) AS n_skipped
FROM plan GROUP BY fix_id""")
def fix_summary(t):
    n = F.length("target") % 3
    outcome = F.when(n == 0, "fixed").when(n == 1, "failed").otherwise("skipped")
    return X.fix_summary(sample_plan(t).withColumn("outcome", outcome))


@query("compact_plan", LOG + """, placed AS (
  SELECT *, sum(size) OVER (PARTITION BY table_name ORDER BY path ROWS UNBOUNDED PRECEDING) - size AS start FROM live WHERE size < 209715200)
SELECT table_name, CAST(floor(start / 536870912) AS BIGINT) AS bin, count(*) AS n_files, CAST(sum(size) AS BIGINT) AS total_bytes
FROM placed GROUP BY ALL""")
def compact_plan(t):
    return X.compact_plan(S.active_files(file_actions(t)), 512 * MB, 200 * MB)


@query("compact_bins", LOG + """, small AS (SELECT * FROM live WHERE size < 209715200)
SELECT table_name, count(*) AS n_files, CAST(sum(size) AS BIGINT) AS total_bytes, true AS none_over, true AS tight FROM small GROUP BY table_name""")
def compact_bins(t):
    """Every small file is in one bin; no bin is over the target, and there are few more than the bytes need."""
    target = 512 * MB
    files = S.active_files(file_actions(t)).filter(F.col("size") < 200 * MB)
    bins = X.compact_bins(files, target, 200 * MB).select("table_name", "path", "bin", F.col("total_bytes").alias("filled"))
    placed = files.join(bins, ["table_name", "path"], "left")  # a file alone in its bin has none
    need = F.ceil(F.sum("size") / target)
    used = F.count_distinct("bin") + F.count_if(F.col("bin").isNull())
    return placed.groupBy("table_name").agg(
        F.count(F.lit(1)).alias("n_files"), F.sum("size").alias("total_bytes"),
        F.coalesce(F.max("filled") <= target, F.lit(True)).alias("none_over"), (used <= 1.25 * need + 1).alias("tight"))


@query("compact_by_bins", """
SELECT true AS fewer_files, true AS one_file_a_bin, count(*) AS n_rows, CAST(sum(l_orderkey) AS BIGINT) AS key_sum FROM lineitem""")
def compact_by_bins(t):
    """lineitem in many small files, packed and written again; the counts are of files on disk."""
    before, after = scratch_path(t.spark, "small"), scratch_path(t.spark, "packed")
    t.lineitem.repartition(X.files_for(t.lineitem, 24), "l_orderkey").write.parquet(before)
    listed = ST.files(t.spark, before).withColumn("table_name", F.lit("lineitem"))
    target = min(int(listed.agg(F.sum("size")).first()[0] / 5), 64 * MB)
    plan = X.compact_bins(listed.select("table_name", "path", "size"), target, target)
    bins = listed.join(plan.select("path", "bin"), "path").select("file", "bin")
    bins = cut_lineage(bins, "bins")
    X.compact_by_bins(t.spark.read.parquet(before), bins, after)
    files = ST.files(t.spark, after).agg(F.count(F.lit(1)).alias("n_after"))
    wanted = bins.agg(F.count_distinct("bin").alias("n_bins"), F.count(F.lit(1)).alias("n_before"))
    # a file that no bin names stays where it is
    small = t.spark.read.parquet(before)
    left = small.select("l_orderkey", F.col("_metadata.file_path").alias("file")).join(F.broadcast(bins.select("file")), "file", "left_anti")
    whole = t.spark.read.parquet(after).select("l_orderkey").unionByName(left.select("l_orderkey"))
    rows = whole.agg(F.count(F.lit(1)).alias("n_rows"), F.sum("l_orderkey").alias("key_sum"))
    every = files.unionByName(wanted, allowMissingColumns=True).unionByName(rows, allowMissingColumns=True)
    one = every.agg(*[F.max(c).alias(c) for c in ("n_after", "n_bins", "n_before", "n_rows", "key_sum")])
    return one.select((F.col("n_after") < F.col("n_before")).alias("fewer_files"), (F.col("n_after") == F.col("n_bins")).alias("one_file_a_bin"), "n_rows", "key_sum")


@query("compact_files", "SELECT l_returnflag, count(*) AS n_rows, CAST(sum(l_orderkey) AS BIGINT) AS key_sum, CAST(sum(l_quantity) AS BIGINT) AS quantity FROM lineitem GROUP BY 1")
def compact_files(t):
    out = scratch_path(t.spark, "compact")
    X.compact_files(t.lineitem, out)
    return _content(t.spark.read.parquet(out))


def _content(df):
    return df.groupBy("l_returnflag").agg(
        F.count(F.lit(1)).alias("n_rows"), F.sum("l_orderkey").alias("key_sum"),
        F.sum("l_quantity").cast("bigint").alias("quantity"))


@query("zorder_rewrite", "SELECT l_returnflag, count(*) AS n_rows, CAST(sum(l_orderkey) AS BIGINT) AS key_sum, CAST(sum(l_quantity) AS BIGINT) AS quantity FROM lineitem GROUP BY 1")
def zorder_rewrite(t):
    out = scratch_path(t.spark, "zorder")
    X.write_copy(X.zorder(t.lineitem, ["l_partkey", "l_suppkey"], partitions=X.files_for(t.lineitem, 8)), out)
    return _content(t.spark.read.parquet(out))


@query("cluster_rewrite", """
SELECT true AS skips_half, count(*) AS n_rows, count(*) FILTER (WHERE o_orderpriority = '2-HIGH' AND o_orderdate BETWEEN TIMESTAMP '1997-01-01' AND TIMESTAMP '1998-01-01') AS n_in_box,
       CAST(sum(o_orderkey) AS BIGINT) AS key_sum FROM orders""")
def cluster_rewrite(t):
    """orders along a curve over a time and a text: files that a box on both has to read, before and after."""
    before, after = scratch_path(t.spark, "as-is"), scratch_path(t.spark, "clustered")
    t.orders.repartition(32).write.parquet(before)
    X.write_copy(X.cluster(t.orders, ["o_orderdate", "o_orderpriority"], 32), after)
    box = {"o_orderpriority": ("2-HIGH", "2-HIGH"), "o_orderdate": ("1997-01-01 00:00:00.000000", "1998-01-01 00:00:00.000000")}
    was, now = (ST.files_touched(t.spark, p, box) for p in (before, after))
    skips = now.select(F.col("n_touched").alias("now")).unionByName(was.select(F.col("n_touched").alias("was")), allowMissingColumns=True).agg(
        (F.max("now") <= 0.5 * F.max("was")).alias("skips_half"))
    inside = (F.col("o_orderpriority") == "2-HIGH") & F.col("o_orderdate").between(F.lit("1997-01-01").cast("timestamp_ntz"), F.lit("1998-01-01").cast("timestamp_ntz"))
    rows = t.spark.read.parquet(after).agg(F.count(F.lit(1)).alias("n_rows"), F.count_if(inside).alias("n_in_box"), F.sum("o_orderkey").alias("key_sum"))
    both = skips.unionByName(rows, allowMissingColumns=True)
    return both.agg(*[F.max(c).alias(c) for c in ("skips_half", "n_rows", "n_in_box", "key_sum")])


@query("partition_rewrite", """
SELECT CAST(year(l_shipdate) AS INTEGER) AS ship_year, count(*) AS n_rows, CAST(sum(l_orderkey) AS BIGINT) AS key_sum FROM lineitem GROUP BY 1""")
def partition_rewrite(t):
    out = scratch_path(t.spark, "partitioned")
    X.partition_rewrite(t.lineitem, F.year("l_shipdate"), "ship_year", out)
    return t.spark.read.parquet(out).groupBy("ship_year").agg(
        F.count(F.lit(1)).alias("n_rows"), F.sum("l_orderkey").alias("key_sum"))


@query("retention_filter", "SELECT event_id, user_id, event_type FROM events WHERE ts >= TIMESTAMP '2024-01-31' - INTERVAL 10 DAY")
def retention_filter(t):
    return X.retention_filter(t.events, "ts", AS_OF, 10).select("event_id", "user_id", "event_type")


@query("compute_stats", profile_sql(["orders"]))
def compute_stats(t):
    """Profile only the tables whose newest row is too old."""
    return X.compute_stats(t.pick(["orders", "events"]), {"orders": "o_orderdate", "events": "ts"}, "2024-01-31", 30)


LEFT = "(SELECT * FROM lineitem WHERE l_returnflag <> 'A')"


@query("statistics_store", f"""
SELECT column_name, kind, 2::BIGINT AS n_files, n_rows, n_nulls, min_value, max_value, max_len, true AS distinct_within, 1 AS files_read FROM (
{" UNION ALL ".join(profile_cell("lineitem", c, k, LEFT) for c, k in columns_of("lineitem"))})""")
def statistics_store(t):
    """A file of each return flag, in as many parts as it has data for: two are taken in, then a third alone is read, then one goes; the profile is a merge."""
    data, store = scratch_path(t.spark, "flags"), ST.StatisticsStore(t.spark, scratch_path(t.spark, "statistics"))
    for flag in "AN":
        t.lineitem.filter(F.col("l_returnflag") == flag).write.parquet(f"{data}/{flag}")
    store.refresh(data)
    t.lineitem.filter("l_returnflag = 'R'").write.parquet(f"{data}/R")
    read = store.refresh(data)
    remove(t.spark, f"{data}/A")
    exact = P.column_profile({"lineitem": t.lineitem.filter("l_returnflag <> 'A'")}).select("column_name", "n_distinct")
    merged = store.profile(data, counted=F.regexp_extract("file", "([^/]+)/[^/]+$", 1)).join(exact, "column_name")
    within = F.abs(F.col("approx_distinct") - F.col("n_distinct")) <= 0.05 * F.col("n_distinct") + 1
    return merged.select("column_name", "kind", "n_files", "n_rows", "n_nulls", "min_value", "max_value", "max_len", within.alias("distinct_within"), F.lit(len({p.rsplit("/", 1)[0] for p in read})).alias("files_read"))


@query("add_audit_columns", """
SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS created, strftime(o_orderdate, '%Y-%m-%d') AS updated FROM orders""")
def add_audit_columns(t):
    once = X.add_audit_columns(t.orders, F.col("o_orderdate"))
    twice = X.add_audit_columns(once, F.lit(None).cast("timestamp_ntz"))
    return twice.select("o_orderkey", F.date_format("created_at", "yyyy-MM-dd").alias("created"),
                        F.date_format("updated_at", "yyyy-MM-dd").alias("updated"))


@query("mask_columns", r"""
SELECT doc_id, regexp_replace(text, '([A-Za-z0-9._%+-])[A-Za-z0-9._%+-]*@[A-Za-z0-9.-]+\.[A-Za-z]{2,}', '\1XXX@XXXX.com', 'g') AS text,
       'xxxx' AS source, 0::BIGINT AS n_chars FROM documents""")
def mask_columns(t):
    docs = t.documents.select("doc_id", "text", "source", "n_chars")
    return X.mask_columns(docs, {"text": "email", "source": "default", "n_chars": "default"})


@query("mask_partial", """
SELECT c_custkey, 'XXX-XXX-' || right(c_name, 4) AS c_phone, c_mktsegment FROM customer""")
def mask_partial(t):
    return X.mask_columns(t.customer.select("c_custkey", F.col("c_name").alias("c_phone"), "c_mktsegment"), ["c_phone"])


@query("fill_defaults", """
SELECT doc_id, coalesce(quality, -1) AS quality, coalesce(toxic, 0) AS toxic FROM documents LEFT JOIN labels USING (doc_id)""")
def fill_defaults(t):
    joined = t.documents.select("doc_id").join(t.labels, "doc_id", "left")
    return X.fill_defaults(joined, {"quality": -1, "toxic": 0})


# wrappings of the sample expressions: calls inside calls, text behind them, parentheses and commas in quotes and brackets
WRAPPED = (
    ("{}", "{}"), ("EVALUATEANDLOG({}) + 1", "{} + 1"), ("EVALUATEANDLOG(SUM([a(b]) + EVALUATEANDLOG({})) + SUM(x)", "SUM([a(b]) + {} + SUM(x)"),
    ('IFERROR(IFERROR({}, (1 + (2 * (3)))), 0) & ")"', 'IF(ISERROR(IF(ISERROR({0}), (1 + (2 * (3))), {0})), 0, IF(ISERROR({0}), (1 + (2 * (3))), {0})) & ")"'),
    ('((((EVALUATEANDLOG( {}, "log, (1" ) - 1))))', "(((({} - 1))))"),
)


def _wrapped_sql(form: str, inner: str) -> str:
    return " || ".join(["'" + x.replace("'", "''") + "'" if k % 2 == 0 else inner for k, x in enumerate(re.split(r"(\{0?\})", form))])


@query("rewrite_expressions", f"""WITH {EXPRESSIONS}, parts AS (
  SELECT e.p_partkey, expression, p.p_type, '[m' || CAST(e.p_partkey % 50 AS VARCHAR) || ']' AS m FROM expressions e JOIN part p USING (p_partkey)),
inner_ AS (SELECT *, CASE CAST(p_partkey % 8 AS INTEGER)
  WHEN 0 THEN 'IF(ISERROR(' || m || ' / [qty]), 0, ' || m || ' / [qty])' WHEN 1 THEN 'SUM(''part''[' || p_type || '])'
  WHEN 2 THEN 'CALCULATE(CALCULATE(SUM(''part''[' || p_type || '])), REMOVEFILTERS(''part''))'
  WHEN 4 THEN 'SUM(''part''[' || p_type || '])' ELSE trim(expression) END AS r FROM parts)
SELECT p_partkey, wrapped AS expression, rewritten, rewritten <> wrapped AS is_changed FROM (
  SELECT p_partkey, CASE CAST(p_partkey % 5 AS INTEGER) {' '.join(f"WHEN {k} THEN {_wrapped_sql(a, 'expression')}" for k, (a, _) in enumerate(WRAPPED))} END AS wrapped,
    CASE CAST(p_partkey % 5 AS INTEGER) WHEN 0 THEN CASE WHEN p_partkey % 8 IN (3, 7) THEN 'SUM(''part''[' || p_type || '])' ELSE r END
    {' '.join(f"WHEN {k} THEN {_wrapped_sql(b, 'r')}" for k, (_, b) in enumerate(WRAPPED) if k)} END AS rewritten FROM inner_)""")
def rewrite_expressions(t):
    """All rewrites, over expressions that are nested in others."""
    made = [F.concat(*[F.lit(x) if k % 2 == 0 else F.col("expression") for k, x in enumerate(re.split(r"(\{\})", form))]) for form, _ in WRAPPED]
    wrapped = _expression(t).select("p_partkey", F.element_at(F.array(*made), (F.col("p_partkey") % len(made)).cast("int") + 1).alias("expression"))
    return X.rewrite_expressions(wrapped, "expression").select("p_partkey", "expression", "rewritten", "is_changed")


@query("rewrite_sumx", f"""WITH {EXPRESSIONS}
SELECT p_partkey, CASE WHEN p_partkey % 8 = 1 THEN 'SUM(''part''[' || p_type || '])' ELSE expression END AS rewritten, p_partkey % 8 = 1 AS is_changed
FROM expressions JOIN part USING (p_partkey)""")
def rewrite_sumx(t):
    return X.rewrite_expressions(_expression(t), "expression", ["SM-FIX-SUMX"]).select("p_partkey", "rewritten", "is_changed")


@query("clean_names", r"""
SELECT doc_id, cleaned, cleaned <> text AS is_changed FROM (SELECT doc_id, text,
  regexp_replace(regexp_replace(regexp_replace(text, '[\t\r\n]', ' ', 'g'), '^\s+|\s+$', '', 'g'), '\s{2,}', ' ', 'g') AS cleaned FROM documents)""")
def clean_names(t):
    return X.clean_names(t.documents.select("doc_id", "text"), "text").select("doc_id", "cleaned", "is_changed")


@query("fill_formats", """
WITH names AS (SELECT p_partkey, CASE CAST(p_partkey % 6 AS INTEGER) WHEN 0 THEN 'Conversion Rate ' WHEN 1 THEN 'Unit PRICE ' WHEN 2 THEN 'average ' WHEN 3 THEN 'Sales pct '
  WHEN 4 THEN 'mean cost ' ELSE 'rows ' END || p_name AS name, CASE WHEN p_partkey % 3 = 0 THEN '0.00' WHEN p_partkey % 3 = 1 THEN ' ' END AS format FROM part)
SELECT p_partkey, name, CASE WHEN format IS NOT NULL AND trim(format) <> '' THEN format WHEN regexp_matches(lower(name), 'pct|percent|ratio|rate') THEN '0.0%'
  WHEN regexp_matches(lower(name), 'price|cost|revenue|amount|sales|profit') THEN '$#,##0.00'
  WHEN regexp_matches(lower(name), 'avg|average|mean') THEN '#,##0.00' ELSE '#,0' END AS format FROM names""")
def fill_formats(t):
    p = F.col("p_partkey") % 3
    named = named_parts(t).withColumn("format", F.when(p == 0, "0.00").when(p == 1, " "))
    return X.fill_formats(named, "name", "format")


@query("fill_descriptions", f"""WITH {EXPRESSIONS}
SELECT p_partkey, CASE WHEN p_partkey % 4 = 0 THEN 'given' ELSE 'Measure: ' || name || ' = ' || expression END AS description FROM expressions""")
def fill_descriptions(t):
    rows = _expression(t).withColumn("description", F.when(F.col("p_partkey") % 4 == 0, "given"))
    return X.fill_descriptions(rows, "name", "description", "expression", "Measure").select("p_partkey", "description")


@query("drop_constant_columns", "SELECT event_id, ts, user_id, value, props FROM events WHERE event_type = 'view'")
def drop_constant_columns(t):
    return X.drop_constant_columns(t.events.filter("event_type = 'view'"), "events")


@query("hide_columns", "SELECT doc_id, lang, source, n_chars FROM documents")
def hide_columns(t):
    docs = t.documents.withColumns({"doc_uuid": F.md5("text"), "comment_text": F.col("text")})
    return X.hide_columns(docs, extra=["text"])


@query("drop_alias_records", "SELECT * FROM part QUALIFY row_number() OVER (PARTITION BY p_name ORDER BY p_partkey) = 1")
def drop_alias_records(t):
    aliases = TX.alias_records(t.part.select("p_partkey", "p_name"), "p_partkey", "p_name")
    return X.drop_alias_records(t.part, "p_partkey", aliases)


@query("dedup_records", "SELECT * FROM part QUALIFY row_number() OVER (PARTITION BY p_name, p_brand, p_type ORDER BY p_partkey) = 1")
def dedup_records(t):
    return X.dedup_records(t.part, ["p_name", "p_brand", "p_type"], "p_partkey")


@query("trim_members", "SELECT * FROM customer QUALIFY row_number() OVER (PARTITION BY c_nationkey, c_mktsegment ORDER BY c_custkey) <= 5")
def trim_members(t):
    return X.trim_members(t.customer, ["c_nationkey", "c_mktsegment"], "c_custkey")


@query("excess_rows", """
SELECT * FROM customer QUALIFY row_number() OVER (PARTITION BY c_nationkey, c_mktsegment ORDER BY c_custkey) > 5""")
def excess_rows(t):
    return X.excess_rows(t.customer, ["c_nationkey", "c_mktsegment"], "c_custkey")


@query("drop_orphans", """
SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem l WHERE EXISTS (SELECT 1 FROM orders o WHERE o.o_orderkey = l.l_orderkey AND o.o_orderstatus = 'F')""")
def drop_orphans(t):
    lines = t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey")
    return X.drop_orphans(lines, t.orders.filter("o_orderstatus = 'F'"), [("l_orderkey", "o_orderkey")])


@query("mark_keys", KEY_PROFILE + ", pairs AS (" + " UNION ALL ".join(_pair_sql(*p) for p in PAIRS) + """)
SELECT DISTINCT p.table_name, p.column_name, p.is_unique AS mark_as_key FROM pairs
JOIN (SELECT *, n_nulls = 0 AND n_distinct = n_rows AS is_unique FROM profile) p
  ON split_part(pair, ' -> ', 2) = p.table_name || '.' || p.column_name WHERE containment >= 1.0""")
def mark_keys(t):
    found = I.fk_discovery([(a, t[a], c, b, t[b], p) for a, c, b, p in PAIRS], threshold=1.0)
    return X.mark_keys(found, I.key_candidates(key_profile(t)))


@query("mark_date_table", """
SELECT DISTINCT name, CASE WHEN regexp_matches(lower(name), 'date|calendar|kalender|zeit') THEN 'Time' END AS data_category
FROM (SELECT CASE WHEN event_type = 'view' THEN 'Dim Date ' || CAST(user_id % 9 AS VARCHAR) ELSE 'Fact ' || event_type END AS name FROM events)""")
def mark_date_table(t):
    name = F.when(F.col("event_type") == "view", F.concat(F.lit("Dim Date "), (F.col("user_id") % 9).cast("string"))).otherwise(
        F.concat(F.lit("Fact "), "event_type"))
    return X.mark_date_table(t.events.select(name.alias("name")).distinct(), "name")


@query("single_direction", FLAGGED + """
SELECT src, dst, 'single' AS cross_filter, flagged.cross_filter = 'both' AS is_changed FROM flagged""")
def single_direction(t):
    return X.single_direction(flagged_edges(t)).select("src", "dst", "cross_filter", "is_changed")


@query("no_implicit_summary", FLAGGED + """
SELECT src, dst, 'none' AS summarize_by, flagged.summarize_by = 'sum' AS is_changed FROM flagged""")
def no_implicit_summary(t):
    return X.no_implicit_summary(flagged_edges(t)).select("src", "dst", "summarize_by", "is_changed")


VIEWS = """, views AS (SELECT item_id, 'v' || CAST(item_id AS VARCHAR) AS name,
  CASE WHEN item_id % 2 = 0 THEN 'd' || CAST(item_id AS VARCHAR) ELSE 'gone' || CAST(item_id AS VARCHAR) END AS source_table,
  item_id % 3 <> 0 AS is_healthy, item_id % 4 <> 0 AS is_enabled FROM benchmark),
best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY text_id ORDER BY n_shared DESC, candidate_id) = 1),
triaged AS (SELECT v.*, CASE WHEN is_healthy AND is_enabled THEN 'healthy' WHEN d.doc_id IS NULL THEN 'source missing'
   WHEN NOT is_enabled THEN 'disabled' ELSE 'broken' END AS state
   FROM views v LEFT JOIN documents d ON v.source_table = 'd' || CAST(d.doc_id AS VARCHAR))
"""


@query("repair_view_source", OVERLAP + VIEWS + """
SELECT name, state, action, CASE WHEN action = 'recreate' THEN replace(source_table || ' | count', source_table, new_source) END AS new_query FROM (
  SELECT t.*, 'd' || CAST(b.candidate_id AS VARCHAR) AS new_source,
    CASE WHEN state = 'healthy' THEN 'none' WHEN state = 'disabled' THEN 'enable' WHEN state = 'broken' THEN 'investigate'
         WHEN b.candidate_id IS NULL THEN 'no match' ELSE 'recreate' END AS action
  FROM triaged t LEFT JOIN best b ON t.item_id = b.text_id AND t.state = 'source missing')""")
def repair_view_source(t):
    i = F.col("item_id")
    source = F.concat(F.when(i % 2 == 0, "d").otherwise("gone"), i.cast("string"))
    views = t.benchmark.select("item_id", "text", F.concat(F.lit("v"), "item_id").alias("name"), source.alias("source_table"),
                               (i % 3 != 0).alias("is_healthy"), (i % 4 != 0).alias("is_enabled"),
                               F.concat(source, F.lit(" | count")).alias("query"))
    tables = t.documents.select(F.concat(F.lit("d"), "doc_id").alias("name"))
    triaged = X.view_triage(views, tables)
    lost = triaged.filter("state = 'source missing'").select("item_id", "text", "name")
    best = TX.best_source_match(lost, "name", t.documents, "doc_id").select(
        F.col("text_id").alias("name"), F.concat(F.lit("d"), "candidate_id").alias("new_source"), "score")
    return X.repair_view_source(triaged, best).select("name", "state", "action", "new_query")


@query("refresh_view", """
WITH v AS (SELECT user_id, max(ts) FILTER (WHERE event_type = 'view') AS last_run FROM events GROUP BY user_id),
stale AS (SELECT user_id FROM v WHERE last_run IS NULL OR date_diff('microsecond', last_run, TIMESTAMP '2024-01-31') / 3600000000.0 > 24)
SELECT user_id, CAST(ts AS DATE) AS day, count(*) AS n_events, sum(value::DECIMAL(18,4))::DOUBLE / count(value) AS avg_value
FROM events JOIN stale USING (user_id) GROUP BY ALL""")
def refresh_view(t):
    stale = L.stale_views(event_views(t), AS_OF).select(
        F.regexp_extract("name", r"(\d+)$", 1).cast("bigint").alias("user_id"))
    return X.refresh_view(t.events, stale, "user_id", lambda rows: rows.groupBy("user_id", F.to_date("ts").alias("day")).agg(
        F.count(F.lit(1)).alias("n_events"), L.exact_mean("value").alias("avg_value")))


@query("extract_dimension", """
WITH d AS (SELECT l_returnflag, row_number() OVER (ORDER BY l_returnflag) AS returnflag_key FROM (SELECT DISTINCT l_returnflag FROM lineitem))
SELECT returnflag_key, l_linestatus, count(*) AS n_rows FROM lineitem JOIN d USING (l_returnflag) GROUP BY ALL""")
def extract_dimension(t):
    _, fact = X.extract_dimension(t.lineitem, "l_returnflag", "returnflag_key")
    return fact.groupBy("returnflag_key", "l_linestatus").agg(F.count(F.lit(1)).alias("n_rows"))


@query("surrogate_keys", """
WITH d AS (SELECT c_name, row_number() OVER (ORDER BY left(md5(c_name), 3), c_name) AS name_key FROM (SELECT DISTINCT c_name FROM customer))
SELECT c_custkey, name_key, c_mktsegment FROM customer JOIN d USING (c_name)""")
def surrogate_keys(t):
    _, keyed = X.surrogate_keys(t.customer, "c_name", "name_key")
    return keyed.select("c_custkey", "name_key", "c_mktsegment")


@query("retype_columns", """
SELECT o_orderkey, CAST(order_date AS DATE) AS order_date, try_cast(amount AS INTEGER) AS amount,
       CASE WHEN try_cast(amount AS INTEGER) IS NULL THEN 'amount=' || amount ELSE '' END AS rejected FROM (
  SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS order_date,
         CASE WHEN o_orderkey % 5 = 0 THEN o_orderpriority ELSE CAST(o_custkey AS VARCHAR) END AS amount FROM orders)""")
def retype_columns(t):
    amount = F.when(F.col("o_orderkey") % 5 == 0, F.col("o_orderpriority")).otherwise(F.col("o_custkey").cast("string"))
    text = t.orders.select("o_orderkey", F.date_format("o_orderdate", "yyyy-MM-dd").alias("order_date"), amount.alias("amount"))
    return X.retype_columns(text, {"order_date": "date", "amount": "int"})


@query("truncate_timestamps", """
SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') AS hour, count(*) AS n_events FROM events GROUP BY 1""")
def truncate_timestamps(t):
    cut = X.truncate_timestamps(t.events, "ts", "hour")
    return cut.groupBy(F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("hour")).agg(F.count(F.lit(1)).alias("n_events"))


@query("split_timestamp", """
SELECT event_id, CAST(ts AS DATE) AS ts_date, CAST(hour(ts) * 3600 + minute(ts) * 60 + floor(second(ts)) AS INTEGER) AS ts_second FROM events""")
def split_timestamp(t):
    return X.split_timestamp(t.events, "ts").select("event_id", "ts_date", "ts_second")


@query("excess_shared", """
SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) > 2""")
def excess_shared(t):
    """The order column repeats from group to group."""
    return X.excess_rows(t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey"), ["l_orderkey"], "l_linenumber", keep=2)


@query("apply_plan", """
WITH lost AS (SELECT count(*) AS n FROM labels l WHERE NOT EXISTS (SELECT 1 FROM documents d WHERE d.doc_id = l.doc_id)),
twins AS (SELECT count(*) AS n FROM (SELECT DISTINCT p_name, p_brand, p_type FROM part))
SELECT 'GW-010' AS fix_id, 'part[p_name,p_brand,p_type]' AS target, 'fixed' AS outcome, (SELECT n FROM twins) AS n_rows
UNION ALL SELECT 'WH-009', 'labels[doc_id]', 'fixed', (SELECT count(*) FROM labels) - (SELECT n FROM lost)
UNION ALL SELECT 'WH-009', 'nowhere[x]', 'skipped', NULL UNION ALL SELECT 'retention', 'labels', 'skipped', NULL""")
def apply_plan(t):
    """Orphans and repeated records repaired as planned, into the shared folder; what became of each target."""
    found = t.spark.createDataFrame(
        [("WH-009", "labels[doc_id]"), ("WH-009", "nowhere[x]"), ("GW-010", "part[p_name,p_brand,p_type]"), ("LH-021", "labels")],
        "rule_id string, target string")
    plan = X.fix_plan(found, fixes_frame(t.spark))
    known = transforms(parents={"doc_id": (t.documents, "doc_id")}, order={"part": "p_partkey"})
    done = run_plan(t.spark, plan, {"labels": t.labels, "part": t.part}, scratch_path(t.spark, "fixes"), known)
    copies = [t.spark.read.parquet(r.path).agg(F.count(F.lit(1)).alias("n_rows")).select(F.lit(r.path).alias("path"), "n_rows")
              for r in done.filter("path is not null").collect()]
    counted = copies[0]
    for c in copies[1:]:
        counted = counted.unionByName(c)
    return done.join(counted, "path", "left").select("fix_id", "target", "outcome", "n_rows")


@query("apply_plan_summary", """
WITH targets AS (
  SELECT 'part[p_name,p_brand,p_type]' AS target, 'GW-010' AS fix_id, 'fixed' AS outcome
  UNION ALL SELECT 'labels[doc_id]', 'WH-009', 'fixed' UNION ALL SELECT 'labels[no_column]', 'WH-009', 'failed'
  UNION ALL SELECT 'event ' || CAST(event_id AS VARCHAR), 'WH-009', 'skipped' FROM events WHERE event_type = 'error')
SELECT fix_id, count(*) AS n_targets, count(*) FILTER (WHERE outcome = 'fixed') AS n_fixed, count(*) FILTER (WHERE outcome = 'failed') AS n_failed,
       count(*) FILTER (WHERE outcome = 'skipped') AS n_skipped FROM targets GROUP BY fix_id""")
def apply_plan_summary(t):
    """Outcomes of a plan that was applied: targets fixed, one failed (no such column), findings by key skipped."""
    found = t.spark.createDataFrame(
        [("WH-009", "labels[doc_id]"), ("WH-009", "labels[no_column]"), ("GW-010", "part[p_name,p_brand,p_type]")], "rule_id string, target string")
    keys = t.events.filter("event_type = 'error'").select(F.lit("WH-009").alias("rule_id"), F.concat(F.lit("event "), F.col("event_id").cast("string")).alias("target"))
    found = found.unionByName(keys)
    plan = X.fix_plan(found, fixes_frame(t.spark))
    known = transforms(parents={"doc_id": (t.documents, "doc_id")}, order={"part": "p_partkey"})
    done = run_plan(t.spark, plan, {"labels": t.labels, "part": t.part}, scratch_path(t.spark, "fixes"), known)
    return X.fix_summary(done)


# what each transform of the catalog is tried on, and the rows of its copy
TRIED = {
    "add_audit_columns": ("orders", "SELECT count(*) FROM orders"), "propose_primary_key": ("nation[n_nationkey,n_regionkey]", "SELECT 1"),
    "compute_stats": ("orders", "SELECT 6"), "drop_orphans": ("labels[doc_id]", "SELECT count(*) FROM labels WHERE doc_id IN (SELECT doc_id FROM documents)"),
    "mask_columns": ("customer[c_name]", "SELECT count(*) FROM customer"), "fill_defaults": ("labels", "SELECT count(*) FROM labels"),
    "compact_files": ("lineitem", "SELECT count(*) FROM lineitem"), "partition_rewrite": ("orders", "SELECT count(*) FROM orders"),
    "retention_filter": ("events", "SELECT count(*) FROM events WHERE ts >= TIMESTAMP '2024-01-31' - INTERVAL 10 DAY"),
    "repair_view_source": ("views", "SELECT count(*) FROM part"), "refresh_view": ("events", "SELECT count(DISTINCT event_type) FROM events WHERE event_type IN ('view', 'error')"),
    "rewrite_expressions": ("expressions[expression]", "SELECT count(*) FROM part"), "fill_formats": ("expressions", "SELECT count(*) FROM part"),
    "fill_descriptions": ("expressions", "SELECT count(*) FROM part"), "clean_names": ("part[p_name]", "SELECT count(*) FROM part"),
    "hide_columns": ("documents[text]", "SELECT count(*) FROM documents"), "drop_constant_columns": ("nation", "SELECT count(*) FROM nation"),
    "drop_alias_records": ("part", "SELECT count(*) FROM part WHERE p_size >= 3"), "mark_date_table": ("part[p_name]", "SELECT count(*) FROM part"),
    "mark_keys": ("relations", "SELECT count(DISTINCT o_custkey % 2) FROM orders"), "single_direction": ("edges", "SELECT count(*) FROM nation"),
    "no_implicit_summary": ("summaries", "SELECT count(*) FROM part"),
    "trim_members": ("customer[c_nationkey]", "SELECT count(*) FROM (SELECT row_number() OVER (PARTITION BY c_nationkey) AS k FROM customer) WHERE k <= 3"),
    "dedup_records": ("part[p_brand]", "SELECT count(DISTINCT p_brand) FROM part"),
}
CATALOG = [(f, r, c.removeprefix("transform:").split(" ")[0]) for f, r, _, c in FIXES if c.startswith("transform:")]


@query("apply_catalog", " UNION ALL ".join(
    f"SELECT '{f}' AS fix_id, '{r}' AS rule_id, '{TRIED[n][0]}' AS target, 'fixed' AS outcome, ({TRIED[n][1]})::BIGINT AS n_rows" for f, r, n in CATALOG))
def apply_catalog(t):
    """Every transform of the catalog, applied to a table; rows of the copies."""
    part = t.part.withColumns({"name": F.concat(F.lit("m"), F.col("p_partkey").cast("string")), "fmt": F.lit(None).cast("string"), "about": F.lit("")})
    expressions = _expression(t).withColumns({"fmt": F.lit(None).cast("string"), "about": F.lit("")})
    tables = t.pick(["orders", "nation", "labels", "customer", "lineitem", "events", "documents"]) | {
        "part": part, "expressions": expressions,
        "views": part.select("name", F.lit("healthy").alias("state"), F.lit("t").alias("source_table"), F.lit("t | take 1").alias("query")),
        "relations": t.orders.select(F.concat(F.lit("orders.o_custkey -> customer.c"), (F.col("o_custkey") % 2).cast("string")).alias("pair")),
        "edges": t.nation.select("n_nationkey", F.when(F.col("n_regionkey") == 1, "both").otherwise("single").alias("cross_filter")),
        "summaries": t.part.select("p_partkey", F.when(F.col("p_size") > 10, "sum").otherwise("none").alias("summarize_by"))}
    candidates = t.spark.createDataFrame([("customer", "c0", True), ("customer", "c1", False)], "table_name string, column_name string, is_unique boolean")
    matches = part.select("name", F.lit("u").alias("new_source"), F.lit(1.0).alias("score"))
    about = {
        "orders": {"time": "o_orderdate", "bucket": F.year("o_orderdate")}, "labels": {"defaults": {"quality": 0}},
        "events": {"time": "ts", "as_of": AS_OF, "days": 10, "key": "event_type", "build": lambda df: df.groupBy("event_type").agg(F.count(F.lit(1)).alias("n")),
                   "stale": t.spark.createDataFrame([("view",), ("error",)], "event_type string")},
        "views": {"matches": matches}, "relations": {"candidates": candidates}, "customer": {"keep": 3},
        "expressions": {"name": "name", "format": "fmt", "description": "about", "expression": "expression"},
        "part": {"record": "p_partkey", "aliases": t.part.filter("p_size < 3").select("p_partkey")}}
    known = transforms({"doc_id": (t.documents, "doc_id")}, {"part": "p_partkey", "customer": "c_custkey"}, about)
    plan = fixes_frame(t.spark).filter("command like 'transform:%'")
    names = F.split(F.regexp_replace("command", "^transform:", ""), " ")[0]
    plan = plan.withColumns({"target": F.create_map(*[F.lit(x) for n, (of, _) in TRIED.items() for x in (n, of)])[names], "is_transform": F.lit(True)})
    done = run_plan(t.spark, plan, tables, scratch_path(t.spark, "catalog"), known)
    counts = [t.spark.read.parquet(r.path).agg(F.count(F.lit(1)).alias("n_rows")).select(F.lit(r.path).alias("path"), "n_rows")
              for r in done.filter("path is not null").collect()]
    return done.join(reduce(DataFrame.unionByName, counts), "path", "left").select("fix_id", "rule_id", "target", "outcome", "n_rows")
