"""Expressions, graphs, keys, reports and repairs on small fixtures."""

import random

import pytest
from conftest import rows
from pyspark.sql import functions as F

from plumbline.functions import fixed_values as V
from plumbline.functions import predicates as P
from plumbline.operators import fixes as X
from plumbline.operators import graph as G
from plumbline.operators import integrity as I
from plumbline.operators import report as R
from plumbline.operators import text as T
from plumbline.plans.audit import Inputs, run_audit
from plumbline.plans.catalog import FIXES, RULES, fixes_frame, rules_frame
from plumbline.sources.facts import pick, truthy


@pytest.fixture(scope="module")
def corpus(spark):
    return spark.createDataFrame([
        (1, "m1", "IFERROR(DIVIDE([a],[b]), 0)", True, "0", "x"),
        (2, "m2", "SUMX('T', 'T'[c])", True, None, None),
        (3, "m3", "EVALUATEANDLOG(SUM(T[x]))", True, "", " "),
        (4, "v1", "SELECT * FROM t WITH (NOLOCK)", False, None, None),
        (5, "m5", "sumx('T',  'T'[c])", True, "0", "x"),
        (6, "m6", "[m1]", True, "0", "x"),
        (7, "m7", "[m7]", True, "0", "x"),
        (8, "m8", "SUM(T[x]) + 0", True, "0", "x"),
        (9, "m9", "CALCULATE(CALCULATE([a]), FILTER(ALL(T), 1))", True, "0", "x"),
        (10, "m10", "[a] / [b]", True, "0", "x"),
        (11, "m11", "CALCULATE([a], ALLSELECTED(T), ALL(T))", True, "0", "x"),
        (12, "m12", "1 - DIVIDE([a], [b])", True, "0", "x"),
        (13, "m13", "[a] // comment", True, "0", "x"),
        (14, "m14", None, True, "0", "x"),
    ], "id int, name string, text string, is_visible boolean, format string, description string")


def test_expression_patterns(corpus):
    hits = T.pattern_audit(corpus.select("id", "text"), "text", V.EXPRESSION_PATTERNS)
    got = {}
    for i, rule in rows(hits, "id", "rule_id"):
        got.setdefault(rule, []).append(i)
    assert {r: sorted(v) for r, v in got.items()} == {
        "SM-001": [1], "SM-002": [10], "SM-003": [3], "SM-007": [1, 8], "SM-011": [12], "SM-014": [2, 5],
        "SM-016": [9], "SM-024": [9], "WH-007": [4], "WH-043": [4]}
    assert rows(T.occurrence_audit(corpus.select("id", "text"), "text", V.OCCURRENCE_PATTERNS), "id", "rule_id", "n_hits") == [(9, "SM-013", 2)]


def test_duplicates_and_aliases(corpus):
    assert rows(T.normalized_duplicates(corpus, "id", "text"), "n_records", "first_record") == [(2, 2)]
    aliases = T.alias_records(corpus.select("id", "name", "text"), "id", "name", T.bracket_reference(F.col("text")))
    assert rows(aliases, "id", "target_record") == [(6, 1)]
    assert X.drop_alias_records(corpus, "id", aliases).count() == 13
    blank = T.missing_metadata(corpus, "id", ["format", "description"], F.col("is_visible"))
    assert rows(blank) == [(2, "description"), (2, "format"), (3, "description"), (3, "format")]


def test_rewrites(corpus):
    got = {r.id: r.rewritten for r in X.rewrite_expressions(corpus, "text").filter("is_changed").collect()}
    assert got[1] == "IF(ISERROR(DIVIDE([a],[b])), 0, DIVIDE([a],[b]))"
    assert got[2] == "SUM('T'[c])" and got[3] == "SUM(T[x])" and got[8] == "SUM(T[x])"
    assert 10 not in got and 6 not in got
    again = X.rewrite_expressions(X.rewrite_expressions(corpus, "text").select("id", F.col("rewritten").alias("text")), "text")
    assert again.filter("is_changed and id <> 1").count() == 0


def test_names(spark):
    df = spark.createDataFrame([(" a\tb ",), ("x\n\n y",), ("ok",)], "n string")
    assert rows(X.clean_names(df, "n"), "cleaned", "is_changed") == [("a b", True), ("ok", False), ("x y", True)]
    words = spark.createDataFrame([(w,) for w in ("paid", "orderId", "order_id", "id", "pk", "o_orderkey", "grid", "KEY")], "n string")
    assert [r.n for r in words.filter(P.key_like(F.col("n"))).collect()] == ["orderId", "order_id", "id", "pk", "o_orderkey", "KEY"]
    layers = spark.createDataFrame([("raw_gold",), ("Curated",), ("x",)], "n string").select(P.layer(F.col("n")).alias("l"))
    assert [r.l for r in layers.collect()] == ["bronze", "gold", None]
    odd = spark.createDataFrame([("True", 1), ("no", 2), (None, 3)], "a string, i int")
    assert [r.x for r in odd.select(truthy(F.col("a")).alias("x")).collect()] == [True, False, False]
    assert [r.x for r in odd.select(pick(odd, "missing", "a", default="d").alias("x")).collect()] == ["True", "no", "d"]


def test_formats(spark):
    df = spark.createDataFrame([("Conversion Rate", None), ("Sales", ""), ("Avg size", None), ("Rows", None), ("Kept", "0.00")], "n string, f string")
    assert dict(rows(X.fill_formats(df, "n", "f"))) == {
        "Conversion Rate": "0.0%", "Sales": "$#,##0.00", "Avg size": "#,##0.00", "Rows": "#,0", "Kept": "0.00"}


def test_overlap_pairs_equal_brute_force(spark):
    rng = random.Random(3)
    vocabulary = ["the", "of", "and"] * 30 + [f"w{i}" for i in range(60)]

    def words(n):
        return " ".join(rng.choice(vocabulary) for _ in range(n))
    texts = [(i, words(rng.randrange(1, 14))) for i in range(30)] + [(99, "!!!")]
    docs = [(i, words(rng.randrange(1, 60))) for i in range(200)]
    for score in (0.3, 0.5, 0.8, 1.0):
        got = T.overlap_pairs(spark.createDataFrame(texts, "a int, text string"), "a", spark.createDataFrame(docs, "b int, text string"), "b", min_score=score)
        want = []
        for a, x in texts:
            x = set(x.split()) - {"!!!"}
            want += [(a, b, len(x & set(y.split()))) for b, y in docs if x and len(x & set(y.split())) >= score * len(x) - 1e-9]
        assert rows(got, "text_id", "candidate_id", "n_shared") == sorted(want, key=repr)


def test_referenced_columns(spark):
    df = spark.createDataFrame([(1, "T | summarize avg(a), Percentile( b ) by c, d desc\n| take 5"), (2, "T | take 5")], "id int, q string")
    assert rows(T.referenced_columns(df, "id", "q")) == [(1, "a"), (1, "b"), (1, "c"), (1, "d")]


def test_keys_and_references(spark):
    child = spark.createDataFrame([(1, 10), (2, None), (3, 11), (4, 11)], "id int, p int")
    parent = spark.createDataFrame([(10,), (12,)], "p int")
    assert rows(I.orphan_rows(child, parent, [("p", "p")]), "id") == [(3,), (4,)]  # a null reference is no orphan
    assert rows(I.orphan_summary(child, parent, ("p", "p"))) == [(11, 2)]
    assert rows(I.unused_parents(parent, child, [("p", "p")])) == [(12,)]
    assert rows(X.drop_orphans(child, parent, [("p", "p")]), "id") == [(1,)]
    found = I.fk_discovery([("c", child, "p", "d", parent, "p")])
    assert rows(found, "pair", "n_child_values", "n_contained", "containment") == [("c.p -> d.p", 2, 1, 0.5)]


def test_graph(spark):
    edges = spark.createDataFrame([("a", "b", "both", "true", "none"), ("b", "a", "2", "false", "sum"), ("a", "c", "single", "1", None),
                                   ("a", "a", None, "0", "")], "src string, dst string, cross_filter string, is_active string, summarize_by string")
    got = {r.check: (r.n_hits, r.status) for r in G.edge_flags(edges).collect()}
    assert got == {"bidirectional": (2, "WARN"), "inactive": (2, "WARN"), "implicit_summary": (1, "WARN")}
    four = edges.withColumn("cross_filter", F.lit("both"))
    assert G.edge_flags(four).filter("check = 'bidirectional'").first().status == "FAIL"
    assert G.edge_flags(edges.filter("false")).filter("status <> 'N/A'").count() == 0
    assert rows(I.reciprocal_edges(edges.withColumn("n", F.lit(1))), "node_a", "node_b") == [("a", "b")]
    nodes = spark.createDataFrame([("a",), ("z",), ("Date dim",)], "node string")
    assert rows(G.disconnected_nodes(nodes, "node", edges, exempt="date|calendar")) == [("z",)]
    assert rows(G.node_degree(edges, 4)) == [("a", 5)]
    fixed = X.single_direction(edges)
    assert fixed.filter("is_changed").count() == 2 and X.single_direction(fixed).filter("is_changed").count() == 0


def test_members_versions_status(spark):
    members = spark.createDataFrame([("six", f"m{i}", "Admin") for i in range(6)] + [("five", f"m{i}", "Admin") for i in range(5)],
                                    "g string, m string, role string")
    assert rows(G.excess_members(members, ["g"], 5)) == [("six", 6)]
    kept = X.trim_members(members, ["g"], "m")
    assert G.excess_members(kept, ["g"], 5).count() == 0 and kept.count() == 10
    versions = spark.createDataFrame([("3000.1",), ("2999.99",), ("3000",), ("",), (None,), ("x.1",)], "v string")
    assert rows(G.version_check(versions, "v", (3000,))) == [("2999.99",), ("x.1",)]
    status = spark.createDataFrame([("a", "Live"), ("b", ""), ("c", "Down"), ("c", "live")], "n string, s string")
    assert dict(rows(G.status_health(status, "n", "s", ("live",)), "n", "status")) == {"a": "PASS", "b": "PASS", "c": "FAIL"}


def test_masks_and_defaults(spark):
    df = spark.createDataFrame([("jo@x.org", "555-123-4567", "secret", 7), (None, None, None, None)], "email string, phone string, note string, n int")
    got = X.mask_columns(df, ["email", "phone", "note", "n"]).collect()
    assert tuple(got[0]) == ("jXXX@XXXX.com", "XXX-XXX-4567", "xxxx", 0) and tuple(got[1]) == (None, None, None, None)
    filled = X.fill_defaults(df).collect()[1]
    assert tuple(filled) == ("", "", "", 0)
    typed = X.retype_columns(spark.createDataFrame([("1", "2024-01-01"), ("x", "bad"), (None, None)], "a string, d string"), {"a": "int", "d": "date"})
    assert [r.rejected for r in typed.collect()] == ["", "a=x; d=bad", ""]


def test_columns_and_keys_repairs(spark):
    df = spark.createDataFrame([(1, "x", "k"), (2, "x", "j"), (3, "x", None)], "id int, same string, name string")
    assert X.drop_constant_columns(df).columns == ["id", "name"]
    dim, keyed = X.surrogate_keys(df, "name", "name_key")
    assert sorted(r.name_key for r in dim.collect()) == [1, 2] and keyed.count() == 3
    dim, fact = X.extract_dimension(df, "name", "name_key")
    assert rows(dim) == [(1, "j"), (2, "k")] and rows(fact, "id", "name_key") == [(1, 2), (2, 1), (3, None)]
    many, _ = X.extract_dimension(spark.range(5000).withColumn("v", F.col("id") % 3000), "v", "k")
    assert many.filter("k <> v + 1").count() == 0 and many.count() == 3000
    audited = X.add_audit_columns(df.withColumn("Created_At", F.lit(1)), F.lit(2))
    assert audited.columns == ["id", "same", "name", "Created_At", "updated_at"]


def test_view_triage(spark):
    views = spark.createDataFrame([("ok", "t", "t | count", "True", 1), ("off", "t", "q", True, "0"), ("sick", "t", "q", "false", "true"),
                                   ("lost", "gone", "gone | take 1", False, True)][:0] or
                                  [("ok", "t", "t | count", "True", "1"), ("off", "t", "q", "true", "0"), ("sick", "t", "q", "false", "true"),
                                   ("lost", "gone", "gone | take 1", "False", "True"), ("bare", "gone2", "q", "False", "True")],
                                  "name string, source_table string, query string, is_healthy string, is_enabled string")
    tables = spark.createDataFrame([("t",), ("t2",)], "name string")
    triaged = X.view_triage(views, tables)
    matches = spark.createDataFrame([("lost", "t2", 0.5)], "name string, new_source string, score double")
    got = {r.name: (r.action, r.new_query) for r in X.repair_view_source(triaged, matches).collect()}
    assert got == {"ok": ("none", None), "off": ("enable", None), "sick": ("investigate", None),
                   "lost": ("recreate", "t2 | take 1"), "bare": ("no match", None)}


# ---- report and plans ----

def test_catalog():
    assert len(RULES) == 159 and len({r[0] for r in RULES}) == 159
    assert len(FIXES) == 59 and {f[1] for f in FIXES} <= {r[0] for r in RULES}


def test_report(spark):
    found = spark.createDataFrame([("SM-B01", f"t{i:02d}") for i in range(7)] + [("GW-010", "a|b")], "rule_id string, target string")
    rules = rules_frame(spark, ["SM-B01", "GW-010", "SM-B04", "WH-001", "LH-003"])
    results = R.findings_to_rules(found, rules, absent=("LH-003",), errors={"WH-001": "no access"}).cache()
    got = {r.rule_id: (r.status, r.n_issues, r.details) for r in results.collect()}
    assert got["SM-B01"] == ("FAIL", 7, "7 issue(s): t00, t01, t02, t03, t04 +2 more")
    assert got["GW-010"][0] == "WARN" and got["SM-B04"][0] == "PASS" and got["LH-003"][0] == "N/A"
    assert got["WH-001"] == ("ERROR", 0, "no access")
    assert [r.rule_id for r in R.issue_table(results).collect()] == ["SM-B01", "WH-001", "GW-010"]
    s = R.status_summary(results).first()
    assert (s.n_rules, s.n_pass, s.n_fail, s.n_warn, s.n_na, s.n_error) == (5, 1, 1, 1, 1, 1)
    text = R.render(results, "Audit", "2024-01-31")
    assert "**5 rules**: 1 passed, 1 failed" in text and "a\\|b" in text
    assert "All rules passed." in R.render(results.filter("status = 'PASS'"), "Audit", "now")


def test_findings_sink(spark, tmp_path):
    found = R.findings(spark.createDataFrame([("t", "c")], "table_name string, column_name string"), "SM-B04")
    for day in ("2024-01-30", "2024-01-31"):
        R.write_findings(found, str(tmp_path / "f"), day)
    back = spark.read.parquet(str(tmp_path / "f"))
    assert rows(back, "target") == [("t[c]",), ("t[c]",)]
    assert rows(back.select("scan_date").distinct().withColumn("scan_date", F.col("scan_date").cast("string"))) == [("2024-01-30",), ("2024-01-31",)]


def test_fix_plan(spark):
    found = spark.createDataFrame([("LH-020", "sales"), ("LH-020", "sales"), ("LH-026", "sales"), ("XX", "y")], "rule_id string, target string")
    default = X.fix_plan(found, fixes_frame(spark))
    assert rows(default, "fix_id", "target") == [("auto-optimize", "sales")]
    assert default.first().command.startswith("ALTER TABLE sales SET TBLPROPERTIES ('delta.autoOptimize.optimizeWrite' = 'true'")
    assert rows(X.fix_plan(found, fixes_frame(spark), ["v-order"]), "fix_id") == [("v-order",)]


def test_audit_with_every_input(spark, t, corpus):
    ntz = "timestamp_ntz"
    inputs = Inputs(
        settings=spark.createDataFrame([("table", "orders", {"delta.checkpointInterval": "99"}), ("database", "main", {}), ("store", "s", {})],
                                       "entity_kind string, entity string, properties map<string,string>"),
        expressions=corpus, as_of="2024-01-31 00:00:00",
        query_log=t.events.select(F.col("event_id").alias("query_id"), F.lit("q").alias("query_text"), F.col("event_type").alias("command_type"),
                                  F.lit("db").alias("database"), F.col("ts").alias("start_time"), (F.col("value") * 1000).alias("elapsed_ms"),
                                  F.when(F.col("event_type") == "error", "Failed").otherwise("Succeeded").alias("status")),
        ingest=t.events.select(F.col("user_id").cast("string").alias("entity"), "ts"),
        views=spark.createDataFrame([("v", False, True, None)], f"name string, is_healthy boolean, is_enabled boolean, last_run {ntz}"),
        edges=spark.createDataFrame([("a", "b", "both", "true", "none")], "src string, dst string, cross_filter string, is_active string, summarize_by string"),
        nodes=spark.createDataFrame([("a",), ("c",)], "node string"),
        members=spark.createDataFrame([("g", f"m{i}", "Admin") for i in range(6)], "group_name string, member string, role string"),
        entities=spark.createDataFrame([("gateway", "g", "Down", "2999.1")], "kind string, name string, status string, version string"),
        gateways=spark.createDataFrame([("g1", "OnPremises", ""), ("p", "Personal", "")], "id string, type string, display_name string"),
        connections=spark.createDataFrame([("c1", "gone", "n", None, "")], "id string, gateway_id string, display_name string, privacy_level string, credential_type string"),
        datasources=spark.createDataFrame([("d1", "g1", "sql", "x"), ("d2", "g1", "sql", "x")], "id string, gateway_id string, type string, details string"),
        files=spark.createDataFrame([("f", f"p{i}", 1) for i in range(11)], "table_name string, path string, size long"),
        actions=spark.createDataFrame([("f", i) for i in range(101)], "table_name string, version long"),
    )
    got = {r.rule_id: r.status for r in run_audit(t.pick(["orders", "customer"]), [("orders", "o_custkey", "customer", "c_custkey")], inputs=inputs).collect()}
    assert len(got) == 159
    fail = {"WH-023", "WH-024", "EH-008", "EH-006", "SM-003", "GW-001", "LH-019", "WH-026", "WH-040"}
    warn = {"SM-001", "SM-005", "SM-012", "SM-013", "SM-015", "SM-021", "SM-023", "WH-025", "LH-030", "GW-002", "GW-003", "GW-006",
            "GW-007", "GW-008", "GW-010", "GW-011", "GW-012", "LH-022", "EH-025", "EH-004", "EH-014"}
    assert {r for r in fail if got[r] != "FAIL"} == set() and {r for r in warn if got[r] != "WARN"} == set()
    assert got["EH-017"] == "PASS" and got["EH-026"] == "PASS" and got["WH-009"] == "PASS"
    assert got["LH-016"] == "N/A" and "ERROR" not in got.values()
