"""Key and reference queries over the sample tables."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from plumbline.functions import fixed_values as V
from plumbline.operators import discovery as D
from plumbline.operators import integrity as I
from plumbline.operators import profile as P
from plumbline.plans.registry import query
from plumbline.plans.sample_sql import SAMPLE_COLUMNS, columns_of, profile_cell
from plumbline.session import cut_lineage
from plumbline.sources.facts import column_facts

KEYS = [(t, c, k) for t in SAMPLE_COLUMNS for c, k in columns_of(t) if re.search(V.KEY_NAME, c)]
KEY_PROFILE = "WITH profile AS (" + "\nUNION ALL ".join(profile_cell(*key) for key in KEYS) + ")\n"


def key_profile(t):
    return P.column_profile(t.pick(), columns=[c for _, c, _ in KEYS])


@query("key_candidates", KEY_PROFILE + """
SELECT table_name, column_name, n_rows, n_distinct, n_nulls, n_nulls = 0 AND n_distinct = n_rows AS is_unique FROM profile""")
def key_candidates(t):
    return I.key_candidates(key_profile(t))


ORDINALS = "(VALUES " + ", ".join(
    f"('{t}', '{c}', {i})" for t in SAMPLE_COLUMNS for i, (c, _) in enumerate(columns_of(t), 1)) + ") AS o(table_name, column_name, ordinal)"


@query("propose_primary_key", KEY_PROFILE + f"""
SELECT table_name, column_name, n_rows FROM profile JOIN {ORDINALS} USING (table_name, column_name)
WHERE n_nulls = 0 AND n_distinct = n_rows QUALIFY row_number() OVER (PARTITION BY table_name ORDER BY ordinal) = 1""")
def propose_primary_key(t):
    return I.propose_primary_key(I.key_candidates(key_profile(t)), column_facts(t.pick()))


@query("duplicate_keys", """
SELECT l_orderkey, l_linenumber, count(*) AS n_rows FROM lineitem GROUP BY ALL HAVING count(*) > 1""")
def duplicate_keys(t):
    return I.duplicate_keys(t.lineitem, ["l_orderkey", "l_linenumber"])


@query("orphan_rows", """
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey FROM lineitem l
WHERE l_orderkey IS NOT NULL AND NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_orderkey = l.l_orderkey AND o.o_orderstatus = 'F')""")
def orphan_rows(t):
    child = t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    return I.orphan_rows(child, t.orders.filter("o_orderstatus = 'F'"), [("l_orderkey", "o_orderkey")])


@query("orphan_summary", """
SELECT l_orderkey, count(*) AS n_rows FROM lineitem l
WHERE l_orderkey IS NOT NULL AND NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_orderkey = l.l_orderkey AND o.o_orderstatus = 'F')
GROUP BY l_orderkey""")
def orphan_summary(t):
    return I.orphan_summary(t.lineitem, t.orders.filter("o_orderstatus = 'F'"), ("l_orderkey", "o_orderkey"))


@query("unused_parents", """
SELECT doc_id, source, lang FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)""")
def unused_parents(t):
    return I.unused_parents(t.documents.select("doc_id", "source", "lang"), t.labels, [("doc_id", "doc_id")])


PAIRS = [
    ("orders", "o_custkey", "customer", "c_custkey"), ("lineitem", "l_orderkey", "orders", "o_orderkey"),
    ("lineitem", "l_partkey", "part", "p_partkey"), ("lineitem", "l_suppkey", "supplier", "s_suppkey"),
    ("lineitem", "l_partkey", "supplier", "s_suppkey"), ("customer", "c_nationkey", "nation", "n_nationkey"),
    ("supplier", "s_nationkey", "nation", "n_nationkey"), ("nation", "n_regionkey", "region", "r_regionkey"),
    ("labels", "doc_id", "documents", "doc_id"), ("documents", "doc_id", "labels", "doc_id"),
]


def _pair_sql(child: str, c: str, parent: str, p: str) -> str:
    has = f"EXISTS (SELECT 1 FROM {parent} p WHERE p.{p} = c.v)"
    return (f"SELECT '{child}.{c} -> {parent}.{p}' AS pair, count(*) AS n_child_values, "
            f"count(*) FILTER (WHERE {has}) AS n_contained, (SELECT count(DISTINCT {p}) FROM {parent}) AS n_parent_values, "
            f"round(count(*) FILTER (WHERE {has})::DOUBLE / count(*), 4) AS containment "
            f"FROM (SELECT DISTINCT {c} AS v FROM {child} WHERE {c} IS NOT NULL) c")


@query("fk_containment", " UNION ALL ".join(_pair_sql(*p) for p in PAIRS))
def fk_containment(t):
    """Containment of given pairs, whole or not."""
    return I.fk_discovery([(a, t[a], c, b, t[b], p) for a, c, b, p in PAIRS])


def _stem(column: str) -> str:
    return re.sub("^[a-z]{1,2}_", "", column)


def _reference_sql() -> str:
    """Every pair of columns of two tables whose names agree, tried one by one."""
    short = [(t, c, k) for t in SAMPLE_COLUMNS for c, k in columns_of(t)]
    parts = []
    for child, c, k in short:
        for parent, p, kind in short:
            if child != parent and _stem(c) == _stem(p) and k == kind:
                clean = {"i": "true", "d": f"(SELECT bool_and({{0}} = floor({{0}})) FROM {{1}})", "s": "(SELECT max(length({0})) <= 64 FROM {1})", "t": "true"}[k]
                parts.append(
                    f"SELECT '{child}' AS child_table, '{c}' AS child_column, '{parent}' AS parent_table, '{p}' AS parent_column, n_child_values, n_contained, "
                    f"(SELECT count({p}) FROM {parent}) AS n_parent_values, round(n_contained::DOUBLE / n_child_values, 4) AS containment FROM ("
                    f"SELECT count(*) AS n_child_values, count(*) FILTER (WHERE c IN (SELECT {p} FROM {parent} WHERE {p} IS NOT NULL)) AS n_contained "
                    f"FROM (SELECT DISTINCT {c} AS c FROM {child} WHERE {c} IS NOT NULL)) "
                    f"WHERE n_contained >= 0.9 * n_child_values AND n_contained > 0 AND (SELECT count({p}) = count(DISTINCT {p}) FROM {parent}) "
                    f"AND {clean.format(c, child)} AND {clean.format(p, parent)}")
    return "\nUNION ALL ".join(parts)


@query("fk_discovery", _reference_sql())
def fk_discovery(t):
    """References found in the data: no table, column or pair is named."""
    return D.references(t.pick(), threshold=0.9)


LINES = "(SELECT DISTINCT ON (l_orderkey, l_linenumber) * FROM lineitem ORDER BY ALL)"
LINE_COLUMNS = [c for c, _ in columns_of("lineitem")]


def _unique_sql() -> str:
    """All columns and pairs of columns, counted one by one."""
    def unique(*cols: str) -> str:
        return f"(SELECT count(*) FROM (SELECT DISTINCT {', '.join(cols)} FROM lines)) = (SELECT count(*) FROM lines)"

    parts = [f"SELECT '{c}' AS columns, 1 AS n_columns, (SELECT count(*) FROM lines) AS n_rows WHERE {unique(c)}" for c in LINE_COLUMNS]
    parts += [f"SELECT '{a}, {b}', 2, (SELECT count(*) FROM lines) WHERE {unique(a, b)} AND NOT {unique(a)} AND NOT {unique(b)}"
              for i, a in enumerate(LINE_COLUMNS) for b in LINE_COLUMNS[i + 1:]]
    return f"WITH lines AS MATERIALIZED {LINES}\n" + "\nUNION ALL ".join(parts)


def unique_lines(t):
    """``lineitem`` with (l_orderkey, l_linenumber) made unique: of equal keys the least row."""
    rest = [c for c in t.lineitem.columns if c not in ("l_orderkey", "l_linenumber")]
    least = t.lineitem.groupBy("l_orderkey", "l_linenumber").agg(F.min(F.struct(*rest)).alias("x"))
    return least.select("l_orderkey", "l_linenumber", "x.*").select(*t.lineitem.columns)


@query("composite_keys", _unique_sql())
def composite_keys(t):
    """Minimal unique sets of one or two columns; none is named."""
    return D.unique_column_sets(cut_lineage(unique_lines(t), "lines"), 2)


KEYED = {"lineitem": LINES, "orders": "orders", "nation": "nation", "conversations": "conversations"}


def _proposed_sql(table: str, source: str) -> str:
    cols = [c for c, _ in columns_of(table)]
    sets = [(c,) for c in cols] + [(a, b) for i, a in enumerate(cols) for b in cols[i + 1:]]

    def order(s):
        return len(s), -sum(bool(re.search(V.KEY_NAME, c)) for c in s), [cols.index(c) for c in s]

    ranked = sorted(sets, key=order)
    tried = " UNION ALL ".join(
        f"SELECT {k} AS k, '{', '.join(s)}' AS columns, {len(s)} AS n_columns, count(*) AS n_rows, (SELECT count(*) FROM (SELECT DISTINCT {', '.join(s)} FROM x)) AS d FROM x"
        for k, s in enumerate(ranked))
    return f"(WITH x AS MATERIALIZED (SELECT * FROM {source}) SELECT '{table}' AS table_name, columns, n_columns, n_rows FROM ({tried}) WHERE d = n_rows ORDER BY k LIMIT 1)"


@query("propose_composite_key", " UNION ALL ".join(_proposed_sql(*x) for x in KEYED.items()))
def propose_composite_key(t):
    tables = t.pick(KEYED) | {"lineitem": cut_lineage(unique_lines(t), "lines")}
    return D.propose_keys(tables, key_name=V.KEY_NAME)


STEPS = """WITH steps AS (
  SELECT event_type AS src, lead(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS dst FROM events
), edges AS (SELECT src, dst, count(*) AS n FROM steps WHERE dst IS NOT NULL GROUP BY ALL)
"""


def event_edges(t):
    return I.transitions(t.events, "user_id", ["ts", "event_id"], "event_type")


@query("transitions", STEPS + "SELECT src, dst, n FROM edges")
def transitions(t):
    return event_edges(t)


@query("reciprocal_edges", STEPS + """
SELECT a.src AS node_a, a.dst AS node_b, a.n AS n_forward, b.n AS n_backward
FROM edges a JOIN edges b ON a.src = b.dst AND a.dst = b.src WHERE a.src < a.dst""")
def reciprocal_edges(t):
    return I.reciprocal_edges(event_edges(t))


def _skew_sql(table: str, column: str) -> str:
    return (f"SELECT '{column}' AS column_name, count(*) AS n_keys, CAST(sum(n) AS BIGINT) AS n_rows, max(n) AS max_rows, "
            f"quantile_cont(n, 0.5)::DOUBLE AS median_rows, round(max(n)::DOUBLE / sum(n), 6) AS top_share "
            f"FROM (SELECT {column}, count(*) AS n FROM {table} GROUP BY 1)")


@query("fk_skew", " UNION ALL ".join(_skew_sql(*p) for p in (
    ("lineitem", "l_partkey"), ("orders", "o_custkey"), ("events", "user_id"))))
def fk_skew(t):
    return (I.fk_skew(t.lineitem, "l_partkey").unionByName(I.fk_skew(t.orders, "o_custkey"))
            .unionByName(I.fk_skew(t.events, "user_id")))


@query("fk_discovery_types", _pair_sql("orders", "o_custkey", "customer", "c_custkey"))
def fk_discovery_types(t):
    """A reference kept as double against a whole-number key."""
    orders = t.orders.withColumn("o_custkey", F.col("o_custkey").cast("double"))
    return I.fk_discovery([("orders", orders, "o_custkey", "customer", t.customer, "c_custkey")])
