"""Profile queries over the sample tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.operators import profile as P
from plumbline.plans.registry import query
from plumbline.plans.sample_sql import counts_sql, facts_sql, profile_sql, with_profile
from plumbline.sources.facts import column_facts


@query("column_profile", profile_sql())
def column_profile(t):
    return P.column_profile(t.pick())


@query("column_profile_hybrid", profile_sql())
def column_profile_hybrid(t):
    """Exact and sketched counts; the sketches, which SQL can't repeat, must lie within a tenth."""
    both = P.column_profile(t.pick(), mode="hybrid")
    near = F.abs(F.col("approx_distinct") - F.col("n_distinct")) <= 0.1 * F.col("n_distinct") + 1
    return both.withColumn("n_distinct", F.when(near, F.col("n_distinct"))).drop("approx_distinct")


@query("table_overview", with_profile("""
SELECT table_name, count(*) AS n_columns, max(n_distinct) AS est_rows,
       CAST(sum(max_len) AS BIGINT) AS total_max_len,
       CASE WHEN sum(max_len) > 5000 THEN 'large' WHEN sum(max_len) > 1000 THEN 'medium' ELSE 'small' END AS memory_class
FROM profile GROUP BY table_name"""))
def table_overview(t):
    return P.table_overview(P.column_profile(t.pick()))


@query("memory_hotspots", with_profile("""
SELECT table_name, column_name, n_distinct, max_len, n_distinct * max_len AS memory_cost,
       CASE WHEN n_distinct * max_len > 1000000 THEN 'very high' WHEN n_distinct * max_len > 100000 THEN 'high'
            WHEN n_distinct * max_len > 10000 THEN 'medium' ELSE 'low' END AS weight
FROM profile WHERE max_len > 0 AND n_distinct > 0
ORDER BY memory_cost DESC, table_name, column_name LIMIT 20"""))
def memory_hotspots(t):
    return P.memory_hotspots(P.column_profile(t.pick()))


@query("cardinality_histogram", with_profile("""
SELECT CASE WHEN n_distinct <= 1 THEN '1' WHEN n_distinct <= 10 THEN '2-10' WHEN n_distinct <= 100 THEN '11-100'
            WHEN n_distinct <= 10000 THEN '101-10K' WHEN n_distinct <= 1000000 THEN '10K-1M' ELSE '>1M' END AS bucket,
       count(*) AS n_columns
FROM profile GROUP BY 1"""))
def cardinality_histogram(t):
    return P.cardinality_histogram(P.column_profile(t.pick()))


@query("null_share", with_profile("""
SELECT table_name, column_name, n_rows, n_nulls,
       CASE WHEN n_rows = 0 THEN 0.0::DOUBLE ELSE round(n_nulls::DOUBLE / n_rows, 4) END AS null_share
FROM profile"""))
def null_share(t):
    return P.null_share(P.column_profile(t.pick()))


@query("type_distribution", with_profile(f"""
SELECT facts.data_type, count(*) AS n_columns, CAST(sum(coalesce(p.n_rows - p.n_nulls, 0)) AS BIGINT) AS n_values,
       CAST(sum(coalesce(p.n_nulls, 0)) AS BIGINT) AS n_nulls
FROM {facts_sql()} LEFT JOIN profile p USING (table_name, column_name) GROUP BY facts.data_type"""))
def type_distribution(t):
    tables = t.pick()
    return P.type_distribution(column_facts(tables), P.column_profile(tables))


@query("row_count_classes", f"""
SELECT table_name, n_rows, CASE WHEN n_rows = 0 THEN 'empty' WHEN n_rows <= 10 THEN 'near-empty'
       WHEN n_rows > 10000 THEN 'large' ELSE 'normal' END AS row_class
FROM ({counts_sql()})""")
def row_count_classes(t):
    return P.row_count_classes(P.row_counts(t.pick()), large=10_000)


@query("wide_tables", f"""
SELECT w.table_name, w.n_columns, CASE WHEN w.n_columns > 10 THEN 'over 10' WHEN w.n_columns > 8 THEN 'over 8'
       ELSE 'over 5' END AS verdict, c.n_rows
FROM (SELECT table_name, count(*) AS n_columns FROM {facts_sql()} GROUP BY table_name HAVING count(*) > 5) w
JOIN ({counts_sql()}) c USING (table_name)""")
def wide_tables(t):
    tables = t.pick()
    wide = P.wide_tables(column_facts(tables), limits=(5, 8, 10))
    return wide.join(P.row_counts(tables), "table_name")


@query("not_null_defaults", """
WITH cells AS (
  SELECT 'orders' AS table_name, 'o_orderstatus' AS column_name, o_orderstatus AS value FROM orders
  UNION ALL SELECT 'orders', 'o_orderpriority', o_orderpriority FROM orders
  UNION ALL SELECT 'part', 'p_brand', p_brand FROM part
  UNION ALL SELECT 'part', 'p_type', p_type FROM part
), counted AS (SELECT table_name, column_name, value, count(*) AS n FROM cells GROUP BY ALL)
SELECT table_name, column_name, value, n FROM counted
QUALIFY row_number() OVER (PARTITION BY table_name, column_name ORDER BY n DESC, value) = 1""")
def not_null_defaults(t):
    orders = P.modal_values(t.orders, ["o_orderstatus", "o_orderpriority"])
    part = P.modal_values(t.part, ["p_brand", "p_type"])
    return orders.select(F.lit("orders").alias("table_name"), "*").unionByName(
        part.select(F.lit("part").alias("table_name"), "*"))

