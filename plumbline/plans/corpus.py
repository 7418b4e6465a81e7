"""Text-corpus queries over the sample tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.functions import fixed_values as V
from plumbline.operators import text as X
from plumbline.plans.registry import query

# patterns over the sample documents: (rule, pattern, pattern that clears it)
DOCUMENT_RULES = (
    ("T-01", r"license", None),
    ("T-02", r"[a-z0-9._%+-]+@[a-z0-9.-]+\.[a-z]{2,}", r"example\.com"),
    ("T-03", r"token =", None),
    ("T-04", r"\([0-9]{3}\) [0-9]{3}-[0-9]{4}", None),
    ("T-05", r"\|", r"\n"),
    ("T-06", r"(^|[^a-z0-9_])the\s+of", None),
)
DOCUMENT_COUNTS = (("C-01", r"(^|[^a-z])the[^a-z]", 20), ("C-02", r"[0-9]{3}-[0-9]{4}", 1), ("C-03", r"\.\n", 5))


def _rule_sql(rule: str, pattern: str, negated: str | None) -> str:
    text = f"SELECT doc_id, '{rule}' AS rule_id FROM documents WHERE regexp_matches(lower(text), '{pattern}')"
    return text + (f" AND NOT regexp_matches(lower(text), '{negated}')" if negated else "")


@query("pattern_audit", " UNION ALL ".join(_rule_sql(*r) for r in DOCUMENT_RULES))
def pattern_audit(t):
    return X.pattern_audit(t.documents.select("doc_id", "text"), "text", DOCUMENT_RULES)


@query("pattern_summary", "WITH hits AS (" + " UNION ALL ".join(_rule_sql(*r) for r in DOCUMENT_RULES) + """)
SELECT rule_id, count(*) AS n_hits, string_agg(CAST(doc_id AS VARCHAR), ', ' ORDER BY doc_id) FILTER (WHERE n <= 3) AS first_records
FROM (SELECT *, row_number() OVER (PARTITION BY rule_id ORDER BY doc_id) AS n FROM hits) GROUP BY rule_id""")
def pattern_summary(t):
    return X.rows_per_rule(X.pattern_audit(t.documents.select("doc_id", "text"), "text", DOCUMENT_RULES), 3, "doc_id")


def _expression(t):
    """Expressions over part columns in the style of report measures."""
    p = F.col("p_partkey")
    name = F.concat(F.lit("[m"), (p % 50).cast("string"), F.lit("]"))
    column = F.concat(F.lit("'part'["), F.col("p_type"), F.lit("]"))
    forms = [
        F.concat(F.lit("IFERROR("), name, F.lit(" / [qty], 0)")),
        F.concat(F.lit("SUMX('part', "), column, F.lit(")")),
        F.concat(F.lit("CALCULATE(CALCULATE(SUM("), column, F.lit(")), ALL('part'))")),
        F.concat(F.lit("0 + SUM("), column, F.lit(")")),
        F.concat(F.lit("EVALUATEANDLOG(SUM("), column, F.lit("))")),
        name,
        F.concat(F.lit("DIVIDE("), name, F.lit(", [qty])")),
        F.concat(F.lit("SUM("), column, F.lit(") +  0 ")),
    ]
    return t.part.select(
        "p_partkey", F.concat(F.lit("m"), p.cast("string")).alias("name"),
        F.element_at(F.array(*forms), (p % len(forms)).cast("int") + 1).alias("expression"))


EXPRESSIONS = """expressions AS (SELECT p_partkey, 'm' || CAST(p_partkey AS VARCHAR) AS name, CASE CAST(p_partkey % 8 AS INTEGER)
  WHEN 0 THEN 'IFERROR([m' || CAST(p_partkey % 50 AS VARCHAR) || '] / [qty], 0)'
  WHEN 1 THEN 'SUMX(''part'', ''part''[' || p_type || '])'
  WHEN 2 THEN 'CALCULATE(CALCULATE(SUM(''part''[' || p_type || '])), ALL(''part''))'
  WHEN 3 THEN '0 + SUM(''part''[' || p_type || '])'
  WHEN 4 THEN 'EVALUATEANDLOG(SUM(''part''[' || p_type || ']))'
  WHEN 5 THEN '[m' || CAST(p_partkey % 50 AS VARCHAR) || ']'
  WHEN 6 THEN 'DIVIDE([m' || CAST(p_partkey % 50 AS VARCHAR) || '], [qty])'
  ELSE 'SUM(''part''[' || p_type || ']) +  0 ' END AS expression FROM part)"""

# the lookahead rule has no counterpart in the comparison engine's regex dialect
SQL_PATTERNS = {r: (p, n) for r, p, n in V.EXPRESSION_PATTERNS}
SQL_PATTERNS["SM-002"] = (r"\]\s*/|\)\s*/", r"\]\s*/[/*]|\)\s*/[/*]")


@query("expression_audit", f"WITH {EXPRESSIONS} " + " UNION ALL ".join(
    f"SELECT p_partkey, '{r}' AS rule_id FROM expressions WHERE regexp_matches(lower(expression), '{p.replace(chr(39), chr(39) * 2)}')"
    + (f" AND NOT regexp_matches(lower(expression), '{n}')" if n else "") for r, (p, n) in SQL_PATTERNS.items()))
def expression_audit(t):
    return X.pattern_audit(_expression(t).select("p_partkey", "expression"), "expression", V.EXPRESSION_PATTERNS)


def _count_sql(rule: str, pattern: str, limit: int) -> str:
    n = f"len(regexp_extract_all(lower(text), '{pattern}'))"
    return f"SELECT doc_id, '{rule}' AS rule_id, CAST({n} AS INTEGER) AS n_hits FROM documents WHERE {n} > {limit}"


@query("occurrence_audit", " UNION ALL ".join(_count_sql(*r) for r in DOCUMENT_COUNTS))
def occurrence_audit(t):
    return X.occurrence_audit(t.documents.select("doc_id", "text"), "text", DOCUMENT_COUNTS)


@query("normalized_duplicates", r"""
WITH n AS (SELECT doc_id, regexp_replace(lower(text), '[\s\x{0B}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]+', '', 'g') AS norm FROM documents)
SELECT sha256(norm) AS digest, count(*) AS n_records, min(doc_id) AS first_record FROM n WHERE length(norm) > 5 GROUP BY 1 HAVING count(*) > 1""")
def normalized_duplicates(t):
    return X.normalized_duplicates(t.documents, "doc_id", "text")


@query("alias_records", """
WITH f AS (SELECT p_name, min(p_partkey) AS target_record FROM part GROUP BY p_name)
SELECT p_partkey, p_name, target_record FROM part JOIN f USING (p_name) WHERE p_partkey > target_record""")
def alias_records(t):
    return X.alias_records(t.part.select("p_partkey", "p_name"), "p_partkey", "p_name")


@query("alias_expressions", f"""WITH {EXPRESSIONS}
SELECT e.p_partkey, e.name, e.expression, o.p_partkey AS target_record FROM expressions e
JOIN expressions o ON e.expression = '[' || o.name || ']' AND e.name <> o.name""")
def alias_expressions(t):
    return X.alias_records(_expression(t), "p_partkey", "name", X.bracket_reference(F.col("expression")))


@query("missing_metadata", """
SELECT page_id, 'title' AS field FROM pages WHERE trim(regexp_extract(html, '<title>([^<]*)</title>', 1)) = ''
UNION ALL SELECT page_id, 'description' FROM pages WHERE trim(regexp_extract(html, '<meta name="description" content="([^"]*)"', 1)) = ''
UNION ALL SELECT page_id, 'heading' FROM pages WHERE trim(regexp_extract(html, '<h1[^>]*>([^<]*)<', 1)) = ''""")
def missing_metadata(t):
    pages = t.pages.select(
        "page_id", F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"),
        F.regexp_extract("html", '<meta name="description" content="([^"]*)"', 1).alias("description"),
        F.regexp_extract("html", "<h1[^>]*>([^<]*)<", 1).alias("heading"))
    return X.missing_metadata(pages, "page_id", ["title", "description", "heading"])


@query("missing_parts", """
SELECT 'document label' AS part, count(*) AS n_missing FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)
UNION ALL SELECT 'system turn', count(*) FROM (SELECT conv_id FROM conversations GROUP BY conv_id HAVING NOT bool_or(role = 'system'))""")
def missing_parts(t):
    docs = X.without_part(t.documents.select("doc_id"), "doc_id", t.labels, "doc_id")
    convs = X.without_part(t.conversations.select("conv_id").distinct(), "conv_id",
                           t.conversations.filter("role = 'system'"), "conv_id")
    return docs.agg(F.count(F.lit(1)).alias("n_missing")).select(F.lit("document label").alias("part"), "n_missing").unionByName(
        convs.agg(F.count(F.lit(1)).alias("n_missing")).select(F.lit("system turn").alias("part"), "n_missing"))


@query("referenced_columns", """
WITH called AS (SELECT p_partkey, ['s' || CAST(p_size AS VARCHAR), 'k' || CAST(p_partkey % 7 AS VARCHAR), lower(p_type), 'g' || CAST(p_partkey % 5 AS VARCHAR)] AS names FROM part)
SELECT column_name, count(*) AS n_uses FROM (SELECT p_partkey, unnest(names) AS column_name FROM called) GROUP BY 1""")
def referenced_columns(t):
    text = F.concat(
        F.lit("events | summarize avg(s"), F.col("p_size"), F.lit("), Max( k"), F.col("p_partkey") % 7,
        F.lit(" ) by "), F.lower("p_type"), F.lit(", g"), F.col("p_partkey") % 5, F.lit(" desc"))
    found = X.referenced_columns(t.part.select("p_partkey", text.alias("query")), "p_partkey", "query")
    return found.groupBy("column_name").agg(F.count(F.lit(1)).alias("n_uses"))


OVERLAP = """WITH a AS (SELECT item_id AS text_id, unnest(list_distinct(list_filter(regexp_split_to_array(lower(text), '[^a-z0-9]+'), lambda x: x <> ''))) AS token FROM benchmark),
n AS (SELECT text_id, CAST(count(*) AS INTEGER) AS n_tokens FROM a GROUP BY 1),
b AS (SELECT doc_id AS candidate_id, unnest(list_distinct(list_filter(regexp_split_to_array(lower(text), '[^a-z0-9]+'), lambda x: x <> ''))) AS token FROM documents),
pairs AS (SELECT text_id, candidate_id, CAST(count(*) AS INTEGER) AS n_shared FROM a JOIN b USING (token) GROUP BY ALL),
scored AS (SELECT text_id, candidate_id, n_shared, n_tokens, round(n_shared::DOUBLE / n_tokens, 4) AS score
           FROM pairs JOIN n USING (text_id) WHERE n_shared >= n_tokens * 0.5)
"""


@query("overlap_pairs", OVERLAP + "SELECT * FROM scored")
def overlap_pairs(t):
    return X.overlap_pairs(t.benchmark, "item_id", t.documents, "doc_id")


@query("best_source_match", OVERLAP + """
SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY text_id ORDER BY n_shared DESC, candidate_id) = 1""")
def best_source_match(t):
    return X.best_source_match(t.benchmark, "item_id", t.documents, "doc_id")


@query("format_inference", """
WITH names AS (SELECT p_partkey, CASE CAST(p_partkey % 6 AS INTEGER) WHEN 0 THEN 'Conversion Rate ' WHEN 1 THEN 'Unit PRICE ' WHEN 2 THEN 'average ' WHEN 3 THEN 'Sales pct '
  WHEN 4 THEN 'mean cost ' ELSE 'rows ' END || p_name AS name FROM part)
SELECT p_partkey, name, CASE WHEN regexp_matches(lower(name), 'pct|percent|ratio|rate') THEN '0.0%'
  WHEN regexp_matches(lower(name), 'price|cost|revenue|amount|sales|profit') THEN '$#,##0.00'
  WHEN regexp_matches(lower(name), 'avg|average|mean') THEN '#,##0.00' ELSE '#,0' END AS format FROM names""")
def format_inference(t):
    return X.format_inference(named_parts(t), "name")


def named_parts(t):
    stems = F.array(*[F.lit(s) for s in ("Conversion Rate ", "Unit PRICE ", "average ", "Sales pct ", "mean cost ", "rows ")])
    return t.part.select("p_partkey", F.concat(
        F.element_at(stems, (F.col("p_partkey") % 6).cast("int") + 1), "p_name").alias("name"))


@query("format_inference_expression", """
SELECT p_partkey, CASE WHEN p_partkey % 3 < 2 THEN '0.0%' ELSE '#,0' END AS format FROM part""")
def format_inference_expression(t):
    kind = F.col("p_partkey") % 3
    name = F.when(kind == 0, "% done").otherwise("rows done")
    text = F.when(kind == 0, "DIVIDE(a, b)").when(kind == 1, "Divide([percent of all], b)").otherwise("SUM(percent)")
    return X.format_inference(t.part.select("p_partkey", name.alias("name"), text.alias("text")), "name", expression="text").select("p_partkey", "format")
