"""SQL over the sample tables that several reference queries share."""

from __future__ import annotations

# declared scalar columns of the sample tables: i integer, d double, s string, t timestamp
SAMPLE_COLUMNS = {
    "region": "r_regionkey:i r_name:s",
    "nation": "n_nationkey:i n_name:s n_regionkey:i",
    "customer": "c_custkey:i c_name:s c_nationkey:i c_acctbal:d c_mktsegment:s",
    "supplier": "s_suppkey:i s_name:s s_nationkey:i s_acctbal:d",
    "part": "p_partkey:i p_name:s p_brand:s p_type:s p_size:i p_retailprice:d",
    "orders": "o_orderkey:i o_custkey:i o_orderstatus:s o_totalprice:d o_orderdate:t o_orderpriority:s",
    "lineitem": "l_orderkey:i l_partkey:i l_suppkey:i l_linenumber:i l_quantity:d l_extendedprice:d "
                "l_discount:d l_tax:d l_returnflag:s l_linestatus:s l_shipdate:t",
    "events": "event_id:i ts:t user_id:i event_type:s value:d props:s",
    "documents": "doc_id:i text:s lang:s source:s n_chars:i",
    "embeddings": "vec_id:i label:i",
    "pages": "page_id:i url:s html:s",
    "benchmark": "item_id:i text:s",
    "labels": "doc_id:i quality:i toxic:i",
    "conversations": "conv_id:i turn:i role:s text:s",
}
NARROW_COLUMNS = (
    "r_regionkey n_nationkey n_regionkey c_nationkey s_nationkey p_size l_linenumber label "
    "o_orderstatus quality toxic"
).split()
KINDS = {"i": "number", "d": "number", "s": "string", "t": "date"}


def columns_of(table: str) -> list[tuple[str, str]]:
    return [tuple(c.split(":")) for c in SAMPLE_COLUMNS[table].split()]


def profile_cell(table: str, column: str, code: str, source: str | None = None, expr: str | None = None) -> str:
    """One profile row of one column; ``source`` may be a subquery, ``expr`` an expression."""
    c = expr or column
    shown = {
        "i": "cast({}({}) as varchar)",
        "d": "(SELECT CASE WHEN v::decimal(38,6)::double = v THEN v::decimal(38,6)::varchar ELSE v::varchar END FROM (SELECT {}({}) AS v))",
        "s": "{}({})",
        "t": "strftime({}({}), '%Y-%m-%d %H:%M:%S.%f')",
    }[code]
    longest = f"coalesce(max(length({c})), 0)" if code == "s" else "0"
    return (
        f"SELECT '{table}' AS table_name, '{column}' AS column_name, '{KINDS[code]}' AS kind, "
        f"count(*) AS n_rows, count(*) - count({c}) AS n_nulls, count(DISTINCT {c}) AS n_distinct, "
        f"{shown.format('min', c)} AS min_value, {shown.format('max', c)} AS max_value, "
        f"CAST({longest} AS BIGINT) AS max_len FROM {source or table}"
    )


def profile_sql(tables: list[str] | None = None) -> str:
    return "\nUNION ALL\n".join(
        profile_cell(t, c, k) for t in (tables or list(SAMPLE_COLUMNS)) for c, k in columns_of(t))


def with_profile(body: str, tables: list[str] | None = None, extra: str = "") -> str:
    more = f"\nUNION ALL\n{extra}" if extra else ""
    return f"WITH profile AS (\n{profile_sql(tables)}{more}\n)\n{body}"


def counts_sql() -> str:
    return "\nUNION ALL\n".join(
        f"SELECT '{t}' AS table_name, count(*) AS n_rows FROM {t}" for t in SAMPLE_COLUMNS)


def facts_sql() -> str:
    """(table_name, column_name, data_type) as Spark declares them."""
    types = {"d": "double", "s": "string", "t": "timestamp_ntz"}
    rows = []
    for t in SAMPLE_COLUMNS:
        for c, k in columns_of(t):
            narrow = c in NARROW_COLUMNS
            rows.append(f"('{t}', '{c}', '{types.get(k) or ('int' if narrow else 'bigint')}')")
        if t == "embeddings":
            rows.append("('embeddings', 'embedding', 'array<float>')")
    return "(VALUES " + ", ".join(rows) + ") AS facts(table_name, column_name, data_type)"
