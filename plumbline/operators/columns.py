"""Column-content audits: rules over a profile, and the same questions asked of the data."""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from plumbline.functions import fixed_values as V
from plumbline.functions import predicates as P
from plumbline.operators.spread import exact_percentile

# ---- rules over a profile: one row per column, so the window per table is small ----
# Each rule is a condition, so an audit can evaluate all of them in one pass.


def with_table_max(profile: DataFrame) -> DataFrame:
    return profile.withColumn("max_distinct", F.max("n_distinct").over(W.partitionBy("table_name")))


def is_high_card_text(min_len: int = 100, min_distinct: int = 10_000, share: float = 0.7) -> Column:
    return F.expr(f"max_len > {min_len} and n_distinct > {min_distinct} and n_distinct > max_distinct * {share}D")


def high_card_text(profile: DataFrame, **limits) -> DataFrame:
    return with_table_max(profile).filter(is_high_card_text(**limits)).select(
        "table_name", "column_name", "n_distinct", "max_distinct", "max_len")


def is_free_text(min_len: int = 200, min_distinct: int = 100) -> Column:
    return F.expr(f"max_len > {min_len} and n_distinct > {min_distinct}") & P.free_text_name(F.col("column_name"))


def free_text_columns(profile: DataFrame, **limits) -> DataFrame:
    return profile.filter(is_free_text(**limits)).select("table_name", "column_name", "n_distinct", "max_len")


def is_guid(lengths: tuple[int, int] = (32, 40), min_distinct: int = 1000) -> Column:
    return F.expr(f"max_len between {lengths[0]} and {lengths[1]} and n_distinct > {min_distinct}") & P.guid_name(
        F.col("column_name"))


def guid_columns(profile: DataFrame, **limits) -> DataFrame:
    return profile.filter(is_guid(**limits)).select("table_name", "column_name", "n_distinct", "max_len")


def is_constant() -> Column:
    return F.expr("n_distinct = 1 and not contains(lower(column_name), 'rownum')")


def constant_columns(profile: DataFrame) -> DataFrame:
    return profile.filter(is_constant()).select("table_name", "column_name", F.col("min_value").alias("only_value"))


def is_bool_as_text(words: Iterable[str] = V.BOOLEAN_WORDS, max_len: int = 10) -> Column:
    words = list(words)
    return F.expr(f"n_distinct = 2 and max_len > 0 and max_len <= {max_len}") & (
        F.lower("min_value").isin(words) | F.lower("max_value").isin(words))


def bool_as_text(profile: DataFrame, words: Iterable[str] = V.BOOLEAN_WORDS, max_len: int = 10) -> DataFrame:
    return profile.filter(is_bool_as_text(words, max_len)).select("table_name", "column_name", "min_value", "max_value")


def is_date_as_text(lengths: tuple[int, int] = (8, 30)) -> Column:
    return F.expr(f"kind = 'string' and max_len between {lengths[0]} and {lengths[1]}") & P.date_like(F.col("column_name"))


def date_as_text(profile: DataFrame, **limits) -> DataFrame:
    return profile.filter(is_date_as_text(**limits)).select(
        "table_name", "column_name", "min_value", "max_value", "max_len")


def is_number_as_text(max_len: int = 20) -> Column:
    return F.expr(
        f"kind = 'string' and max_len > 0 and max_len <= {max_len} "
        "and try_cast(min_value as double) is not null and try_cast(max_value as double) is not null"
    ) & P.number_prefix(F.col("column_name"))


def number_as_text(profile: DataFrame, **limits) -> DataFrame:
    return profile.filter(is_number_as_text(**limits)).select("table_name", "column_name", "min_value", "max_value")


def is_precise_time(min_distinct: int = 10_000, lengths: tuple[int, int] = (15, 30)) -> Column:
    """Real timestamps, or text of timestamp length, with too many distinct values."""
    timed = f"(kind = 'date' or (kind = 'string' and max_len between {lengths[0]} and {lengths[1]}))"
    return F.expr(f"n_distinct > {min_distinct} and {timed}") & (
        P.timestamp_name(F.col("column_name")) | (F.col("column_name") == "ts"))


def high_precision_ts(profile: DataFrame, **limits) -> DataFrame:
    return profile.filter(is_precise_time(**limits)).select("table_name", "column_name", "kind", "n_distinct")


def is_low_card_in_fact(values: tuple[int, int] = (2, 20), table_above: int = 10_000, max_len: int = 50) -> Column:
    return F.expr(
        f"n_distinct > {values[0]} and n_distinct <= {values[1]} and max_distinct > {table_above} "
        f"and max_len > 0 and max_len <= {max_len}")


def low_card_in_fact(profile: DataFrame, **limits) -> DataFrame:
    return with_table_max(profile).filter(is_low_card_in_fact(**limits)).select(
        "table_name", "column_name", "n_distinct", "max_distinct")


def string_keys(profile: DataFrame, table_above: int = 1000) -> DataFrame:
    """Tables that have a text key and no numeric one."""
    key = P.model_key_like(F.col("column_name"))
    tables = profile.groupBy("table_name").agg(
        F.bool_or(key & (F.col("kind") == "number")).alias("has_number_key"),
        F.bool_or(key & (F.col("kind") == "string") & (F.col("max_len") > 0)).alias("has_text_key"),
        F.max("n_distinct").alias("max_distinct"))
    return tables.filter(
        ~F.col("has_number_key") & F.col("has_text_key") & (F.col("max_distinct") > table_above)
    ).select("table_name", "max_distinct")


def many_high_card(profile: DataFrame, min_distinct: int = 50_000, columns: int = 5) -> DataFrame:
    tables = profile.filter((F.col("n_distinct") > min_distinct) & (F.col("max_len") > 0)).groupBy("table_name").agg(
        F.count(F.lit(1)).alias("n_columns"))
    return tables.filter(F.col("n_columns") > columns)


def near_unique_numeric(profile: DataFrame, share: float = 0.95, min_distinct: int = 1000) -> DataFrame:
    return with_table_max(profile).filter(F.expr(
        f"kind = 'number' and n_distinct > max_distinct * {share}D and n_distinct > {min_distinct} "
        "and not lower(column_name) rlike 'key|id|pk'")
    ).select("table_name", "column_name", "n_distinct", "max_distinct",
             F.round(F.col("n_distinct") / F.col("max_distinct"), 5).alias("unique_share"))


def odd_binary(profile: DataFrame) -> DataFrame:
    lo, hi = F.col("min_value").try_cast("double"), F.col("max_value").try_cast("double")
    usual = ((lo == 0) & (hi == 1)) | ((lo == -1) & (hi == 0))
    return profile.filter((F.col("n_distinct") == 2) & (F.col("kind") == "number") & ~usual).select(
        "table_name", "column_name", "min_value", "max_value")


def underscore_columns(profile: DataFrame) -> DataFrame:
    name = F.col("column_name")
    return profile.filter(name.startswith("_") & ~name.startswith("__")).select(
        "table_name", "column_name", "n_distinct")


# ---- rules over declared columns ----

def repeated_columns(facts: DataFrame, tables_above: int = 3, strip_prefix: bool = False) -> DataFrame:
    """Column names used by many tables. ``facts`` has one row per declared column."""
    name = F.lower("column_name")
    base = F.regexp_replace(name, r"^[a-z]{1,2}_", "") if strip_prefix else name
    return (
        facts.withColumn("base_name", base).filter(~F.col("base_name").rlike(V.REPEATED_NAME_EXCEPT))
        .groupBy("base_name").agg(
            F.count_distinct("table_name").alias("n_tables"),
            F.array_join(F.sort_array(F.collect_set("table_name")), ", ").alias("tables"))
        .filter(F.col("n_tables") > tables_above)
    )


def value_overlap(tables: Mapping[str, DataFrame], columns: Mapping[str, Mapping[str, str]]) -> DataFrame:
    """How far same-named columns share their values: ``columns`` maps base name to {table: column}.

    Values are reduced to distinct (name, table, value) first, so a frequent value costs one row per task.
    """
    frames = [
        tables[table].selectExpr(f"'{base}' as base_name", f"'{table}' as table_name",
                                 f"if(length(cast({col} as string)) > 64, sha2(cast({col} as string), 256), "
                                 f"cast({col} as string)) as value")
        for base, uses in columns.items() for table, col in uses.items()
    ]
    owned = reduce(DataFrame.unionByName, frames).filter("value is not null").distinct()
    return (
        owned.groupBy("base_name", "value").agg(F.count(F.lit(1)).alias("n"))
        .groupBy("base_name").agg(
            F.count(F.lit(1)).alias("n_values"), F.count_if(F.col("n") > 1).alias("n_shared"))
    )


def mixed_declared_types(facts: DataFrame) -> DataFrame:
    """Tables that mix date types, or limited and unlimited text types."""
    base = F.regexp_extract("data_type", r"^([a-z_]+)", 1)
    family = (F.when(base.isin("date", "timestamp", "timestamp_ntz"), "date")
              .when(base.isin("string", "varchar", "char"), "text"))
    return (
        facts.withColumn("base_type", base).withColumn("family", family).filter("family is not null")
        .groupBy("table_name", "family").agg(
            F.count_distinct("base_type").alias("n_types"),
            F.array_join(F.sort_array(F.collect_set("base_type")), ", ").alias("types"))
        .filter("n_types > 1")
    )


def audit_columns(facts: DataFrame) -> DataFrame:
    """Tables that have neither a created nor an updated column."""
    return (
        facts.groupBy("table_name").agg(F.bool_or(P.audit_column(F.col("column_name"))).alias("has"))
        .filter("not has").select("table_name")
    )


def legacy_types(facts: DataFrame) -> DataFrame:
    return facts.filter(F.col("data_type").isin(*V.DEPRECATED_TYPES)).select("table_name", "column_name", "data_type")


def nested_types(facts: DataFrame) -> DataFrame:
    return facts.filter(F.col("data_type").rlike(r"^(array|map|struct)<")).select(
        "table_name", "column_name", "data_type")


def nested_load(tables: Mapping[str, DataFrame]) -> DataFrame | None:
    """What each array or map column really holds: rows, elements, longest; one scan per table."""
    frames = []
    for table, df in tables.items():
        fields = [f for f in df.schema.fields if f.dataType.simpleString().startswith(("array<", "map<"))]
        if not fields:
            continue
        row = df.agg(F.count(F.lit(1)).alias("n"), *[
            c for i, f in enumerate(fields) for c in (
                F.sum(F.greatest(F.size(f.name), F.lit(0)).cast("bigint")).alias(f"s{i}"), F.max(F.size(f.name)).alias(f"m{i}"))])
        frames.append(row.select(F.inline(F.array(*[F.struct(
            F.lit(table).alias("table_name"), F.lit(f.name).alias("column_name"), F.lit(f.dataType.simpleString()).alias("data_type"),
            F.col("n").alias("n_rows"), F.col(f"s{i}").alias("n_elements"), F.col(f"m{i}").alias("max_elements"))
            for i, f in enumerate(fields)]))))
    return reduce(DataFrame.unionByName, frames) if frames else None


def naming_audit(names: DataFrame) -> DataFrame:
    """``names(kind, name)`` to counts of bad, blank, date-table-like and layer-tagged names per kind."""
    name = F.col("name")
    return names.groupBy("kind").agg(
        F.count(F.lit(1)).alias("n_names"),
        F.count_if(P.bad_identifier(name)).alias("n_bad"),
        F.count_if(P.blank(name)).alias("n_blank"),
        F.count_if(P.date_table_name(name)).alias("n_date_like"),
        F.count_if(P.layer(name).isNotNull()).alias("n_layered"))


# ---- data forms: one scan, small results ----

def _unpivot(row: DataFrame, columns: list[str], measures: list[str], keys: tuple[str, ...] = ()) -> DataFrame:
    """Wide aggregate (``<measure>__<i>``) to one row per column."""
    cells = ", ".join(
        "named_struct('column_name', '" + c + "', " + ", ".join(f"'{m}', {m}__{i}" for m in measures) + ")"
        for i, c in enumerate(columns))
    return row.selectExpr(*keys, f"inline(array({cells}))")


def _measure(df: DataFrame, columns: list[str], measures: Mapping[str, str], keys: tuple[str, ...] = ()) -> DataFrame:
    """Evaluate SQL aggregates with ``{c}`` for each column in one pass."""
    aggs = [F.expr(sql.replace("{c}", f"`{c}`")).alias(f"{m}__{i}")
            for i, c in enumerate(columns) for m, sql in measures.items()]
    grouped = df.groupBy(*keys).agg(*aggs) if keys else df.agg(*aggs)
    return _unpivot(grouped, columns, list(measures), keys)


def match_share(df: DataFrame, columns: list[str], pattern: str) -> DataFrame:
    """Share of non-null values of each column that match ``pattern`` (for example a UUID)."""
    p = pattern.replace("\\", "\\\\")
    return _measure(df, columns, {
        "n_values": "count({c})",
        "n_match": "count_if(lower({c}) rlike '" + p + "')",
    }).withColumn("match_share", F.when(F.col("n_values") > 0, F.round(F.col("n_match") / F.col("n_values"), 4)))


def parse_rates(df: DataFrame, columns: list[str]) -> DataFrame:
    """Per text column: values, and how many parse as a number and as a timestamp."""
    return _measure(df, columns, {
        "n_values": "count({c})",
        "n_number": "count(try_cast(trim({c}) as double))",
        "n_date": "count(try_cast(trim({c}) as timestamp_ntz))",
    })


def float_exactness(df: DataFrame, columns: list[str], scale: int = 2, tolerance: float = 1e-8) -> DataFrame:
    """Are all values exact at ``scale`` digits, and which DECIMAL holds them?"""
    power = f"{10 ** scale}D"
    out = _measure(df, columns, {
        "n_values": "count({c})",
        "n_inexact": "count_if(abs({c} * " + power + " - round({c} * " + power + ")) > " + f"{tolerance * 10 ** scale}D)",
        "max_whole": "max(cast(floor(abs({c})) as bigint))",
    })
    digits = F.length(F.col("max_whole").cast("string")) + scale
    return out.withColumn("is_exact", F.col("n_inexact") == 0).withColumn(
        "decimal_type", F.when(F.col("n_inexact") == 0, F.concat(
            F.lit("decimal("), digits.cast("string"), F.lit(f",{scale})"))))


def declared_oversize(facts: DataFrame, limit: int = 500) -> DataFrame:
    return facts.filter(F.col("char_max_len") > limit).select("table_name", "column_name", "data_type", "char_max_len")


def observed_lengths(df: DataFrame, columns: list[str], p: float = 0.95) -> DataFrame:
    """Longest and p-th percentile length of each text column."""
    cells = ", ".join(f"named_struct('column_name', '{c}', 'len', cast(length(`{c}`) as bigint))" for c in columns)
    lengths = df.selectExpr(f"inline(array({cells}))").filter("len is not null")
    longest = lengths.groupBy("column_name").agg(F.count(F.lit(1)).alias("n_values"), F.max("len").alias("max_len"))
    return longest.join(exact_percentile(lengths, ["column_name"], "len", p, "p_len"), "column_name")


def blob_columns(df: DataFrame, columns: list[str], limit: int = 8000) -> DataFrame:
    return _measure(df, columns, {
        "n_values": "count({c})", "n_over": "count_if(length({c}) > " + str(limit) + ")",
    }).withColumn("over_share", F.round(F.col("n_over") / F.col("n_values"), 4))


def time_grain_columns(df: DataFrame, column: str) -> DataFrame:
    """The column at its own, hour and day grain, ready for a profile."""
    c = F.col(column)
    return df.select(c.alias("raw"), F.date_trunc("hour", c).alias("hour"), F.to_date(c).alias("day"))


SHAPES = (
    ("integer", r"^[+-]?[0-9]+$"),
    ("decimal", r"^[+-]?[0-9]+\.[0-9]+$"),
    ("date", r"^[0-9]{4}-[0-9]{2}-[0-9]{2}"),
)


def shape_of(value: Column) -> Column:
    picks = [F.when(value.rlike(pattern), F.lit(label)) for label, pattern in SHAPES]
    return F.coalesce(*picks, F.lit("text"))


def mixed_formats(df: DataFrame, columns: list[str]) -> DataFrame:
    """Text columns whose values have more than one shape, with the rows of each shape."""
    cells = F.inline(F.array(*[
        F.struct(F.lit(c).alias("column_name"), shape_of(F.col(c)).alias("shape"), F.col(c).alias("_v"))
        for c in columns]))
    counted = df.select(cells).filter("_v is not null").groupBy("column_name", "shape").agg(
        F.count(F.lit(1)).alias("n_rows"))
    return counted.withColumn(
        "n_shapes", F.count(F.lit(1)).over(W.partitionBy("column_name"))).filter("n_shapes > 1")


def pii_flags(text: Column, patterns=V.PII_PATTERNS) -> list[tuple[str, Column]]:
    flags = []
    for label, pattern in patterns:
        # a caller's own pattern need not hold the literal
        literal = V.PII_LITERALS.get(label) if (label, pattern) in V.PII_PATTERNS else None
        found = text.rlike(pattern)
        flags.append((label, found if literal is None else text.contains(literal) & found))
    return flags


def sensitive_content(df: DataFrame, text: str, group: str, patterns=V.PII_PATTERNS) -> DataFrame:
    """Rows per personal-data class and group; every class is looked for in one scan."""
    flags = pii_flags(F.col(text), patterns)
    wide = df.groupBy(group).agg(*[F.count_if(flag).alias(label) for label, flag in flags])
    cells = F.inline(F.array(*[
        F.struct(F.lit(label).alias("pii_class"), F.col(label).alias("n_rows")) for label, _ in flags]))
    return wide.select(group, cells).filter("n_rows > 0")


def sensitive_names(facts: DataFrame) -> DataFrame:
    return facts.filter(P.sensitive_name(F.col("column_name"))).select("table_name", "column_name")


def unmasked(sensitive: DataFrame, masked: DataFrame, on: list[str]) -> DataFrame:
    """Sensitive entries without a masking entry."""
    return sensitive.join(masked.select(*on), on, "left_anti")
