"""Discovery from the data alone: references between columns, and keys of one or more columns."""

from __future__ import annotations

import re
from collections.abc import Callable, Mapping
from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.operators.profile import _quoted
from plumbline.session import cut_lineage
from plumbline.sources.facts import kind_of

#: Text longer than this is no key; a column that holds any takes no part in references.
KEY_TEXT = 64
#: Columns to a word of a column set.
WORD = 62


def _value(f: T.StructField) -> str:
    """(l, s, odd) of a value: whole numbers of any type in ``l``, text and times in ``s``; ``odd`` where no key can be."""
    c, dt = _quoted(f.name), f.dataType
    if isinstance(dt, T.IntegralType):
        l, s, odd = f"cast({c} as bigint)", "cast(null as string)", "false"
    elif isinstance(dt, T.NumericType):
        whole = f"cast({c} as double) = floor(cast({c} as double)) and abs(cast({c} as double)) < 9e15"
        l, s, odd = f"if({whole}, cast({c} as bigint), null)", "cast(null as string)", f"not ({whole})"
    elif kind_of(dt) == "date":
        l, s, odd = "cast(null as bigint)", f"concat('t', date_format({c}, 'yyyy-MM-dd HH:mm:ss.SSSSSS'))", "false"
    else:
        l, s, odd = "cast(null as bigint)", f"if(length({c}) <= {KEY_TEXT}, concat('s', {c}), null)", f"length({c}) > {KEY_TEXT}"
    return f"'l', {l}, 's', {s}, 'odd', {c} is not null and ({odd})"


def _reference_fields(df: DataFrame) -> list[T.StructField]:
    return [f for f in df.schema.fields if kind_of(f.dataType) in ("number", "string", "date")]


def name_stem(name: Column) -> Column:
    """A column's name without a short table prefix: ``o_custkey`` and ``c_custkey`` have one stem."""
    return F.regexp_replace(F.lower(name), "^[a-z]{1,2}_", "")


_REFERENCES = ("child_table string, child_column string, parent_table string, parent_column string, "
               "n_child_values bigint, n_contained bigint, n_parent_values bigint, containment double")


def _class(f: T.StructField) -> str:
    """Values of different classes are never equal."""
    return "time" if kind_of(f.dataType) == "date" else "number" if isinstance(f.dataType, T.NumericType) else "text"


def _shared(spark: SparkSession, fields: list[tuple[str, T.StructField]]) -> list[tuple[str, T.StructField]]:
    """The columns whose stem and class a column of another table has too."""
    stems = spark.range(1).select(*[name_stem(F.lit(f.name)).alias(str(k)) for k, (_, f) in enumerate(fields)]).first() if fields else ()
    owners: dict[tuple[str, str], set[str]] = {}
    for (table, f), stem in zip(fields, stems):
        owners.setdefault((stem, _class(f)), set()).add(table)
    return [(table, f) for (table, f), stem in zip(fields, stems) if len(owners[stem, _class(f)]) > 1]


def references(tables: Mapping[str, DataFrame], threshold: float = 1.0, same_stem: bool = True) -> DataFrame:
    """Columns whose values lie in a unique column of another table: (child, parent, values, contained, containment).

    An inverted index from values to the sets of columns that hold them, built in one scan a table: equal cells
    collapse before they are shuffled, a value's columns become a set of bits, and equal sets are counted. Every
    containment is a sum over these counts, which are few; no pair of columns is ever joined. A parent is unique:
    no value occurs twice. ``same_stem`` keeps pairs whose names agree but for a short prefix; columns
    that have no such partner are not read then. Whole numbers match
    whatever their type. Columns without a value, with fractions or with text over ``KEY_TEXT`` take no part.
    """
    spark = next(iter(tables.values())).sparkSession
    fields = [(table, f) for table, df in tables.items() for f in _reference_fields(df)]
    fields = _shared(spark, fields) if same_stem else fields
    if not fields:
        return spark.createDataFrame([], _REFERENCES)
    labels, frames = [], []
    for table, df in tables.items():
        cells = []
        for f in [f for of, f in fields if of == table]:
            cells.append(f"named_struct('cid', {len(labels)}, {_value(f)})")
            labels.append((len(labels), table, f.name))
        if cells:
            frames.append(df.selectExpr(f"inline(array({', '.join(cells)}))"))
    words = range(-(-len(labels) // WORD))
    cells = reduce(DataFrame.unionByName, frames).filter("l is not null or s is not null or odd")
    each = cells.groupBy("cid", "l", "s", "odd").agg(F.count(F.lit(1)).alias("n"))
    columns = each.groupBy("cid").agg(F.count(F.lit(1)).alias("n_values"), F.max("n").alias("most"), F.max("odd").alias("odd")).filter("not odd").drop("odd")
    columns = cut_lineage(columns, "columns")  # one row a column, read for children and for parents
    bit = [F.bit_or(F.when((F.col("cid") >= w * WORD) & (F.col("cid") < (w + 1) * WORD), F.expr(f"shiftleft(1L, cast(cid - {w * WORD} as int))")).otherwise(F.lit(0).cast("bigint"))).alias(f"w{w}") for w in words]
    held = each.filter("not odd").groupBy("l", "s").agg(*bit).groupBy(*[f"w{w}" for w in words]).agg(F.count(F.lit(1)).alias("n"))
    members = F.expr("concat(" + ", ".join(f"transform(filter(sequence(0, {WORD - 1}), k -> getbit(w{w}, k) = 1), k -> k + {w * WORD})" for w in words) + ")")
    pairs = held.withColumn("c", F.explode(members)).withColumn("p", F.explode(members)).filter("c <> p").groupBy("c", "p").agg(F.sum("n").alias("n_contained"))
    names = spark.createDataFrame(labels, "cid int, table_name string, column_name string")

    def side(name: str, key: str) -> DataFrame:
        return names.join(columns, "cid").select(
            F.col("cid").alias(key), F.col("table_name").alias(f"{name}_table"), F.col("column_name").alias(f"{name}_column"),
            F.col("n_values").alias(f"n_{name}_values"), F.col("most").alias(f"{name}_most"))

    found = pairs.join(side("child", "c"), "c").join(side("parent", "p"), "p")
    share = F.col("n_contained") / F.col("n_child_values")
    found = found.filter((F.col("parent_most") == 1) & (F.col("child_table") != F.col("parent_table")) & (share >= threshold))
    if same_stem:
        found = found.filter(name_stem(F.col("child_column")) == name_stem(F.col("parent_column")))
    return found.select(
        "child_table", "child_column", "parent_table", "parent_column", "n_child_values", "n_contained", "n_parent_values", F.round(share, 4).alias("containment"))


#: Sets of columns that are sketched in one scan, and how far a sketch may be off.
SETS_A_SCAN, SKETCH_BITS, SKETCH_ERROR = 60, 14, 0.05
#: Of so many hash values one is looked at first; a set with equal rows there is no key.
FIRST_PART = 64

# without these, times are cut to milliseconds
_WHOLE = {"timestampFormat": "yyyy-MM-dd HH:mm:ss.SSSSSS", "timestampNTZFormat": "yyyy-MM-dd HH:mm:ss.SSSSSS"}


def _hash(columns: tuple[str, ...]) -> Column:
    return F.xxhash64(*[F.col(_quoted(c)) for c in columns])


def _digest(columns: tuple[str, ...]) -> Column:
    return F.sha2(F.to_json(F.struct(*[F.col(_quoted(c)) for c in columns]), _WHOLE), 256)


def _repeated(cells: DataFrame, value: str) -> set[int]:
    """Numbers of the sets in which a value occurs twice."""
    twice = cells.groupBy("set", value).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    return {r.set for r in twice.select("set").distinct().collect()}  # one row a set


def _without_equal_rows(df: DataFrame, sets: list[tuple[str, ...]], first: bool = False) -> list[tuple[str, ...]]:
    """The sets whose values no two rows share, exactly; with ``first`` only the first of them.

    Most sets fall over one part of their hash values. For each of the others one hash a row is shuffled, and only
    rows with a hash that occurs twice are compared by their digests.
    """
    parts = [F.when(F.pmod(_hash(s), F.lit(FIRST_PART)) == 0, F.struct(F.lit(i).alias("set"), _digest(s).alias("value"))) for i, s in enumerate(sets)]
    out = _repeated(df.select(F.inline(F.array_compact(F.array(*parts)))), "value") if sets else set()
    unique = []
    for s in [s for i, s in enumerate(sets) if i not in out]:
        twice = df.groupBy(_hash(s).alias("h")).agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("h")
        twice = cut_lineage(twice, "twice")
        if twice.isEmpty() or not _repeated(
                df.select(F.lit(0).alias("set"), _hash(s).alias("h"), _digest(s).alias("value")).join(twice, "h", "left_semi"), "value"):
            unique.append(s)
            if first:
                break
    return unique


def unique_column_sets(df: DataFrame, max_columns: int = 3, columns: list[str] | None = None, best: Callable[[tuple[str, ...]], tuple] | None = None) -> DataFrame:
    """(columns, n_columns, n_rows): the minimal sets of null-free columns whose values no two rows share.

    Level by level: a set is looked at if none of its subsets is unique. One scan a level sketches the distinct
    count of every set (and rules out sets whose columns' counts can't multiply up to the rows); only sets near
    the row count are counted exactly. With ``best``, a sort key of sets, only the first of the smallest sets is
    given. An empty table has no keys.
    """
    spark = df.sparkSession
    fields = [f for f in df.schema.fields if kind_of(f.dataType) != "other" and (columns is None or f.name in columns)]
    facts = df.agg(F.count(F.lit(1)).alias("n"), *[F.count(F.col(_quoted(f.name))).alias(f"c{i}") for i, f in enumerate(fields)]).first()
    n = facts["n"]
    free = [f.name for i, f in enumerate(fields) if facts[f"c{i}"] == n] if n else []
    estimate: dict[tuple[str, ...], float] = {}
    unique: list[tuple[str, ...]] = []
    for level in range(1, max_columns + 1):
        if best and unique:
            break
        sets = [s for s in combinations(free, level) if not any(set(u) <= set(s) for u in unique)]
        if level > 1:
            sets = [s for s in sets if _product(estimate[s[:-1]], estimate[s[-1:]]) >= n and _product(estimate[s[1:]], estimate[s[:1]]) >= n]
        for a in range(0, len(sets), SETS_A_SCAN):
            part = sets[a:a + SETS_A_SCAN]
            sketched = df.agg(*[F.hll_sketch_estimate(F.hll_sketch_agg(_hash(s), SKETCH_BITS)).alias(f"e{i}") for i, s in enumerate(part)]).first()
            estimate.update({s: (1 + SKETCH_ERROR) * sketched[f"e{i}"] for i, s in enumerate(part)})
        near = [s for s in sets if estimate[s] >= n]
        unique += _without_equal_rows(df, sorted(near, key=best) if best else near, first=best is not None)
        # sets that were ruled out are bounded by the product that ruled them out
        for s in combinations(free, level):
            estimate.setdefault(s, min(float(n), _product(*[estimate[(c,)] for c in s])))
    return spark.createDataFrame([(", ".join(s), len(s), n) for s in unique], "columns string, n_columns int, n_rows bigint")


def _product(*values: float) -> float:
    return reduce(lambda a, b: a * b, values)


def propose_keys(tables: Mapping[str, DataFrame], max_columns: int = 2, key_name: str | None = None) -> DataFrame:
    """(table_name, columns, n_columns, n_rows): the smallest unique column set of each table.

    Of sets of one size the one with the most columns whose name matches ``key_name`` comes first, then the one whose columns stand first.
    """
    rows = []
    for table, df in tables.items():
        place = {c: i for i, c in enumerate(df.columns)}
        # sized by the columns, never by rows
        found = unique_column_sets(df, max_columns, best=lambda s: (
            -sum(bool(key_name and re.search(key_name, c)) for c in s), [place[c] for c in s])).collect()
        rows += [(table, r.columns, r.n_columns, r.n_rows) for r in found]
    return next(iter(tables.values())).sparkSession.createDataFrame(rows, "table_name string, columns string, n_columns int, n_rows bigint")
