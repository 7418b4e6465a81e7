"""Repairs: plans that list commands, and transforms that return a repaired copy.

Nothing is changed in place; ``write_copy`` refuses a path that already exists.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.functions import fixed_values as V
from plumbline.functions import predicates as P
from plumbline.operators import columns as C
from plumbline.operators.logs import stale_statistics
from plumbline.operators.profile import column_profile
from plumbline.operators.spread import chunked_running_sum, first_per_group, keyed_filter, range_chunks, top_per_group
from plumbline.session import cut_lineage
from plumbline.sources.facts import falsy, kind_of

# ---- plans ----


def fix_plan(found: DataFrame, fixes: DataFrame, ids: list[str] | None = None) -> DataFrame:
    """One command per finding and fix. Without ``ids`` only fixes of the default subset.

    ``fixes`` is catalog-sized, so it is broadcast; findings stay where they are.
    """
    chosen = fixes.filter("is_default") if ids is None else fixes.filter(F.col("fix_id").isin(ids))
    targets = found.select("rule_id", "target").distinct()
    command = F.replace(F.col("command"), F.lit("{target}"), F.col("target"))
    return targets.join(F.broadcast(chosen), "rule_id").select(
        "fix_id", "rule_id", "target", command.alias("command"),
        F.col("command").startswith("transform:").alias("is_transform"))


def fix_summary(outcomes: DataFrame) -> DataFrame:
    """Fixed, failed and skipped targets per fix; ``outcomes`` adds ``outcome`` to a fix plan."""
    return outcomes.groupBy("fix_id").agg(
        F.count(F.lit(1)).alias("n_targets"),
        *[F.count_if(F.col("outcome") == o).alias(f"n_{o}") for o in ("fixed", "failed", "skipped")])


def compact_plan(
    files: DataFrame, target_bytes: int = 128 * V.MB, small_below: int = V.SMALL_FILE, chunk: Column | None = None,
) -> DataFrame:
    """Bins of small files to merge: (table_name, bin, n_files, total_bytes).

    Small files are laid end to end in path order and cut every ``target_bytes``.
    The running sum works per ``chunk`` (ranges of about equally many paths unless given), so a
    table with very many files is not ordered in one task, whatever its files are called.
    """
    small = files.filter(F.col("size") < small_below).select("table_name", "path", "size")
    if chunk is None:
        small, chunk = range_chunks(small, ["table_name", "path"])
    placed = chunked_running_sum(small, ["table_name"], ["path"], "size", chunk, "_end")
    cut = F.floor((F.col("_end") - F.col("size")) / F.lit(target_bytes)).cast("bigint")
    return placed.withColumn("bin", cut).groupBy("table_name", "bin").agg(
        F.count(F.lit(1)).alias("n_files"), F.sum("size").alias("total_bytes"))


#: Files that are packed in one task, and how full a bin must be to be closed before the ranges meet.
PACKED_FILES, CLOSED_SHARE = 100_000, 0.9


def first_fit(sizes: list[int], target: int) -> list[int]:
    """A bin for each size, largest first into the first bin that has room; a size over the target has a bin of its own.

    The first bin with room is found in a tree of the bins' greatest rooms, so n sizes take n log n steps.
    """
    order = sorted(range(len(sizes)), key=lambda k: (-sizes[k], k))
    width = 1
    while width < max(1, len(sizes)):
        width *= 2
    room = [target] * (2 * width)  # every bin is still empty
    bins = [0] * len(sizes)
    for k in order:
        node, size = 1, min(sizes[k], target)
        while node < width:
            node = 2 * node if room[2 * node] >= size else 2 * node + 1
        bins[k] = node - width
        room[node] -= size
        while node > 1:
            node //= 2
            room[node] = max(room[2 * node], room[2 * node + 1])
    return bins


def _pack(size: str, target: int):
    """applyInPandas function: a bin for each row of a group, from 0."""
    def packed(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values([size, rows.columns[0]], ascending=[False, True], kind="stable")
        return rows.assign(bin=first_fit(rows[size].tolist(), target))
    return packed


def compact_bins(files: DataFrame, target_bytes: int = 128 * V.MB, small_below: int = V.SMALL_FILE, in_task: int = PACKED_FILES) -> DataFrame:
    """(table_name, path, size, bin, n_files, total_bytes): the small files of a table, each in a bin of at most ``target_bytes``.

    Largest first into the first bin with room, in groups of about ``in_task`` files that hold all sizes alike. Bins that are
    not nearly full are then packed once more, as wholes, across the groups of a table; that is a few for each group. Files
    over the target are left out, as are bins of one file: nothing is gained by writing these again.
    """
    small = files.filter((F.col("size") < small_below) & (F.col("size") <= target_bytes)).select("path", "table_name", "size")
    counted = small.groupBy("table_name").agg(F.ceil(F.count(F.lit(1)) / in_task).cast("int").alias("groups"))
    dealt = small.join(counted, "table_name").withColumn("part", F.pmod(F.xxhash64("path"), F.col("groups")).cast("int")).select("path", "table_name", "size", "part")
    first = dealt.groupBy("table_name", "part").applyInPandas(_pack("size", target_bytes), "path string, table_name string, size bigint, part int, bin int")
    first = cut_lineage(first, "packed")
    bins = first.groupBy("table_name", "part", "bin").agg(F.sum("size").alias("filled"), F.count(F.lit(1)).alias("n"))
    label = F.concat_ws("-", F.col("part").cast("string"), F.col("bin").cast("string"))
    open_ = bins.filter(F.col("filled") < CLOSED_SHARE * target_bytes).select(label.alias("label"), "table_name", "filled")
    merged = open_.groupBy("table_name").applyInPandas(_pack("filled", target_bytes), "label string, table_name string, filled bigint, bin int")
    named = merged.select("table_name", "label", F.concat(F.lit("m-"), F.col("bin").cast("string")).alias("name"))
    placed = first.withColumn("label", label).join(named, ["table_name", "label"], "left").withColumn("bin", F.coalesce("name", "label"))
    sizes = placed.groupBy("table_name", "bin").agg(F.count(F.lit(1)).alias("n_files"), F.sum("size").alias("total_bytes")).filter("n_files > 1")
    return placed.select("table_name", "path", "size", "bin").join(sizes, ["table_name", "bin"])


def compact_by_bins(rows: DataFrame, bins: DataFrame, out: str) -> None:
    """Write the files of each bin as one file. ``rows``: a scan of the files; ``bins``: file (as scans report it) and bin.

    A bin's rows go to one task, which a bin's size bounds; the files that no bin names stay where they are.
    """
    file = F.col("_metadata.file_path")
    moved = rows.withColumn("_file", file).join(bins.select(F.col("file").alias("_file"), F.col("bin").alias("_bin")), "_file").drop("_file")
    write_copy(moved.repartition("_bin"), out, ["_bin"])


# ---- rewrites ----

def write_copy(df: DataFrame, path: str, partition_by: list[str] | None = None, max_records: int | None = None) -> None:
    """Write to a path that must not exist yet."""
    writer = df.write.mode("errorifexists")
    if max_records:
        writer = writer.option("maxRecordsPerFile", max_records)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)


#: Rows of a file that one task sorts and writes.
FILE_ROWS = 1 << 20


def files_for(df: DataFrame, least: int, rows: int = FILE_ROWS) -> int:
    """Number of files for the rows of ``df``: ``least``, or as many as it takes with at most about ``rows`` each."""
    return max(least, -(-df.count() // rows))


def compact_files(df: DataFrame, path: str, max_records: int | None = None) -> None:
    """Rewrite into evenly sized files; adaptive execution merges small and splits large partitions."""
    write_copy(df.hint("rebalance"), path, max_records=max_records)


def partition_rewrite(df: DataFrame, bucket: Column, name: str, path: str, max_records: int | None = None) -> None:
    """Rewrite partitioned by ``bucket``; the rebalance splits a bucket that holds most rows."""
    write_copy(df.withColumn(name, bucket).hint("rebalance", name), path, [name], max_records)


def with_quantile_bucket(df: DataFrame, column: str, name: str, bits: int, error: float = 0.002) -> DataFrame:
    """Adds bucket 0 .. 2^bits - 1 of a numeric column by approximate quantiles.

    The split points are a list of fixed size; each row searches them in ``bits``
    steps, one projection per step, all inside generated code.
    """
    n = 1 << bits
    splits = df.approxQuantile(column, [i / n for i in range(1, n)], error)
    out = df.withColumn(name, F.lit(0))
    if splits:
        points = "array(" + ", ".join(f"{s!r}D" for s in splits) + ")"
        for b in reversed(range(bits)):
            half = 1 << b
            out = out.withColumn(name, F.expr(
                f"`{name}` + if({points}[`{name}` + {half - 1}] <= cast(`{column}` as double), {half}, 0)"))
    return out


def interleave(buckets: list[Column], bits: int) -> Column:
    """Z-order value: the bits of all buckets in turn, highest first."""
    total = F.lit(0).cast("bigint")
    for i in range(bits):
        for j, b in enumerate(buckets):
            bit = F.shiftright(b, i).bitwiseAND(F.lit(1)).cast("bigint")
            total = total + F.shiftleft(bit, i * len(buckets) + (len(buckets) - 1 - j))
    return total


def zorder(df: DataFrame, columns: list[str], partitions: int, bits: int = 6) -> DataFrame:
    """Rows clustered by the interleaved bits of numeric ``columns``; same rows, new order and partitions."""
    names = [f"_b{i}" for i in range(len(columns))]
    bucketed = df
    for n, c in zip(names, columns):
        bucketed = with_quantile_bucket(bucketed, c, n, bits)
    z = interleave([F.col(n) for n in names], bits)
    return (bucketed.withColumn("_z", z).repartitionByRange(partitions, "_z")
            .sortWithinPartitions("_z").drop("_z", *names))


# ---- row and column repairs ----

#: Rows that are sampled for the bounds of rank buckets.
BOUND_ROWS = 20_000


def with_rank_buckets(df: DataFrame, columns: Mapping[str, str], bits: int, sample: int = BOUND_ROWS) -> DataFrame:
    """Adds for each column (name: bucket) a bucket 0 .. 2^bits - 1 of about equally many rows, in the order of its values.

    For any type that can be ordered. The bounds come from one bounded sample for all columns, rows being chosen by a hash of
    their values; nulls go to bucket 0. Each row searches the bounds in ``bits`` steps.
    """
    n = df.count()
    picked = df.select(*columns)
    if n > sample:
        picked = picked.filter(F.pmod(F.xxhash64(*df.columns), F.lit(1_000_000)) < int(1_000_000 * sample / n))
    rows = picked.collect()  # about ``sample`` rows, whatever the table holds
    out = df
    for column, bucket in columns.items():
        values = sorted(v for v in (r[column] for r in rows) if v is not None and v == v)
        points = [values[len(values) * k // (1 << bits)] for k in range(1, 1 << bits)] if values else []
        out = out.withColumn(bucket, F.lit(0))
        if points:
            bounds = F.array(*[F.lit(p).cast(df.schema[column].dataType) for p in points])
            for b in reversed(range(bits)):
                half = 1 << b
                above = F.element_at(bounds, F.col(bucket) + half) <= F.col(column)
                out = out.withColumn(bucket, F.col(bucket) + F.when(above, half).otherwise(0))
    return out


def with_hilbert_index(df: DataFrame, buckets: list[str], bits: int, name: str) -> DataFrame:
    """Adds the place along a Hilbert curve of the point that the buckets name: neighbours on the curve are neighbours in every bucket.

    Per bit from the top each axis is mirrored or swapped with the first, then the axes are Gray coded, and their bits taken in turn.
    One projection a step, so the expressions stay small.
    """
    axes = [f"_axis{k}" for k in range(len(buckets))]
    out = df.withColumns({a: F.col(b).cast("int") for a, b in zip(axes, buckets)})
    for bit in reversed(range(1, bits)):
        low = (1 << bit) - 1
        for axis in axes:
            first, own = F.col(axes[0]), F.col(axis)
            is_set = F.getbit(own, F.lit(bit)) == 1
            if axis == axes[0]:
                out = out.withColumn(axis, F.when(is_set, own.bitwiseXOR(F.lit(low))).otherwise(own))
                continue
            out = out.withColumn("_swap", F.when(is_set, F.lit(0)).otherwise(first.bitwiseXOR(own).bitwiseAND(F.lit(low))))
            out = out.withColumns({axes[0]: F.when(is_set, first.bitwiseXOR(F.lit(low))).otherwise(first.bitwiseXOR(F.col("_swap"))), axis: own.bitwiseXOR(F.col("_swap"))})
    for before, axis in zip(axes, axes[1:]):
        out = out.withColumn(axis, F.col(axis).bitwiseXOR(F.col(before)))
    turn = F.lit(0)
    for bit in range(1, bits):
        turn = turn.bitwiseXOR(F.when(F.getbit(F.col(axes[-1]), F.lit(bit)) == 1, F.lit((1 << bit) - 1)).otherwise(F.lit(0)))
    out = out.withColumn("_turn", turn)
    out = out.withColumns({a: F.col(a).bitwiseXOR(F.col("_turn")) for a in axes})
    return out.withColumn(name, interleave([F.col(a) for a in axes], bits)).drop("_swap", "_turn", *axes)


def cluster(df: DataFrame, columns: list[str], partitions: int, bits: int = 6) -> DataFrame:
    """Rows laid along a Hilbert curve over the ranks of ``columns``, for files that a filter on any of them can skip."""
    buckets = {c: f"_bucket{k}" for k, c in enumerate(columns)}
    indexed = with_hilbert_index(with_rank_buckets(df, buckets, bits), list(buckets.values()), bits, "_place")
    return indexed.repartitionByRange(partitions, "_place").sortWithinPartitions("_place").drop("_place", *buckets.values())


def retention_filter(df: DataFrame, ts: str, as_of: str, days: int = 365) -> DataFrame:
    return df.filter(F.col(ts) >= F.lit(as_of).cast("timestamp_ntz") - F.expr(f"interval {int(days)} days"))


def add_audit_columns(df: DataFrame, created: Column, updated: Column | None = None) -> DataFrame:
    """created_at and updated_at, each only when no column of that name exists."""
    have = {c.lower() for c in df.columns}
    wanted = {"created_at": created, "updated_at": created if updated is None else updated}
    return df.withColumns({n: c for n, c in wanted.items() if n not in have})


EMAIL_IN_TEXT = r"([A-Za-z0-9._%+-])[A-Za-z0-9._%+-]*@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"


def mask_kind(name: str) -> str:
    low = name.lower()
    return "email" if "email" in low else "phone" if "phone" in low or "mobile" in low else "default"


def mask(value: Column, kind: str, data_type: T.DataType = T.StringType()) -> Column:
    """email keeps the first letter, phone the last four digits, default hides everything."""
    if kind == "email":
        return F.regexp_replace(value, EMAIL_IN_TEXT, "$1XXX@XXXX.com")
    if kind == "phone":
        return F.when(value.isNotNull(), F.concat(F.lit("XXX-XXX-"), F.right(value.cast("string"), F.lit(4))))
    if kind_of(data_type) == "number":
        return F.when(value.isNotNull(), F.lit(0)).cast(data_type)
    return F.when(value.isNotNull(), F.lit("xxxx"))


def mask_columns(df: DataFrame, kinds: dict[str, str] | list[str]) -> DataFrame:
    """Mask the named columns; a list picks the kind from each name."""
    chosen = kinds if isinstance(kinds, dict) else {c: mask_kind(c) for c in kinds}
    types = {f.name: f.dataType for f in df.schema.fields}
    return df.withColumns({c: mask(F.col(c), k, types[c]) for c, k in chosen.items()})


TYPE_DEFAULTS = {"string": "", "number": 0, "bool": False}


def fill_defaults(df: DataFrame, defaults: dict[str, object] | None = None) -> DataFrame:
    """Nulls replaced by the given default, else by the default of the column's type."""
    given = defaults or {}
    filled = {}
    for f in df.schema.fields:
        value = given.get(f.name, TYPE_DEFAULTS.get(kind_of(f.dataType)))
        if value is not None and (not given or f.name in given):
            filled[f.name] = F.coalesce(F.col(f.name), F.lit(value).cast(f.dataType))
    return df.withColumns(filled)


#: What an expression consists of: quoted text, bracketed names, words, single characters. Only bare parentheses nest.
_TOKENS = r"(?is)'[^']*'|\"[^\"]*\"|\[[^\]]*\]|{calls}\w+|."
_FRAME = "struct<head:string,args:array<string>,cur:string>"


def rewrite_calls(text: Column, calls: dict[str, Callable[[Column], Column]]) -> Column:
    """Every call of the named functions, nested to any depth, replaced by what its function makes of the list of its arguments.

    One pass over the expression's tokens with a stack of open parentheses: a comma parts arguments only in the call it
    stands in, inner calls are rewritten before outer ones. Parentheses and commas in quotes or brackets are text. A
    function may answer null to leave a call as it is; a call that is never closed stays.
    """
    names = "|".join(rf"(?<!\w){c}\s*\(\s*" for c in calls)
    empty = F.slice(F.array(F.lit("")), 1, 0)

    def frame(head: Column, args: Column, cur: Column) -> Column:
        return F.struct(head.alias("head"), args.alias("args"), cur.alias("cur"))

    def is_call(head: Column) -> Column:
        return head.rlike(rf"(?is)^({names})$")

    def whole(f: Column) -> Column:
        """A frame as it was written, without its end."""
        return F.concat(f["head"], F.array_join(F.concat(f["args"], F.array(f["cur"])), ","))

    def closed(f: Column) -> Column:
        args = F.transform(F.concat(f["args"], F.array(f["cur"])), lambda x: F.trim(x))
        out = F.lit(None).cast("string")
        for name, make in calls.items():
            out = F.when(f["head"].rlike(rf"(?is)^{name}\s*\("), make(args)).otherwise(out)
        return F.coalesce(out, F.concat(whole(f), F.lit(")")))

    def step(stack: Column, token: Column) -> Column:
        top, below = F.element_at(stack, -1), F.slice(stack, 1, F.size(stack) - 1)
        under = F.element_at(below, -1)
        opens = (token == "(") | is_call(token)
        closes = (token == ")") & (F.size(stack) > 1)
        parts = (token == ",") & is_call(top["head"])
        return (
            F.when(opens, F.concat(stack, F.array(frame(token, empty, F.lit("")))))
            .when(closes, F.concat(F.slice(stack, 1, F.size(stack) - 2), F.array(frame(under["head"], under["args"], F.concat(under["cur"], closed(top))))))
            .when(parts, F.concat(below, F.array(frame(top["head"], F.concat(top["args"], F.array(top["cur"])), F.lit("")))))
            .otherwise(F.concat(below, F.array(frame(top["head"], top["args"], F.concat(top["cur"], token))))))

    tokens = F.regexp_extract_all(text, F.lit(_TOKENS.format(calls=names + "|")), F.lit(0))
    start = F.array(frame(F.lit(""), empty, F.lit(""))).cast(f"array<{_FRAME}>")
    done = F.aggregate(tokens, start, lambda s, t: step(s, t).cast(f"array<{_FRAME}>"), lambda s: F.array_join(F.transform(s, whole), ""))
    return F.when(text.rlike(f"(?is){names}"), done).otherwise(text)


def _if_error(args: Column) -> Column:
    one, two = F.element_at(args, 1), F.try_element_at(args, F.lit(2))
    return F.when(F.size(args) == 2, F.concat(F.lit("IF(ISERROR("), one, F.lit("), "), two, F.lit(", "), one, F.lit(")")))


def rewrite_expressions(df: DataFrame, text: str, fixes: list[str] | None = None) -> DataFrame:
    """``rewritten`` and ``is_changed`` next to the text.

    IFERROR calls and EVALUATEANDLOG calls are found by their parentheses, at any depth and with text behind them; of a log
    call its first argument stays. Each step uses the step before once, so filters can be pushed through.
    """
    def wanted(fix: str) -> bool:
        return fixes is None or fix in fixes

    out = rewrite_calls(F.col(text), {"IFERROR": _if_error}) if wanted("SM-FIX-IFERROR") else F.col(text)
    for fix, pattern, replacement in V.EXPRESSION_REWRITES:
        if wanted(fix):
            out = F.regexp_replace(out, pattern, replacement)
    if wanted("SM-FIX-EVALLOG"):
        df = df.withColumn("rewritten", out)
        out = rewrite_calls(F.col("rewritten"), {"EVALUATEANDLOG": lambda args: F.element_at(args, 1)})
    return df.withColumn("rewritten", out).withColumn("is_changed", F.col("rewritten") != F.col(text))


def clean_name(value: Column) -> Column:
    """Tabs and line breaks to spaces, ends trimmed, runs of white space to one space."""
    spaced = F.regexp_replace(value, r"[\t\r\n]", " ")
    return F.regexp_replace(F.regexp_replace(spaced, r"^\s+|\s+$", ""), r"\s{2,}", " ")


def clean_names(df: DataFrame, column: str) -> DataFrame:
    cleaned = clean_name(F.col(column))
    return df.withColumn("cleaned", cleaned).withColumn("is_changed", F.col("cleaned") != F.col(column))


def fill_formats(df: DataFrame, name: str, fmt: str, visible: Column | None = None, expression: str | None = None) -> DataFrame:
    from plumbline.operators.text import format_inference
    inferred = format_inference(df, name, "_inferred", expression)
    fill = P.blank(F.col(fmt)) if visible is None else P.blank(F.col(fmt)) & visible
    return inferred.withColumn(fmt, F.when(fill, F.col("_inferred")).otherwise(F.col(fmt))).drop("_inferred")


def fill_descriptions(df: DataFrame, name: str, description: str, expression: str | None = None, label: str = "Table") -> DataFrame:
    """Blank descriptions become "label: name", for expressions with the whole expression."""
    text = F.concat(F.lit(f"{label}: "), F.col(name))
    if expression is not None:
        text = F.concat(text, F.lit(" = "), F.col(expression))
    return df.withColumn(description, F.when(P.blank(F.col(description)), text).otherwise(F.col(description)))


def drop_constant_columns(df: DataFrame, table: str = "table", mode: str = "exact") -> DataFrame:
    """Drop columns with one value; only their names reach the driver."""
    constant = C.constant_columns(column_profile({table: df}, mode)).select("column_name").collect()
    return df.drop(*[r.column_name for r in constant])


def hidden_names(columns: list[str], pattern: str) -> list[str]:
    import re
    return [c for c in columns if re.search(pattern, c.lower())]


def hide_columns(df: DataFrame, text: bool = True, guid: bool = True, extra: list[str] | None = None) -> DataFrame:
    """Project away free-text and GUID columns by name."""
    names = set(extra or [])
    if text:
        names |= set(hidden_names(df.columns, V.HIDE_TEXT_NAME))
    if guid:
        names |= set(hidden_names(df.columns, V.HIDE_GUID_NAME))
    return df.select(*[c for c in df.columns if c not in names])


def drop_alias_records(df: DataFrame, record: str, aliases: DataFrame) -> DataFrame:
    return keyed_filter(df, aliases, [(record, record)], keep=False)


def dedup_records(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """First record per key; each task ships one row per key. Ties go by the other columns."""
    return first_per_group(df, keys, _whole_order(df, order))


def _whole_order(df: DataFrame, order: str) -> list[Column]:
    """``order``, then every other column that can be ordered, so that a repeated run keeps the same rows."""
    rest = [f.name for f in df.schema.fields if f.name != order and not isinstance(f.dataType, (T.MapType, T.VariantType))]
    return [F.asc(order), *[F.asc(f"`{c}`") for c in rest]]


def trim_members(df: DataFrame, groups: list[str], order: str, keep: int = 5) -> DataFrame:
    """The first ``keep`` rows of each group; ties go by the other columns."""
    return top_per_group(df, groups, _whole_order(df, order), keep)


def excess_rows(df: DataFrame, groups: list[str], order: str, keep: int = 5) -> DataFrame:
    """The rows ``trim_members`` would drop, each as often as it is dropped; counted, so no group meets in one task."""
    return df.exceptAll(trim_members(df, groups, order, keep))


def drop_orphans(child: DataFrame, parent: DataFrame, on: list[tuple[str, str]]) -> DataFrame:
    return keyed_filter(child, parent, on, keep=True)


def mark_keys(relations: DataFrame, candidates: DataFrame) -> DataFrame:
    """Key flags for the one-side of relations; ``relations.pair`` reads "child.col -> parent.col"."""
    parent = F.split("pair", " -> ")[1]
    sides = relations.select(F.split(parent, r"\.")[0].alias("table_name"), F.split(parent, r"\.")[1].alias("column_name")).distinct()
    return sides.join(candidates, ["table_name", "column_name"]).select(
        "table_name", "column_name", F.col("is_unique").alias("mark_as_key"))


def mark_date_table(tables: DataFrame, name: str) -> DataFrame:
    return tables.withColumn("data_category", F.when(P.date_table_name(F.col(name)), "Time"))


def single_direction(edges: DataFrame) -> DataFrame:
    both = F.lower(F.col("cross_filter")).isin("2", "both", "bothdirections")
    return edges.withColumns({
        "cross_filter": F.when(both, "single").otherwise(F.col("cross_filter")), "is_changed": F.coalesce(both, F.lit(False))})


def no_implicit_summary(columns: DataFrame) -> DataFrame:
    implicit = ~F.coalesce(F.lower("summarize_by"), F.lit("")).isin("none", "", "0")
    return columns.withColumns({
        "summarize_by": F.when(implicit, "none").otherwise(F.col("summarize_by")), "is_changed": implicit})


def view_triage(views: DataFrame, tables: DataFrame, name: str = "name", source: str = "source_table") -> DataFrame:
    """healthy, disabled, broken or source missing, per view."""
    known = tables.select(F.col(name).alias("_table")).distinct().withColumn("_known", F.lit(True))
    bad_health, off = falsy(F.col("is_healthy")), falsy(F.col("is_enabled"))
    state = (F.when(~bad_health & ~off, "healthy").when(F.col("_known").isNull(), "source missing")
             .when(off, "disabled").otherwise("broken"))
    return views.join(known, F.col(source) == F.col("_table"), "left").withColumn("state", state).drop("_table", "_known")


def repair_view_source(triaged: DataFrame, matches: DataFrame, view: str = "name") -> DataFrame:
    """Action and rewritten query per view.

    ``matches`` is (view, new_source, score): the best source found for each view
    whose source is missing.
    """
    state = F.col("state")
    joined = triaged.join(matches, view, "left")
    action = (F.when(state == "healthy", "none").when(state == "disabled", "enable")
              .when(state == "broken", "investigate").when(F.col("new_source").isNull(), "no match")
              .otherwise("recreate"))
    # whole names only: d1 is no part of d10
    name = F.concat(F.lit(r"(?<!\w)\Q"), F.col("source_table"), F.lit(r"\E(?!\w)"))
    new = F.regexp_replace("new_source", r"([\\$])", r"\\$1")
    text = F.when(action == "recreate", F.regexp_replace(F.col("query"), name, new))
    return joined.withColumn("action", action).withColumn("new_query", text)


def surrogate_keys(df: DataFrame, column: str, key: str) -> tuple[DataFrame, DataFrame]:
    """(dimension, table with the integer key in place of ``column``).

    Keys number the values in order of a digest prefix, then value. The 4096
    prefixes are numbered apart and shifted by the sizes of those before, so no
    task orders all values.
    """
    values = df.filter(F.col(column).isNotNull()).select(column).distinct().withColumn(
        "_part", F.substring(F.md5(F.col(column).cast("string")), 1, 3))
    sizes = values.groupBy("_part").agg(F.count(F.lit(1)).alias("_size"))
    before = W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    # at most 4096 rows
    shifts = sizes.select("_part", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_shift"))
    dimension = (
        values.join(F.broadcast(shifts), "_part")
        .withColumn(key, F.col("_shift") + F.row_number().over(W.partitionBy("_part").orderBy(column)))
        .select(F.col(key).cast("bigint"), column)
    )
    return dimension, df.join(dimension, column, "left").drop(column)


def extract_dimension(df: DataFrame, column: str, key: str) -> tuple[DataFrame, DataFrame]:
    """(dimension, fact); the key follows the order of the values, however many there are.

    Values are numbered in ranges and the ranges are shifted by the sizes of those before.
    The dimension is written, so that Spark knows its size when it joins.
    """
    values, chunk = range_chunks(df.filter(F.col(column).isNotNull()).select(column).distinct(), [column])
    ones = values.withColumn("_one", F.lit(1))
    numbered = chunked_running_sum(ones, [], [column], "_one", chunk, key).select(F.col(key).cast("bigint"), column)
    dimension = cut_lineage(numbered, "dimension")
    return dimension, df.join(dimension, column, "left").drop(column)


def retype_columns(df: DataFrame, types: dict[str, str], reject: str = "rejected") -> DataFrame:
    """Cast text to the given types; texts that do not parse are listed in ``reject``."""
    casts = {c: F.trim(F.col(c).cast("string")).try_cast(t) for c, t in types.items()}
    failed = F.array_compact(F.array(*[
        F.when(F.col(c).isNotNull() & v.isNull(), F.concat(F.lit(f"{c}="), F.col(c).cast("string"))) for c, v in casts.items()]))
    return df.withColumn(reject, F.array_join(failed, "; ")).withColumns(casts)


def truncate_timestamps(df: DataFrame, column: str, grain: str = "hour") -> DataFrame:
    return df.withColumn(column, F.date_trunc(grain, F.col(column)).cast(df.schema[column].dataType))


def split_timestamp(df: DataFrame, column: str) -> DataFrame:
    """Date and second of day instead of one precise timestamp."""
    c = F.col(column)
    seconds = F.hour(c) * 3600 + F.minute(c) * 60 + F.second(c)
    return df.withColumns({f"{column}_date": F.to_date(c), f"{column}_second": seconds.cast("int")}).drop(column)


def compute_stats(tables: Mapping[str, DataFrame], newest: Mapping[str, str], as_of: str, days: int = 30) -> DataFrame:
    """Profile of the tables whose newest row (by the column in ``newest``) is older than ``days``; one row a table reaches the driver."""
    dates = reduce(DataFrame.unionByName, [
        tables[name].agg(F.max(column).alias("ts")).select(F.lit(name).alias("name"), "ts") for name, column in newest.items()])
    stale = {r.name for r in stale_statistics(dates.select("name"), dates, "name", "ts", as_of, days).collect()}
    chosen = {name: df for name, df in tables.items() if name in stale}
    return column_profile(chosen or {name: df.limit(0) for name, df in tables.items()}).filter(F.lit(bool(chosen)))


def refresh_view(rows: DataFrame, stale: DataFrame, key: str, build: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The view built anew for the stale keys alone."""
    return build(keyed_filter(rows, stale, [(key, key)]))
