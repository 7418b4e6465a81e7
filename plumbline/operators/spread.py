"""Building blocks that keep a hot key from landing in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from plumbline.session import cut_lineage


def top_per_group(df: DataFrame, keys: list[str], order: list[Column], k: int) -> DataFrame:
    """The first ``k`` rows of each group.

    The row_number filter becomes a window group limit that also runs before
    the shuffle, so each task ships at most ``k`` rows of a group.
    """
    w = W.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= k).drop("_n")


def first_per_group(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    return top_per_group(df, keys, order, 1)


def keyed_filter(df: DataFrame, members: DataFrame, on: list[tuple[str, str]], keep: bool = True) -> DataFrame:
    """Rows of ``df`` whose key is (or is not) in ``members``.

    Both sides reach the join straight from their shuffles, so adaptive execution can split a
    skewed partition of ``df``. (A distinct on the members would stand between and prevent that.)
    """
    keys = members.select(*[F.col(m).alias(f"_k{i}") for i, (_, m) in enumerate(on)])
    cond = [df[d] == keys[f"_k{i}"] for i, (d, _) in enumerate(on)]
    return df.join(keys, cond, "left_semi" if keep else "left_anti")


def chunked_running_sum(
    df: DataFrame, keys: list[str], order: list[str], value: str, chunk: Column, name: str,
) -> DataFrame:
    """Running sum of ``value`` per group in ``order``, in two levels.

    ``chunk`` must not decrease along ``order``. The sums of whole chunks are
    taken first (a small table), then rows only see their own chunk plus an offset.
    """
    chunked = df.withColumn("_chunk", chunk)
    totals = chunked.groupBy(*keys, "_chunk").agg(F.sum(value).alias("_total"))
    before = W.partitionBy(*keys).orderBy("_chunk").rowsBetween(W.unboundedPreceding, -1)
    offsets = totals.select(
        *keys, "_chunk", F.coalesce(F.sum("_total").over(before), F.lit(0)).alias("_offset"))
    within = (W.partitionBy(*keys, "_chunk").orderBy(*order)
              .rowsBetween(W.unboundedPreceding, W.currentRow))
    return (
        chunked.join(offsets, [*keys, "_chunk"])
        .withColumn(name, F.col("_offset") + F.sum(value).over(within))
        .drop("_chunk", "_offset")
    )


def range_chunks(df: DataFrame, order: list[str]) -> tuple[DataFrame, Column]:
    """``df`` and a chunk of it that rises along ``order``: ranges of about equally many rows, written once."""
    dealt = df.repartitionByRange(*order).withColumn("_range", F.spark_partition_id())
    return cut_lineage(dealt, "ranges"), F.col("_range")


def chunked_pairs(
    df: DataFrame, key: str, order: list[str], value: str, chunk: Column,
) -> DataFrame:
    """(src, dst, n): neighbouring values of each key in ``order``, counted.

    One window over (key, chunk) finds the neighbours inside a chunk. Only the first
    and last row of each chunk go on to the window over the whole key, which links
    one chunk to the next. ``chunk`` must not decrease along ``order``.
    """
    inner = W.partitionBy(key, "_chunk").orderBy(*order)
    rows = df.select(key, value, *order, chunk.alias("_chunk")).withColumns({
        "_next": F.lead(value).over(inner), "_more": F.lead(F.lit(1)).over(inner), "_n": F.row_number().over(inner)})
    inside = rows.filter("_next is not null").select(F.col(value).alias("src"), F.col("_next").alias("dst"))
    along = W.partitionBy(key).orderBy("_chunk", *order)
    ends = rows.filter("_n = 1 or _more is null").withColumns({
        "_then": F.lead(value).over(along), "_then_chunk": F.lead("_chunk").over(along)})
    across = ends.filter("_then_chunk > _chunk and _then is not null").select(F.col(value).alias("src"), F.col("_then").alias("dst"))
    return inside.unionByName(across).groupBy("src", "dst").agg(F.count(F.lit(1)).alias("n"))


def exact_percentile(df: DataFrame, keys: list[str], value: str, p: float, name: str, fine: int = 4096) -> DataFrame:
    """Interpolated percentile per group without gathering a group in one task.

    Equal values are counted before the shuffle. Values fall into cells of a logarithmic scale
    (64 per doubling), so a group has few cells whatever its size; the running count over cells finds
    those that hold the wanted ranks. These are cut into ``fine`` equal parts between their least and
    greatest value, found in the same way, and only the values of the wanted parts are ordered. With
    no ``keys`` the result is one row.
    """
    v = F.col(value).cast("double")
    cell = F.signum(v) * F.floor(F.log2(1 + F.abs(v)) * 64)
    counted = (
        df.filter(v.isNotNull() & ~F.isnan(v)).groupBy(*keys, v.alias("_v"), cell.cast("bigint").alias("_cell"))
        .agg(F.count(F.lit(1)).alias("_c"))
    )
    # 0-based ranks of the two values to interpolate between
    rank = (F.col("_rows") - 1) * F.lit(float(p))
    lo, hi = F.floor(rank), F.ceil(rank)

    def wanted(cells: DataFrame, within: list[str], by: str, so_far: Column, rows: Column) -> DataFrame:
        """Cells that hold a wanted rank, with the number of rows before them and in the whole group."""
        before = W.partitionBy(*within).orderBy(by).rowsBetween(W.unboundedPreceding, -1)
        placed = cells.withColumns({"_before": so_far + F.coalesce(F.sum("_in").over(before), F.lit(0)), "_rows": rows})
        return placed.filter((hi >= F.col("_before")) & (lo < F.col("_before") + F.col("_in"))).drop("_in")

    cells = counted.groupBy(*keys, "_cell").agg(F.sum("_c").alias("_in"), F.min("_v").alias("_low"), F.max("_v").alias("_high"))
    coarse = wanted(cells, keys, "_cell", F.lit(0), F.sum("_in").over(W.partitionBy(*keys)))
    width = F.col("_high") - F.col("_low")
    part = F.when(width > 0, F.floor((F.col("_v") - F.col("_low")) / width * fine)).otherwise(F.lit(0)).cast("bigint")
    inside = counted.join(coarse.withColumnRenamed("_before", "_cell_before"), [*keys, "_cell"]).withColumn("_part", part)
    parts = inside.groupBy(*keys, "_cell", "_part").agg(
        F.sum("_c").alias("_in"), F.first("_cell_before").alias("_cell_before"), F.first("_rows").alias("_rows"))
    narrow = wanted(parts, [*keys, "_cell"], "_part", F.col("_cell_before"), F.col("_rows")).select(*keys, "_cell", "_part", "_before")
    upto = W.partitionBy(*keys, "_cell", "_part").orderBy("_v").rowsBetween(W.unboundedPreceding, W.currentRow)
    ranked = (
        inside.join(narrow, [*keys, "_cell", "_part"])
        .withColumn("_end", F.col("_before") + F.sum("_c").over(upto))
        .withColumn("_start", F.col("_end") - F.col("_c"))
    )

    def holds(r: Column) -> Column:
        return (r >= F.col("_start")) & (r < F.col("_end"))

    picked = ranked.groupBy(*keys).agg(
        F.max(F.when(holds(lo), F.col("_v"))).alias("_a"),
        F.max(F.when(holds(hi), F.col("_v"))).alias("_b"),
        F.max(rank - lo).alias("_f"),
    )
    return picked.select(*keys, (F.col("_a") + (F.col("_b") - F.col("_a")) * F.col("_f")).alias(name))


#: Rows of a few numbers or words that may be sent to all tasks.
SENT_ROWS = 1 << 16


def sent_or_merged(small: DataFrame, large: DataFrame, on: list[str], limit: int = SENT_ROWS) -> DataFrame:
    """Inner join; ``small``, already written, is sent to all tasks if it has at most ``limit`` rows, ``large`` never.

    Spark goes by the size of files, and written columns of few values are a hundredth of what they take in memory.
    """
    if small.limit(limit + 1).count() <= limit:
        return F.broadcast(small).join(large, on)
    return small.join(large.hint("merge"), on)
