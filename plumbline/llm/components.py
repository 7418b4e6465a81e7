"""Connected components of a graph given by its links, without gathering it anywhere."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.session import cut_lineage


def _mark(links: DataFrame):
    """Number and order-free digest of the links."""
    return tuple(links.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b") % (1 << 40))).first())


def components(links: DataFrame, a: str = "a", b: str = "b", cut=cut_lineage) -> DataFrame:
    """(node, root): the smallest node each linked node can reach; nodes without a link don't appear.

    Alternates two steps on links a > b until nothing changes: hang every larger neighbour on
    the smallest one, then every smaller neighbour. Each round at least halves the depth. Least
    neighbours are aggregated before they are shuffled, and the joins on a hot node have plain
    written tables on both sides, so that adaptive execution can split them. Every round is
    written to the shared folder by ``cut``.
    """
    now = links.filter(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).distinct()
    now = cut(now, "links")
    before = _mark(now)
    while before[0]:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = cut(both.groupBy(F.col("a").alias("u")).agg(F.least(F.min("b"), F.col("u")).alias("m")), "least")
        # larger neighbours of every node go to the least one; a link a > b is seen from b
        hung = now.join(least, now.b == least.u).select(F.col("a"), F.col("m").alias("b"))
        hung = cut(hung.distinct(), "links")
        # smaller neighbours, and the node itself, go to the least of them
        least = cut(hung.groupBy(F.col("a").alias("u")).agg(F.min("b").alias("m")), "least")
        moved = hung.join(least, hung.a == least.u).select(F.col("b").alias("a"), F.col("m").alias("b"))
        now = moved.filter("a <> b").unionByName(least.select(F.col("u").alias("a"), F.col("m").alias("b")))
        now = cut(now.distinct(), "links")
        after = _mark(now)
        if after == before:
            break
        before = after
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(
        now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
