"""SimHash near-duplicates: fingerprints of word shingles, linked by BK-trees, joined to components.

Fingerprints that differ in at most ``radius`` bits are equal in at least one of ``radius + 1``
blocks of bits, so each block value is a shard. A shard's fingerprints form a BK-tree: the
children of a node are keyed by their Hamming distance to it, and a search follows only the keys
within the radius of its own distance. A shard's tree goes to the tasks that search it; as all
fingerprints together have no bounded size, it goes with the shuffle, not as a broadcast value.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import fresh, hex64, picked, slices, text_bytes
from plumbline.llm.components import components
from plumbline.session import cut_lineage

SHINGLE, SEED, RADIUS = 4, 42, 4
#: Fingerprints in a tree; larger shards are cut by further blocks, then into several trees.
TREE_NODES = 4096
#: (query, node) pairs a search holds at a time.
FRONTIER = 1 << 20

_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_EACH = np.uint64(0x0101010101010101)


def shingle_hashes(text: bytes, size: int = SHINGLE, seed: int = SEED) -> list[int]:
    """XXH64 of every run of ``size`` words, of all words if there are fewer, of none if there is none."""
    words = text.translate(_LOWER).split()
    if len(words) <= size:
        return [xxhash.xxh64_intdigest(b" ".join(words), seed)] if words else []
    joined, h = b" ".join(words), xxhash.xxh64_intdigest
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    firsts = [0, *(ends[:-size] + 1).tolist()]
    return [h(joined[a:b], seed) for a, b in zip(firsts, ends[size - 1:].tolist())]


def fingerprints(texts: pa.Array, size: int = SHINGLE, seed: int = SEED) -> np.ndarray:
    """One 64-bit value a text: the bits that over half of its shingle hashes have."""
    hashes: list[int] = []
    counts = []
    for t in texts:
        own = shingle_hashes(t.as_py(), size, seed)
        hashes += own
        counts.append(len(own))
    return majorities(np.array(hashes, np.uint64), counts)


def majorities(h: np.ndarray, counts: list[int]) -> np.ndarray:
    """The bits that over half of the hashes of each text have; ``h``: those of all texts one after the other."""
    n = np.array(counts, np.int64)
    out = np.zeros(len(n), np.uint64)
    full = np.flatnonzero(n)
    if not len(full):
        return out
    start = np.concatenate([[0], np.cumsum(n[full])[:-1]])
    # bits are counted in bytes, so in blocks of up to 255 hashes of one text
    blocks = -(-n[full] // 255)
    first = np.repeat(start, blocks) + 255 * (np.arange(blocks.sum()) - np.repeat(np.cumsum(blocks) - blocks, blocks))
    of_text = np.concatenate([[0], np.cumsum(blocks)[:-1]])
    for shift in range(8):
        lanes = np.add.reduceat((h >> np.uint64(shift)) & _EACH, first).view(np.uint8).reshape(-1, 8).astype(np.int64)
        total = np.add.reduceat(lanes, of_text, axis=0)
        for lane in range(8):  # the lowest byte comes first
            out[full] |= (2 * total[:, lane] > n[full]).astype(np.uint64) << np.uint64(8 * lane + shift)
    return out


def fingerprint_column(size: int = SHINGLE, seed: int = SEED):
    """A column function text -> fingerprint as a signed 64-bit integer; null, empty and blank texts give 0."""
    @F.arrow_udf("bigint")
    def fp(texts: pa.Array) -> pa.Array:
        t = text_bytes(texts)
        parts = [fingerprints(t[a:b], size, seed) for a, b in slices(t)]
        return pa.array(np.concatenate(parts).view(np.int64) if parts else np.zeros(0, np.int64))

    return fp.asNondeterministic()


class Forest:
    """BK-trees over the values of several shards, built and searched level by level."""

    def __init__(self, values: np.ndarray, shard: np.ndarray):
        """``shard``: number of each value's tree, in order from 0; values of a tree are distinct."""
        n = len(values)
        self.values = values
        self.root = np.flatnonzero(np.concatenate([[True], shard[1:] != shard[:-1]])) if n else np.zeros(0, np.int64)
        self.parent_key = np.zeros(n, np.int64)  # 65 * parent + distance; roots aren't in it
        waiting = np.setdiff1d(np.arange(n), self.root, assume_unique=True)
        at = self.root[shard[waiting]] if n else waiting
        while len(waiting):
            key = at * 65 + np.bitwise_count(values[waiting] ^ values[at])
            # the first for a key becomes the child there, the others go down to it
            order = np.argsort(key, kind="stable")
            head = np.concatenate([[True], key[order][1:] != key[order][:-1]])
            child = waiting[order][np.maximum.accumulate(np.where(head, np.arange(len(order)), 0))]
            self.parent_key[waiting[order][head]] = key[order][head]
            waiting, at = waiting[order][~head], child[~head]
        inner = np.setdiff1d(np.arange(n), self.root, assume_unique=True)
        self.child = inner[np.argsort(self.parent_key[inner], kind="stable")]
        self.keys = self.parent_key[self.child]

    def search(self, queries: np.ndarray, tree: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(query, node) arrays of all pairs within the radius, a bounded frontier at a time."""
        stack = [(np.arange(len(queries)), self.root[tree])]
        while stack:
            q, node = stack.pop()
            if len(q) > FRONTIER:
                half = len(q) // 2
                stack += [(q[half:], node[half:]), (q[:half], node[:half])]
                continue
            d = np.bitwise_count(queries[q] ^ self.values[node]).astype(np.int64)
            near = d <= radius
            if near.any():
                yield q[near], node[near]
            low = np.searchsorted(self.keys, node * 65 + np.maximum(d - radius, 0))
            size = np.searchsorted(self.keys, node * 65 + np.minimum(d + radius, 64), side="right") - low
            total = int(size.sum())
            if total:
                at = np.repeat(low - (np.cumsum(size) - size), size) + np.arange(total)
                stack.append((np.repeat(q, size), self.child[at]))


def _joined(n: int, pairs: Iterator[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """Least member each of n values is linked to, by the pairs."""
    label = np.arange(n)
    for a, b in pairs:
        while True:
            low = np.minimum(label[a], label[b])
            before = label.copy()
            np.minimum.at(label, label[a], low)
            np.minimum.at(label, label[b], low)
            label = label[label]
            if np.array_equal(label, before):
                break
    while not np.array_equal(label, label[label]):
        label = label[label]
    return label


def shard_links(shard: np.ndarray, values: np.ndarray, is_node: np.ndarray, is_query: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links (larger index, smaller index) that join what the trees of the shards join; at most one a value.

    Rows are in order of shard; ``shard`` numbers them from 0.
    """
    nodes = np.flatnonzero(is_node)
    with_tree, tree_of_node = np.unique(shard[nodes], return_inverse=True)
    forest = Forest(values[nodes], tree_of_node)
    queries = np.flatnonzero(is_query & np.isin(shard, with_tree))
    tree = np.searchsorted(with_tree, shard[queries])
    label = _joined(len(values), ((queries[q], nodes[k]) for q, k in forest.search(values[queries], tree, radius)))
    linked = np.flatnonzero(label != np.arange(len(values)))
    return linked, label[linked]


def _blocks(width: int, parts: int) -> list[tuple[int, int]]:
    """(lowest bit, bits) of ``parts`` blocks of nearly equal size."""
    cuts = [width * k // parts for k in range(parts + 1)]
    return [(a, b - a) for a, b in zip(cuts, cuts[1:])]


def _bits(value: Column, low: int, n: int) -> Column:
    return F.shiftrightunsigned(value, low).bitwiseAND((1 << n) - 1)


def _without(value: Column, low: int, n: int) -> Column:
    """The value with a block of bits taken out."""
    upper = F.shiftleft(F.shiftrightunsigned(value, low + n), low) if low + n < 64 else F.lit(0).cast("bigint")
    return upper.bitwiseOR(value.bitwiseAND((1 << low) - 1)) if low else upper


def links(values: DataFrame, radius: int = RADIUS, tree_nodes: int = TREE_NODES, cut=cut_lineage) -> DataFrame:
    """Links (a, b) between distinct fingerprints ``fp`` whose components are those of all pairs within ``radius``.

    A shard with more than ``tree_nodes`` values is cut again: what differs in at most ``radius`` of the other
    bits is equal in a block of these too. Shards that are still larger are cut into trees of about
    ``tree_nodes`` values and lists of as many queries, and every list goes to every tree of its shard.
    """
    fp = F.col("fp")
    first = _blocks(64, radius + 1)
    keyed = values.select("fp", F.posexplode(F.array(*[_bits(fp, *b) for b in first])).alias("block", "value"))
    # blocks times block values rows, whatever the input
    counts = cut(keyed.groupBy("block", "value").count(), "shards")
    large = counts.filter(F.col("count") > tree_nodes).select("block", "value")
    whole = F.lit(0).cast("int")
    out = keyed.join(large, ["block", "value"], "left_anti").select(
        "block", "value", whole.alias("block2"), F.lit(0).cast("bigint").alias("value2"), whole.alias("tree"), whole.alias("list"),
        "fp", F.lit(True).alias("is_node"), F.lit(True).alias("is_query"))
    if not large.isEmpty():
        rest = F.lit(None).cast("array<bigint>")
        for k, b in reversed(list(enumerate(first))):
            other = _without(fp, *b)
            rest = F.when(F.col("block") == k, F.array(*[_bits(other, *c) for c in _blocks(64 - b[1], radius + 1)])).otherwise(rest)
        again = keyed.join(large, ["block", "value"]).select("fp", "block", "value", F.posexplode(rest).alias("block2", "value2"))
        shard = ["block", "value", "block2", "value2"]
        sizes = cut(again.groupBy(*shard).agg(F.ceil(F.count(F.lit(1)) / tree_nodes).cast("int").alias("trees")), "shards")
        spread = again.join(sizes, shard).withColumn("own", F.pmod(F.xxhash64("fp", F.lit(1)), F.col("trees")).cast("int"))
        spread = spread.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("trees") - 1)))
        one = F.col("trees") == 1
        node = spread.select(*shard, F.col("own").alias("tree"), F.col("other").alias("list"), "fp", F.lit(True).alias("is_node"), one.alias("is_query"))
        query = spread.filter(~one).select(*shard, F.col("other").alias("tree"), F.col("own").alias("list"), "fp", F.lit(False).alias("is_node"), F.lit(True).alias("is_query"))
        out = out.unionByName(node).unionByName(query)
    key = ["block", "value", "block2", "value2", "tree", "list"]
    dealt = out.repartition(*key).sortWithinPartitions(*key, F.col("is_node").desc(), "fp")

    def join_shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        for batch in batches:
            held = pa.Table.from_batches([batch] if held is None else [*held.to_batches(), batch])
            ids = _numbers(held, key)
            cut = int(np.searchsorted(ids, ids[-1])) if len(ids) else 0  # the last shard may go on
            if cut:
                yield _linked(held.slice(0, cut), ids[:cut], radius)
                held = held.slice(cut)
        if held is not None and held.num_rows:
            yield _linked(held, _numbers(held, key), radius)

    return dealt.mapInArrow(join_shards, "a bigint, b bigint")


def _numbers(rows: pa.Table, key: list[str]) -> np.ndarray:
    """Number of each row's shard, from 0; rows come in order."""
    new = np.zeros(rows.num_rows, bool)
    for k in key:
        v = rows.column(k).to_numpy()
        new[1:] |= v[1:] != v[:-1]
    return np.cumsum(new)


def _linked(rows: pa.Table, shard: np.ndarray, radius: int) -> pa.RecordBatch:
    fp = rows.column("fp").to_numpy()
    a, b = shard_links(shard, fp.view(np.uint64), rows.column("is_node").to_numpy(), rows.column("is_query").to_numpy(), radius)
    return pa.RecordBatch.from_arrays([pa.array(fp[a]), pa.array(fp[b])], ["a", "b"])


def classes(prints: DataFrame, radius: int = RADIUS, tree_nodes: int = TREE_NODES) -> DataFrame:
    """(fp, component_id, row): for each distinct fingerprint the least (doc_id, row) of its component, written.

    ``prints``: doc_id, row, fp, already written. Null ids come last.
    """
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row")).alias("least")
    each = cut_lineage(prints.groupBy("fp").agg(first), "fingerprints")
    roots = cut_lineage(components(links(each.select("fp"), radius, tree_nodes)), "roots")
    # components of several fingerprints: a root's least member, then back to all its members
    members = cut_lineage(each.join(roots, each.fp == roots.node).select("fp", "root", "least"), "members")
    best = members.groupBy("root").agg(F.min("least").alias("best"))
    linked = members.join(best, "root").select("fp", F.col("best").alias("least"))
    alone = each.join(roots, each.fp == roots.node, "left_anti").select("fp", "least")
    every = linked.unionByName(alone).select("fp", F.col("least.doc_id").alias("component_id"), F.col("least.row").alias("row"))
    return cut_lineage(every, "classes")


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", radius: int = RADIUS, tree_nodes: int = TREE_NODES) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id: one row per row of ``docs``.

    A null, empty or blank text has fingerprint zero and is linked like any other. Equal texts meet in one
    fingerprint, so copies cost one row each. A component whose ids are all null has a null component_id.
    """
    prints = picked(docs, doc_id=doc_id, text=text).select("doc_id", fingerprint_column()("text").alias("fp"))
    prints = cut_lineage(prints.withColumn("row", F.monotonically_increasing_id()), "prints")
    found = classes(prints, radius, tree_nodes).drop("row")
    return prints.join(found, "fp").select("doc_id", hex64(F.col("fp")).alias("fingerprint"), "component_id")


def distinct_documents(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", radius: int = RADIUS, tree_nodes: int = TREE_NODES) -> DataFrame:
    """One row of ``docs`` for each component: that with the smallest id, columns unchanged.

    Rows get a number and are written once with it, so rows that are equal in every column are
    still told apart, and a repeated task sees the same numbers.
    """
    row, fp = fresh(docs, "row_number"), fresh(docs, "fingerprint")
    held = docs.withColumn(fp, fingerprint_column()(F.col(f"`{text}`"))).withColumn(row, F.monotonically_increasing_id())
    held = cut_lineage(held, "documents")
    prints = picked(held, doc_id=doc_id, fp=fp, row=row)
    first = classes(prints, radius, tree_nodes).select(F.col("row").alias(row)).distinct()
    return held.join(first, row, "left_semi").select(*[F.col(f"`{c}`") for c in docs.columns])
