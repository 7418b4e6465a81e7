"""Ranked lexical search by a document FP-tree.

Documents become vectors of the terms that some query has. In a shard, terms are ordered by how many
documents hold them, so that vectors with the same frequent terms share a path from the root. Each node
knows the greatest tf of each term in its subtree and the smallest m: a score with these is no smaller
than that of any document below. Every item goes down depth first and leaves a subtree whose bound is
under its tenth score so far. A document is a leaf with its own tf and m, so its bound is its score.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from plumbline.llm.common import picked, slices, text_bytes
from plumbline.llm.decontaminate import words_of
from plumbline.operators.spread import top_per_group
from plumbline.session import cut_lineage

TOP = 10
#: Distinct (item, term) pairs searched at once; more items are searched part by part.
PART_TERMS = 1 << 19
#: Entries of a shard's vectors, (item, node) pairs taken at a time, and documents below which a node isn't cut further.
SHARD_ENTRIES, FRONTIER, LEAF = 1 << 20, 4096, 8
#: Lists that an item's rows are dealt to before the last ranking.
LISTS = 64

_TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def item_terms(items: DataFrame, item_id: str = "item_id", text: str = "text") -> DataFrame:
    """(item_id, term, times): the terms of each item's different texts."""
    rows = picked(items, item_id=item_id, text=text).filter("text is not null").distinct()
    terms = F.transform(F.regexp_extract_all("text", F.lit(_TERM), F.lit(0)), lambda t: F.translate(t, _UPPER, _LOWER))
    return rows.select("item_id", F.explode(terms).alias("term")).groupBy("item_id", "term").agg(F.count(F.lit(1)).alias("times"))


def vectors(docs: DataFrame, vocabulary: list[str]) -> DataFrame:
    """(doc_id, n, terms, tfs): all terms counted, those of the vocabulary with their number and tf. ``docs``: doc_id, text."""
    sent = docs.sparkSession.sparkContext.broadcast(vocabulary)

    @F.arrow_udf("n bigint, terms array<int>, tfs array<bigint>")
    def vector(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        number = {t.encode(): k for k, t in enumerate(sent.value)}.get
        for batch in batches:
            counts, keys = [], []
            texts = text_bytes(batch)
            for a, b in slices(texts):
                for text in texts[a:b]:
                    words = words_of(text.as_py())
                    own = np.array([i for i in map(number, words) if i is not None], np.int64)
                    counts.append(len(words))
                    keys.append(np.unique(own, return_counts=True))
            ends = np.cumsum([0, *(len(t) for t, _ in keys)]).astype(np.int32)
            none = [np.zeros(0, np.int64)]
            yield pa.StructArray.from_arrays([
                pa.array(counts, pa.int64()),
                pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(none + [t for t, _ in keys]).astype(np.int32))),
                pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(none + [c for _, c in keys]).astype(np.int64)))], ["n", "terms", "tfs"])

    return docs.select("doc_id", vector.asNondeterministic()("text").alias("v")).select("doc_id", "v.*")


class Queries:
    """Items as vectors over the ranks of terms, most frequent term first."""

    def __init__(self, item: np.ndarray, rank: np.ndarray, gain: np.ndarray, n_items: int):
        """``gain``: weight times repeats. Rows in any order."""
        order = np.lexsort((rank, item))
        self.rank, self.gain = rank[order], gain[order]
        self.first = np.searchsorted(item[order], np.arange(n_items + 1))
        self.n = n_items


def saturated(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    """The part of a term's score that grows with tf and falls with m."""
    return (1_000_000_000 * tf) // (1000 * tf + 8 * m)


class Tree:
    """The FP-tree of a shard. Nodes are numbered parents first; documents come last, as leaves."""

    def __init__(self, doc_id: np.ndarray, m: np.ndarray, first: np.ndarray, rank: np.ndarray, tf: np.ndarray, width: int, leaf: int = LEAF):
        """Vector d is rank[first[d]:first[d + 1]], rising; no vector is empty. ``width`` is over every rank."""
        n = len(m)
        self.width = width
        size = np.diff(first)
        node_of = np.zeros(n, np.int64)  # deepest node of each document so far; all are below the root
        parent, least_m, least_id = [np.array([-1])], [m.min(keepdims=True)], [doc_id.min(keepdims=True)]
        keys, most = [], []
        nodes, level, live, held = 1, 0, np.arange(n), np.array([n])
        while True:
            # a node of few documents isn't cut further, and a document stays at the end of its path
            live = live[(held[node_of[live]] > leaf) & (size[live] > level)]
            if not len(live):
                break
            kind, into, count = np.unique(node_of[live] * width + rank[first[live] + level], return_inverse=True, return_counts=True)
            old = kind // width
            parts = count < held[old]  # else all documents of a node go one way, and only its path grows
            grows = parts & (count > 1)
            number = nodes + np.cumsum(grows) - 1
            docs, new = live[grows[into]], number[into[grows[into]]]
            live = live[~parts[into] | grows[into]]
            if len(docs):
                node_of[docs] = new
                order = np.argsort(new, kind="stable")
                docs, new = docs[order], new[order]
                heads = np.flatnonzero(np.concatenate([[True], new[1:] != new[:-1]]))
                parent.append(old[grows])
                least_m.append(np.minimum.reduceat(m[docs], heads))
                least_id.append(np.minimum.reduceat(doc_id[docs], heads))
                k, v = self._maxima(np.repeat(new, size[docs]), *self._entries(first, size, docs, rank, tf))
                keys.append(k)
                most.append(v)
                nodes += int(grows.sum())
                held = np.bincount(node_of, minlength=nodes)
            level += 1
        leaves = nodes + np.arange(n)
        parent.append(node_of)
        least_m.append(m)
        least_id.append(doc_id)
        keys.append(np.repeat(leaves, size) * width + rank)
        most.append(tf)
        self.inner = nodes
        self.m, self.least_id = np.concatenate(least_m), np.concatenate(least_id)
        every, maxima = np.concatenate(keys), np.concatenate(most)
        order = np.argsort(every, kind="stable")  # keys of one node come together
        self.keys, self.most = every[order], maxima[order]
        up = np.concatenate(parent)
        self.child = np.argsort(up[1:], kind="stable") + 1
        self.first_child = np.searchsorted(up[self.child], np.arange(nodes + n + 1))

    @staticmethod
    def _entries(first, size, docs, rank, tf):
        at = np.repeat(first[docs] - (np.cumsum(size[docs]) - size[docs]), size[docs]) + np.arange(size[docs].sum())
        return rank[at], tf[at]

    def _maxima(self, node: np.ndarray, rank: np.ndarray, tf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Greatest tf of each (node, term)."""
        key = node * self.width + rank
        order = np.argsort(key, kind="stable")
        key = key[order]
        heads = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        return key[heads], np.maximum.reduceat(tf[order], heads)

    def bounds(self, queries: Queries, item: np.ndarray, node: np.ndarray) -> np.ndarray:
        """For each (item, node) a score that no document below exceeds; for a document its score."""
        low = queries.first[item]
        size = queries.first[item + 1] - low
        start = np.cumsum(size) - size
        at = np.repeat(low - start, size) + np.arange(size.sum())
        owner = np.repeat(node, size)
        key = owner * self.width + queries.rank[at]
        place = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        hit = np.flatnonzero(self.keys[place] == key)
        gained = np.zeros(len(key) + 1, np.int64)
        gained[hit] = queries.gain[at[hit]] * saturated(self.most[place[hit]], self.m[owner[hit]])
        out = np.add.reduceat(gained, start)
        out[size == 0] = 0
        return out


class Best:
    """The first ``top`` of each item so far: highest score, then smallest document id."""

    def __init__(self, n_items: int, top: int):
        self.top = top
        self.item = self.score = self.doc = np.zeros(0, np.int64)
        self.bar, self.bar_id = np.zeros(n_items, np.int64), np.full(n_items, np.iinfo(np.int64).max)

    def may(self, item: np.ndarray, bound: np.ndarray, least_id: np.ndarray) -> np.ndarray:
        """Whether a document of this bound and at least this id could come in."""
        return (bound > self.bar[item]) | ((bound == self.bar[item]) & (bound > 0) & (least_id <= self.bar_id[item]))

    def add(self, item: np.ndarray, score: np.ndarray, doc: np.ndarray) -> None:
        touched = np.isin(self.item, item)
        i, s, d = (np.concatenate([x[touched], y]) for x, y in ((self.item, item), (self.score, score), (self.doc, doc)))
        order = np.lexsort((d, -s, i))
        i, s, d = i[order], s[order], d[order]
        head = np.concatenate([[True], i[1:] != i[:-1]])
        place = np.arange(len(i)) - np.maximum.accumulate(np.where(head, np.arange(len(i)), 0))
        keep, last = place < self.top, place == self.top - 1
        self.bar[i[last]], self.bar_id[i[last]] = s[last], d[last]
        self.item, self.score, self.doc = (np.concatenate([x[~touched], y[keep]]) for x, y in ((self.item, i), (self.score, s), (self.doc, d)))


def search(tree: Tree, queries: Queries, best: Best, frontier: int = FRONTIER) -> int:
    """Every item goes down the tree, best bounds first; returns how many (item, node) pairs were looked at."""
    looked = 0
    children = tree.child[tree.first_child[0]:tree.first_child[1]]
    wave = max(1, frontier // max(1, len(children)))
    stack = []
    for a in range(0, queries.n, wave):
        items = np.arange(a, min(a + wave, queries.n))
        stack.append((np.repeat(items, len(children)), np.tile(children, len(items))))
    while stack:
        item, node = stack.pop()
        if len(item) > frontier:
            half = len(item) - frontier
            stack.append((item[:half], node[:half]))
            item, node = item[half:], node[half:]
        if not len(item):
            continue
        looked += len(item)
        bound = tree.bounds(queries, item, node)
        ok = best.may(item, bound, tree.least_id[node])
        item, node, bound = item[ok], node[ok], bound[ok]
        doc = node >= tree.inner
        if doc.any():
            best.add(item[doc], bound[doc], tree.least_id[node[doc]])
        item, node, bound = item[~doc], node[~doc], bound[~doc]
        order = np.argsort(bound, kind="stable")  # the highest bound is popped first
        item, node = item[order], node[order]
        low = tree.first_child[node]
        size = tree.first_child[node + 1] - low
        at = np.repeat(low - (np.cumsum(size) - size), size) + np.arange(size.sum())
        if len(at):
            stack.append((np.repeat(item, size), tree.child[at]))
    return looked


_NULL_ID = np.iinfo(np.int64).max


def _found(queries: Queries, rank_of: np.ndarray, n_docs: int, n_terms: int, top: int, entries: int = SHARD_ENTRIES):
    """A mapInArrow function vectors -> (item, doc_id, score), the first ``top`` of each item in the task."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best, held, size = Best(queries.n, top), [], 0

        def shard() -> None:
            rows = pa.Table.from_batches(held).combine_chunks()
            ids = rows.column("doc_id").combine_chunks().cast(pa.int64()).fill_null(_NULL_ID).to_numpy()
            n = rows.column("n").to_numpy()
            m = 25 + (75 * n * n_docs) // n_terms
            lists = rows.column("terms").combine_chunks()
            at = lists.offsets.to_numpy().astype(np.int64)
            rank = rank_of[lists.values.to_numpy()[at[0]:at[-1]]].astype(np.int64)
            tf_lists = rows.column("tfs").combine_chunks()
            tf_at = tf_lists.offsets.to_numpy()
            tf = tf_lists.values.to_numpy()[tf_at[0]:tf_at[-1]]
            at -= at[0]
            order = np.lexsort((rank, np.repeat(np.arange(len(n)), np.diff(at))))
            search(Tree(ids, m, at, rank[order], tf[order], len(rank_of) + 1), queries, best)

        for batch in batches:
            for a, b in _cuts(batch.column("terms"), entries):
                part = batch.slice(a, b - a)
                more = int(pc.sum(pc.list_value_length(part.column("terms"))).as_py() or 0)
                if held and size + more > entries:
                    shard()
                    held, size = [], 0
                held.append(part)
                size += more
        if held:
            shard()
        if len(best.item):
            yield pa.RecordBatch.from_arrays([
                pa.array(best.item), pa.array(best.doc, pa.int64(), mask=best.doc == _NULL_ID), pa.array(best.score)], ["item", "doc_id", "score"])

    return run


def _cuts(lists: pa.Array, entries: int) -> Iterator[tuple[int, int]]:
    """(first, end) of runs of rows with up to ``entries`` list entries, or of one row."""
    ends = np.cumsum(lists.value_lengths().to_numpy())
    first, base = 0, 0
    while first < len(ends):
        end = max(first + 1, int(np.searchsorted(ends, base + entries, side="right")))
        yield first, end
        base, first = int(ends[end - 1]), end


def rank(
    docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text",
    top: int = TOP, part_terms: int = PART_TERMS, entries: int = SHARD_ENTRIES,
) -> DataFrame:
    """(item_id, rank, doc_id, score): the ``top`` documents of each item by score, ties by smaller id, then null ids.

    ``doc_id`` is an integer column. Rows of ``docs`` are documents, repeated ones too. Rows of ``items`` with one id are one item: the
    terms of its different texts together. Null and empty texts have no terms; an item without terms, or
    whose terms no document has, gives no rows; so does an empty table on either side.
    """
    spark = docs.sparkSession
    wanted = cut_lineage(item_terms(items, item_id, item_text), "items")
    n_pairs = wanted.count()
    parts = max(1, -(-n_pairs // part_terms))
    results = [_ranked(picked(docs, doc_id=doc_id, text=text), wanted.filter(F.pmod(F.xxhash64("item_id"), F.lit(parts)) == p) if parts > 1 else wanted, top, entries) for p in range(parts)]
    every = results[0]
    for r in results[1:]:
        every = every.unionByName(r)
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last()]
    # an item's rows, up to ``top`` a task, meet in lists first
    dealt = every.withColumn("list", F.pmod(F.xxhash64("doc_id"), F.lit(LISTS)))
    few = top_per_group(dealt, ["item_id", "list"], order, top).drop("list")
    placed = few.withColumn("rank", F.row_number().over(W.partitionBy("item_id").orderBy(*order))).filter(F.col("rank") <= top)
    return placed.select("item_id", "rank", "doc_id", "score")


def _ranked(docs: DataFrame, wanted: DataFrame, top: int, entries: int) -> DataFrame:
    """(item_id, doc_id, score) of at least the first ``top`` of each item. The part's terms, bounded in number, go to the tasks."""
    spark = docs.sparkSession
    rows = wanted.collect()
    vocabulary = sorted({r.term for r in rows})
    ids = sorted({r.item_id for r in rows}, key=lambda x: (x is None, x))
    held = cut_lineage(vectors(docs, vocabulary), "vectors")
    n_docs, n_terms = held.agg(F.count_if(F.col("n") > 0), F.coalesce(F.sum("n"), F.lit(0))).first()
    df = np.zeros(len(vocabulary) + 1, np.int64)
    for r in held.select(F.explode("terms").alias("t")).groupBy("t").count().collect():  # no more rows than the vocabulary
        df[r.t] = r["count"]
    weight = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * int(d) + 1))) for d in df], np.int64)
    rank_of = np.empty(len(vocabulary) + 1, np.int64)
    rank_of[np.lexsort((np.arange(len(df)), -df))] = np.arange(len(df))
    term, item = {t: k for k, t in enumerate(vocabulary)}, {x: k for k, x in enumerate(ids)}
    of = np.array([term[r.term] for r in rows], np.int64)
    queries = Queries(np.array([item[r.item_id] for r in rows], np.int64), rank_of[of], np.array([r.times for r in rows], np.int64) * weight[of], len(ids))
    found = held.filter(F.size("terms") > 0).mapInArrow(_found(queries, rank_of, n_docs, max(1, n_terms), top, entries), "item bigint, doc_id bigint, score bigint")
    names = spark.createDataFrame([(k, x) for k, x in enumerate(ids)], wanted.select(F.lit(0).cast("bigint").alias("item"), "item_id").schema)
    return found.join(F.broadcast(names), "item").select("item_id", "doc_id", "score")
