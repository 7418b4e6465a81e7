"""Near copies by similarity: documents whose sets of word shingles have a Jaccard similarity of a given value or more.

Two methods propose. BK-trees over the SimHash fingerprints of the sets (``simhash.links``) find the sets whose
fingerprints differ in few bits; these are most near copies, but pairs of 0.8 lie up to 13 bits apart, where a tree is
visited nearly whole. MinHash bands propose the rest: two sets of similarity s agree in a band of ``ROWS`` least hashes with probability
s ** ROWS, so at 0.8 a pair misses all ``BANDS`` bands in about 5 of a million cases, above it less often. A pair that
shares a band is looked at by its signatures, a byte of each least hash: at 0.8 fewer than ``AGREEING`` of the 240 agree
once in ten million cases. What is left forms groups, and only their texts are read again: inside a group all pairs of
shingle sets are compared exactly, so every link that joins two documents is a pair of the wanted similarity.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import fresh, picked, slices, text_bytes
from plumbline.llm.components import components
from plumbline.llm.simhash import RADIUS, SEED, links as tree_links, majorities, shingle_hashes
from plumbline.session import Scratch, cut_lineage

SHINGLE, SIMILARITY = 5, 0.8
BANDS, ROWS = 40, 6
#: Least share of signature bytes in which a pair agrees that is compared exactly.
AGREEING = 0.66
#: Rows of a band that are looked at in one task; larger bands are cut into lists.
BAND_ROWS = 4096
#: Rows of two or three numbers that may be sent to all tasks, to spare the other side a shuffle; more are joined.
SENT_ROWS = 1 << 19
#: Documents and shingles of a group that are compared in one task; larger groups are cut into lists that meet in pairs.
LIST_DOCUMENTS, LIST_SHINGLES = 512, 1 << 20
#: Bytes of text that are hashed at a time, so that the hashes stay in a core's cache.
HASH_BYTES = 1 << 18

_RANDOM = np.random.default_rng(23)
_FLIP = _RANDOM.integers(0, 1 << 63, BANDS * ROWS, np.uint64)
_TIMES = _RANDOM.integers(0, 1 << 63, BANDS * ROWS, np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_set(text: bytes, size: int = SHINGLE) -> np.ndarray:
    """The different shingle hashes of a text in order."""
    return np.unique(np.array(shingle_hashes(text, size, SEED), np.uint64))


def bands(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """For each of the sets, none of them empty, ``BANDS`` keys, each telling its band, and a byte of every least hash."""
    every = np.concatenate(sets)
    start = np.cumsum([0, *map(len, sets[:-1])])
    out = np.empty((len(sets), BANDS), np.uint64)
    signature = np.empty((len(sets), BANDS * ROWS), np.uint8)
    for band in range(BANDS):
        key = np.full(len(sets), band + 1, np.uint64)
        for k in range(band * ROWS, (band + 1) * ROWS):
            least = np.minimum.reduceat((every ^ _FLIP[k]) * _TIMES[k], start)
            signature[:, k] = least >> np.uint64(24)
            key = (key ^ least) * np.uint64(0x9E3779B97F4A7C15)
            key ^= key >> np.uint64(32)
        out[:, band] = key
    return out, signature


def sketch_column(size: int = SHINGLE):
    """A column function text -> (digest of its shingle set, shingles in it, its fingerprint, band keys, signature); a text without words has no keys."""
    @F.arrow_udf("digest binary, n bigint, fp bigint, bands array<bigint>, signature binary")
    def sketch(texts: pa.Array) -> pa.Array:
        t = text_bytes(texts)
        digest, n, prints, keys, signatures = [], [], [np.zeros(0, np.uint64)], [], []
        for a, b in slices(t, HASH_BYTES):
            sets = [shingle_set(x.as_py(), size) for x in t[a:b]]
            digest += [xxhash.xxh3_128_digest(s.tobytes()) for s in sets]
            n += map(len, sets)
            prints.append(majorities(np.concatenate(sets), list(map(len, sets))))
            full = [s for s in sets if len(s)]
            found = iter(zip(*bands(full))) if full else iter(())
            for s in sets:
                key, signature = next(found) if len(s) else (np.zeros(0, np.uint64), np.zeros(0, np.uint8))
                keys.append(key.view(np.int64))
                signatures.append(signature.tobytes())
        return pa.StructArray.from_arrays(
            [pa.array(digest, pa.binary()), pa.array(n, pa.int64()), pa.array(np.concatenate(prints).view(np.int64)), pa.array(keys, pa.list_(pa.int64())), pa.array(signatures, pa.binary())],
            ["digest", "n", "fp", "bands", "signature"])

    return sketch.asNondeterministic()


def joined(n: int, near) -> np.ndarray:
    """Least member each of n is linked to; ``near(k)`` tells which others are near to k."""
    label = np.arange(n)
    for k in range(n):
        if not label.any():
            break  # all are linked already
        own = np.unique(label[near(k)])
        label[np.isin(label, own)] = own[0]
    return label


def similar(sets: list[np.ndarray], similarity: float = SIMILARITY) -> np.ndarray:
    """Least member each of the sets is linked to, by all pairs of the similarity or more."""
    n = np.array([len(s) for s in sets], np.int64)
    _, ids = np.unique(np.concatenate(sets), return_inverse=True)
    start = np.cumsum(n) - n
    mark = np.zeros(int(ids.max()) + 1, bool)

    def near(k: int) -> np.ndarray:
        own = ids[start[k]:start[k] + n[k]]
        mark[own] = True
        both = np.add.reduceat(mark[ids], start, dtype=np.int64)
        mark[own] = False
        return both >= similarity * (n + n[k] - both)

    return joined(len(sets), near)


def _by_group(batches: Iterator[pa.RecordBatch], key: list[str]) -> Iterator[pa.Table]:
    """The rows of each group; they come in order of ``key``."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        new = np.zeros(batch.num_rows, bool)
        columns = [batch.column(k).to_numpy() for k in key]
        for v in columns:
            new[1:] |= v[1:] != v[:-1]
        if batch.num_rows:
            new[0] = last is not None and last != tuple(v[0] for v in columns)
            last = tuple(v[-1] for v in columns)
        cuts = [0, *np.flatnonzero(new).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:]):
            if a and held or not a and new[:1].any() and held:
                yield pa.Table.from_batches(held)
                held = []
            if b > a:
                held.append(batch.slice(a, b - a))
    if held:
        yield pa.Table.from_batches(held)


def sent(small: DataFrame, limit: int) -> DataFrame:
    """A written table for a join: sent to all tasks if it has at most ``limit`` rows."""
    return F.broadcast(small) if small.count() <= limit else small


_LINKS = "a bigint, b bigint"


def _linked(groups: Iterator[pa.Table], label) -> Iterator[pa.RecordBatch]:
    """Links of each row of a group to the least one it is joined to."""
    for rows in groups:
        node = rows.column("node").to_numpy()
        order = np.argsort(node, kind="stable")
        found = label(rows, order)
        far = np.flatnonzero(found != np.arange(len(found)))
        if len(far):
            yield pa.RecordBatch.from_arrays([pa.array(node[order][far]), pa.array(node[order][found[far]])], ["a", "b"])


def candidates(each: DataFrame, cut, band_rows: int = BAND_ROWS, sent_rows: int = SENT_ROWS) -> DataFrame:
    """Links whose components are those of all pairs that share a band and whose signatures agree enough. ``each``: node, bands, signature.

    Bands with the same members count once. A row's signature is sent once for each of its bands; the pairs inside a
    band are never written. Of a band with over ``band_rows`` rows, those that agree with its least row are linked to it;
    the others meet every list of the band.
    """
    keyed = each.select("node", F.explode("bands").alias("key"))
    mixed = F.xxhash64("node")
    sizes = keyed.groupBy("key").agg(
        F.count(F.lit(1)).alias("members"), F.min("node").alias("least"), F.bit_xor(mixed).alias("x"), F.sum(mixed % (1 << 40)).alias("y")).filter("members > 1")
    kept = cut(sizes.groupBy("members", "least", "x", "y").agg(F.min("key").alias("key")).select("key", "least", "members"), "bands")
    place = cut(keyed.join(sent(kept, sent_rows), "key"), "places")
    member = cut(each.select("node", "signature").join(sent(place, sent_rows), "node"), "members")

    def agree(rows: pa.Table, order: np.ndarray) -> np.ndarray:
        s = np.frombuffer(b"".join(rows.column("signature").to_pylist()), np.uint8).reshape(len(order), -1)[order]
        return joined(len(s), lambda k: np.count_nonzero(s == s[k], axis=1) >= AGREEING * s.shape[1])

    def look(rows: DataFrame, key: list[str]) -> DataFrame:
        return rows.repartition(*key).sortWithinPartitions(*key).mapInArrow(lambda batches: _linked(_by_group(batches, key), agree), _LINKS)

    out = look(member.filter(F.col("members") <= band_rows).select("key", "node", "signature"), ["key"])
    large = member.filter(F.col("members") > band_rows)
    if large.isEmpty():
        return out

    @F.arrow_udf("boolean")
    def agrees(one: pa.Array, other: pa.Array) -> pa.Array:
        a, b = (np.frombuffer(b"".join(x.to_pylist()), np.uint8).reshape(len(x), -1) for x in (one, other))
        return pa.array(np.count_nonzero(a == b, axis=1) >= AGREEING * max(1, a.shape[1]))

    pivot = each.join(kept.filter(F.col("members") > band_rows).select(F.col("least").alias("node"), "key"), "node").select("key", F.col("signature").alias("first"))
    told = cut(large.join(pivot, "key").withColumn("near", agrees("signature", "first")).drop("first"), "large")
    lists = F.ceil(F.col("members") / band_rows).cast("int")
    dealt = told.withColumns({"lists": lists, "own": F.pmod(F.xxhash64("node"), lists).cast("int")})
    # lists with a row that isn't near to the least one; these meet all lists
    far = cut(dealt.filter(~F.col("near")).select("key", F.col("own").alias("far")).distinct(), "far")
    met = dealt.join(far, "key").filter(F.col("own") == F.col("far")).select("key", "own", F.explode(F.sequence(F.lit(0), F.col("lists") - 1)).alias("other"), "node", "signature")
    met = met.unionByName(dealt.join(far, "key").filter(F.col("own") != F.col("far")).select("key", F.col("far").alias("own"), F.col("own").alias("other"), "node", "signature"))
    star = told.filter("near and node <> least").select(F.col("node").alias("a"), F.col("least").alias("b"))
    return out.unionByName(star).unionByName(look(met, ["key", "own", "other"]))


def tree_candidates(each: DataFrame, cut, radius: int = RADIUS) -> DataFrame:
    """Links whose components are those of all pairs with fingerprints within ``radius``, found by BK-trees. ``each``: node, fp."""
    prints = cut(each.groupBy("fp").agg(F.min("node").alias("least")), "fingerprints")
    found = cut(tree_links(prints.select("fp"), radius, cut=cut), "trees")
    same = each.select("node", "fp").join(prints, "fp").filter("node <> least").select(F.col("node").alias("a"), F.col("least").alias("b"))
    one, other = (prints.select(F.col("fp").alias(k), F.col("least").alias(f"{k}_node")) for k in "ab")
    return same.unionByName(found.join(one, "a").join(other, "b").select(F.col("a_node").alias("a"), F.col("b_node").alias("b")))


def links(held: DataFrame, each: DataFrame, cut=cut_lineage, list_documents: int = LIST_DOCUMENTS, similarity: float = SIMILARITY, size: int = SHINGLE,
          band_rows: int = BAND_ROWS, sent_rows: int = SENT_ROWS) -> DataFrame:
    """Links (a, b) whose components are those of all candidate pairs of the similarity.

    ``held``: row, text. ``each``: node, n, fp, bands, signature; the rows to compare, no two of them with equal shingle sets.
    Groups over ``list_documents`` rows are cut into lists. Each list is compared alone, then the least rows of what a list
    has joined; only if a group is still in parts, its lists meet in pairs.
    """
    proposed = tree_candidates(each, cut).unionByName(candidates(each, cut, band_rows, sent_rows))
    groups = cut(components(proposed, cut=cut), "groups").join(each.select("node", "n"), "node")
    groups = cut(groups.select("node", "root", "n"), "groups")
    need = F.ceil(F.greatest(F.count(F.lit(1)) / list_documents, F.sum("n") / LIST_SHINGLES)).cast("int")
    sizes = cut(groups.groupBy("root").agg(need.alias("lists")), "lists")
    placed = cut(groups.join(sizes, "root").select("node", "root", "lists", F.pmod(F.xxhash64("node"), F.col("lists")).cast("int").alias("own")), "placed")

    @F.arrow_udf("array<bigint>")
    def shingles(texts: pa.Array) -> pa.Array:
        return pa.array([shingle_set(x.as_py(), size).view(np.int64) for x in text_bytes(texts)], pa.list_(pa.int64()))

    texts = held.join(sent(placed, sent_rows), F.col("row") == F.col("node"))
    sets = cut(texts.select("node", "root", "lists", "own", shingles.asNondeterministic()("text").alias("shingles")), "sets")

    def label(rows: pa.Table, order: np.ndarray) -> np.ndarray:
        lists = rows.column("shingles").combine_chunks()
        at, values = lists.offsets.to_numpy(), lists.values.to_numpy().view(np.uint64)
        return similar([values[at[k]:at[k + 1]] for k in order], similarity)

    def compare(rows: DataFrame, key: list[str]) -> DataFrame:
        dealt = rows.select(*key, "node", "shingles").repartition(*key).sortWithinPartitions(*key)
        return cut(dealt.mapInArrow(lambda batches: _linked(_by_group(batches, key), label), _LINKS), "linked")

    out = compare(sets, ["root", "own"])
    large = sets.filter("lists > 1")
    if large.isEmpty():
        return out
    alone = large.join(out.select(F.col("a").alias("node")).distinct(), "node", "left_anti")
    out = out.unionByName(compare(alone.withColumn("own", F.pmod(F.xxhash64("node", F.lit(1)), F.ceil(F.col("lists") / list_documents)).cast("int")), ["root", "own"]))
    parts = placed.filter("lists > 1").join(cut(components(out, cut=cut).withColumnRenamed("root", "part"), "parts"), "node", "left")
    parts = parts.groupBy("root").agg(F.min(F.coalesce("part", "node")).alias("low"), F.max(F.coalesce("part", "node")).alias("high"))
    apart = cut(parts.filter("low <> high").select("root"), "apart")
    rest = large.join(apart, "root", "left_semi").withColumn("other", F.explode(F.sequence(F.lit(0), F.col("lists") - 1))).filter("own <> other")
    met = rest.select("root", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"), "node", "shingles")
    return out.unionByName(compare(met, ["root", "low", "high"]))


def distinct_documents(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", list_documents: int = LIST_DOCUMENTS, similarity: float = SIMILARITY, size: int = SHINGLE,
    band_rows: int = BAND_ROWS, sent_rows: int = SENT_ROWS,
) -> DataFrame:
    """One row of ``docs`` for each group of near copies: that with the smallest id, columns unchanged.

    A group is a component of the pairs of ``similarity`` or more. Texts without a word have equal, empty sets and
    are one group. Rows get a number and are written once with it, as in ``simhash``; null ids come last. All other
    written tables are removed again.
    """
    scratch = Scratch(docs.sparkSession)
    row, sketch = fresh(docs, "row_number"), fresh(docs, "sketch")
    held = docs.withColumn(sketch, sketch_column(size)(F.col(f"`{text}`"))).withColumn(row, F.monotonically_increasing_id())
    held = cut_lineage(held, "documents")
    own = picked(held, doc_id=doc_id, text=text, row=row, sketch=sketch)
    # equal sets are settled first, so copies cost one row each
    least = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row")).alias("least")
    first = [F.first(f"sketch.{k}").alias(k) for k in ("n", "fp", "bands", "signature")]
    each = own.groupBy(F.col("sketch.digest").alias("digest")).agg(least, *first)
    each = scratch.cut(each.select(F.col("least.row").alias("node"), "least", "n", "fp", "bands", "signature"), "each")
    found = links(own.select("row", "text"), each.filter("n > 0").select("node", "n", "fp", "bands", "signature"), scratch.cut, list_documents, similarity, size, band_rows, sent_rows)
    roots = scratch.cut(components(found, cut=scratch.cut), "roots")
    least_of = each.select("node", "least")
    best = least_of.join(roots, "node").groupBy("root").agg(F.min("least").alias("least")).select(F.col("least.row").alias(row))
    alone = least_of.join(roots, "node", "left_anti").select(F.col("node").alias(row))
    kept = scratch.cut(best.unionByName(alone), "first")
    # the rows that go are fewer than those that stay; if they can be sent, no text is shuffled
    gone = cut_lineage(held.select(row).join(kept, row, "left_anti"), "gone")
    scratch.clear()
    return held.join(sent(gone, sent_rows), row, "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])
