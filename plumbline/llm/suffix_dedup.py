"""Removal of repeated 100-byte strings, by column-wise construction over a collection of reads.

Each window of ``length`` bytes has an anchor: the leftmost of its ``gram``-byte strings with the
least hash. Equal windows have their anchors at equal places, so windows need to be compared only
among the occurrences of one anchor, at equal offsets. Around each occurrence of an anchor lies a
read: the bytes of all windows it is the anchor of. Reads that are equal as a whole are settled by
the earliest of them; the different ones that are left go to shards by anchor.

A shard's reads are a collection aligned at their anchors. From the rightmost column to the left,
each round puts one symbol in front of every suffix: the symbols in suffix order are the newest
layer of the collection's Burrows-Wheeler transform, a stable sort by them gives the next order,
and the common prefixes of neighbours follow by range minima. Where a prefix of ``length`` bytes
is shared, all but the earliest window are repeats.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import picked, raw, slices, text_bytes
from plumbline.session import cut_lineage

LENGTH, GRAM = 100, 24
#: Anchors a task holds to settle equal reads before the shuffle.
HELD = 1 << 20
#: Bytes of text whose windows are hashed at a time.
READ_BYTES = 1 << 20
#: Different reads of an anchor above which they are compared in narrower shards, and window starts to one of these.
SHARD_READS, BLOCK = 2048, 8

_MULTIPLIER = 0x9E3779B97F4A7C15
_CODES = np.random.default_rng(19).integers(1, 1 << 63, 256, np.uint64)
_NO_ID = -(1 << 63)
_END = 0xFF  # in no UTF-8 text



def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(max(n, 1), base % (1 << 64), np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)[:n]


def _rolling(data: np.ndarray, k: int) -> np.ndarray:
    """Hash of each run of k bytes."""
    whole, width = None, 0
    part, step = _CODES[data], 1
    while True:
        if k & 1:
            if whole is None:
                whole, width = part, step
            else:
                n = len(data) - width - step + 1
                whole = whole[:n] * np.uint64(pow(_MULTIPLIER, step, 1 << 64)) + part[width:width + n]
                width += step
        k >>= 1
        if not k:
            return whole
        n = len(data) - 2 * step + 1
        part = part[:n] * np.uint64(pow(_MULTIPLIER, step, 1 << 64)) + part[step:step + n]
        step *= 2


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(29))


def anchors(data: np.ndarray, bounds: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> dict[str, np.ndarray]:
    """For each read of the texts data[bounds[i]:bounds[i+1]]: text number, anchor hash and place, first and last
    start of its windows (in bytes of the text), and a hash of the whole read with its anchor's place in it."""
    names = ("text", "anchor", "at", "low", "high", "read")
    if len(data) < length:
        return dict.fromkeys(names, np.zeros(0, np.int64))
    grams = _mixed(_rolling(data, gram))
    bits = max(1, int(len(grams)).bit_length())
    least = (grams >> np.uint64(bits)) << np.uint64(bits) | np.arange(len(grams), dtype=np.uint64)
    span, done = length - gram + 1, 1
    while done < span:  # minimum over span places; the lower bits prefer the leftmost
        step = min(done, span - done)
        least = np.minimum(least[:len(least) - step], least[step:])
        done += step
    least = (least & np.uint64((1 << bits) - 1)).astype(np.int64)
    owner = np.searchsorted(bounds, np.arange(len(least)), side="right") - 1 if len(bounds) > 2 else np.zeros(len(least), np.int64)
    inside = np.flatnonzero(np.arange(len(least)) + length <= bounds[owner + 1])
    if not len(inside):
        return dict.fromkeys(names, np.zeros(0, np.int64))
    at, own = least[inside], owner[inside]
    head = np.flatnonzero(np.concatenate([[True], (at[1:] != at[:-1]) | (own[1:] != own[:-1])]))
    low, high = inside[head], inside[np.append(head[1:], len(inside)) - 1]
    at, own = at[head], own[head]
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_CODES[data] * _powers(_MULTIPLIER, len(data)))])
    back = _powers(pow(_MULTIPLIER, -1, 1 << 64), len(data))
    read = _mixed((sums[high + length] - sums[low]) * back[low]) + ((at - low) * 1000 + (high - low)).astype(np.uint64)
    base = bounds[own]
    return {"text": own, "anchor": grams[at].view(np.int64), "at": at - base, "low": low - base, "high": high - base, "read": read.view(np.int64)}


def _batch(**columns: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(v) for v in columns.values()], list(columns))


#: A read in few bytes for the shuffle. place: kind, anchor's place, bytes of window starts before it, and of all of them.
_READS = "anchor bigint, read bigint, d bigint, h bigint, place bigint"


def _reads(kind: int, rows: dict[str, np.ndarray], chosen: np.ndarray, anchor: np.ndarray | None = None) -> pa.RecordBatch:
    at, low, high = (rows[c][chosen].astype(np.int64) for c in ("at", "low", "high"))
    return _batch(
        anchor=rows["anchor"][chosen] if anchor is None else anchor, read=rows["read"][chosen], d=rows["d"][chosen], h=rows["h"][chosen],
        place=(kind << 56) | (at << 20) | ((at - low) << 10) | (high - low))


def _unpacked(rows: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    place = rows.pop("place")
    at = (place >> 20) & ((1 << 36) - 1)
    low = at - ((place >> 10) & 1023)
    return rows | {"kind": place >> 56, "at": at, "low": low, "high": low + (place & 1023)}


def _classes(rows: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows in order of anchor, read and place, and where a new anchor and a new read begin."""
    order = np.lexsort((rows["at"], rows["h"], rows["d"], rows["read"], rows["anchor"]))
    a, r = rows["anchor"][order], rows["read"][order]
    new_anchor = np.concatenate([[True], a[1:] != a[:-1]]) if len(a) else np.zeros(0, bool)
    return order, new_anchor, new_anchor | np.concatenate([[True], r[1:] != r[:-1]]) if len(a) else new_anchor


def _collect(batches: Iterator[pa.RecordBatch], length: int, gram: int) -> Iterator[pa.RecordBatch]:
    """Reads of the texts (kind 0); equal ones of a task but the earliest are repeats (kind 1)."""
    held: list[dict[str, np.ndarray]] = []

    def settled() -> Iterator[pa.RecordBatch]:
        rows = {k: np.concatenate([x[k] for x in held]) for k in held[0]}
        order, _, first = _classes(rows)
        yield _reads(0, rows, order[first])
        repeats = order[~first]
        # a repeat needs no anchor any more: it goes where its document sends it
        yield _reads(1, rows, repeats, _mixed(rows["h"][repeats].view(np.uint64) + rows["at"][repeats].astype(np.uint64)).view(np.int64))

    for batch in batches:
        texts = text_bytes(batch.column("text"))
        d, h = (batch.column(c).to_numpy() for c in ("d", "h"))
        for a, b in slices(texts, READ_BYTES):
            found = anchors(*raw(texts[a:b]), length, gram)
            text = found.pop("text") + a
            held.append(found | {"d": d[text], "h": h[text]})
            if sum(len(x["at"]) for x in held) > HELD:
                yield from settled()
                held.clear()
    if held:
        yield from settled()


def _whole_anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[dict[str, np.ndarray]]:
    """Rows that come in order of anchor, never cut inside one."""
    held: dict[str, np.ndarray] | None = None
    for batch in batches:
        new = {c: batch.column(c).to_numpy(zero_copy_only=False) for c in batch.schema.names}
        held = new if held is None else {k: np.concatenate([held[k], v]) for k, v in new.items()}
        a = held["anchor"]
        cut = int(np.searchsorted(a, a[-1])) if len(a) else 0
        if cut:
            yield {k: v[:cut] for k, v in held.items()}
            held = {k: v[cut:] for k, v in held.items()}
    if held is not None and len(held["anchor"]):
        yield held


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Repeats (kind 1), and the earliest of each different read of an anchor that has several (kind 2)."""
    for every in map(_unpacked, _whole_anchors(batches)):
        known = every["kind"] == 1
        if known.any():
            yield _reads(1, every, np.flatnonzero(known))
        rows = {k: v[~known] for k, v in every.items()}
        order, new_anchor, first = _classes(rows)
        if not len(order):
            continue
        yield _reads(1, rows, order[~first])
        group = np.cumsum(new_anchor) - 1
        several = np.bincount(group[first], minlength=group[-1] + 1)[group] > 1
        yield _reads(2, rows, order[first & several])


def repeated_windows(columns: np.ndarray, first: np.ndarray, last: np.ndarray, rank: np.ndarray, length: int) -> np.ndarray:
    """Which windows of the reads of a shard are repeats: a row for each offset, a column for each read.

    ``columns``: one row for each place, from the leftmost window's start on, with each read's byte
    there or ``_END``. ``first``, ``last``: rows where a read's windows start. ``rank``: order of the reads
    by place in the collection.
    """
    rounds, n = columns.shape
    out = np.zeros((rounds - length + 1, n), bool)
    order = np.arange(n)
    common = np.zeros(n, np.uint8)  # shared prefix of each suffix with the one before it, 255 at most
    common[1:] = 255  # before the first round all suffixes are empty, so alike to any depth
    for row in range(rounds - 1, -1, -1):
        layer = columns[row][order]
        to = np.argsort(layer, kind="stable")
        symbol = layer[to]
        # range minima between the old places of new neighbours
        low, high = to[:-1] + 1, to[1:]
        same = np.flatnonzero(symbol[1:] == symbol[:-1])
        new = np.zeros(n, np.uint8)
        if len(same):
            a, b = low[same], high[same]
            size = b - a + 1
            level = np.frexp(size.astype(np.float64))[1] - 1
            least = np.zeros(len(same), np.uint8)
            table, width = common, 1
            for k in range(int(level.max()) + 1):
                now = np.flatnonzero(level == k)
                if len(now):
                    least[now] = np.minimum(table[a[now]], table[b[now] - width + 1])
                if len(table) > width:
                    table = np.minimum(table[:-width], table[width:])
                width *= 2
            new[same + 1] = np.where(least < 255, least + 1, 255)
        order, common = order[to], new
        if row < len(out):
            valid = (first[order] <= row) & (row <= last[order])
            alike = common >= length
            if alike.any():
                head = np.flatnonzero(~alike)
                earliest = np.minimum.reduceat(np.where(valid, rank[order], n), head)
                mine = np.repeat(earliest, np.diff(np.append(head, n)))
                out[row, order] = valid & (rank[order] > mine)
    return out


def _shards(batches: Iterator[pa.RecordBatch], length: int, gram: int) -> Iterator[pa.RecordBatch]:
    """Repeats among the different reads of each anchor."""
    left = length - gram
    for rows in _whole_anchors(batches):
        n = len(rows["anchor"])
        # columns from left of the anchor to length bytes behind it
        columns = np.full((left + length, n), _END, np.uint8)
        start = left - (rows["at"] - rows["low"])
        for k, b in enumerate(rows["bytes"]):
            columns[start[k]:start[k] + len(b), k] = np.frombuffer(b, np.uint8)
        rank = np.empty(n, np.int64)
        rank[np.lexsort((rows["at"], rows["h"], rows["d"]))] = np.arange(n)
        first, last = start, start + (rows["high"] - rows["low"])
        again = repeated_windows(columns, first, last, rank, length).T
        # runs of offsets of each read
        edge = np.diff(np.pad(again, ((0, 0), (1, 1))).astype(np.int8), axis=1)
        read, begin = np.nonzero(edge == 1)
        _, end = np.nonzero(edge == -1)
        shift = rows["at"][read] - left
        if len(read):
            yield _batch(d=rows["d"][read], h=rows["h"][read], first=(begin + shift).astype(np.int32), end=(end - 1 + shift + length).astype(np.int32))


def _narrowed(data: bytes, anchor: int, at: int, low: int, high: int, length: int) -> Iterator[tuple[int, int, int, int]]:
    """A read of an anchor with very many, cut by blocks of window starts: (shard, at, low, high) of each part.

    All windows of a block have some bytes in common, all but ``BLOCK - 1`` of them, so reads that differ
    there share none of its windows, and those bytes name the shard.
    """
    for block in range((at - high) // BLOCK, (at - low) // BLOCK + 1):
        start = at - block * BLOCK
        shared = data[start:start - BLOCK + 1 + length]
        shard = xxhash.xxh64_intdigest(shared + anchor.to_bytes(8, "little", signed=True), block)
        yield shard - (1 << 63), at, max(low, start - BLOCK + 1), min(high, start)


def _extracted(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """The bytes of the reads listed for each text, in the shards where they are compared."""
    for batch in batches:
        texts = text_bytes(batch.column("text"))
        for k, (text, reads) in enumerate(zip(texts, batch.column("reads"))):
            data, rows = text.as_py(), []
            for r in reads.as_py():
                own = (r["anchor"], r["at"], r["low"], r["high"])
                rows += _narrowed(data, *own, length) if r["crowded"] else [own]
            anchor, at, low, high = (list(c) for c in zip(*rows))
            n = len(rows)
            yield pa.RecordBatch.from_arrays([
                pa.array(anchor, pa.int64()), pa.array(np.full(n, batch.column("d")[k].as_py())), pa.array(np.full(n, batch.column("h")[k].as_py())),
                pa.array(at, pa.int32()), pa.array(low, pa.int32()), pa.array(high, pa.int32()),
                pa.array([data[a:b + length] for a, b in zip(low, high)], pa.binary())],
                ["anchor", "d", "h", "at", "low", "high", "bytes"])


def repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, shard_reads: int = SHARD_READS) -> DataFrame:
    """(d, h, first, end): byte ranges of the texts that repeated windows cover; ranges may overlap.

    ``docs``: d (id), h (digest of the text, or any constant where the id alone tells), text.
    """
    if length - gram > 1000:
        raise ValueError("windows of over a thousand bytes more than the gram don't fit a read's place")
    reads = docs.mapInArrow(lambda it: _collect(it, length, gram), _READS).repartition("anchor").sortWithinPartitions("anchor")
    settled = cut_lineage(reads.mapInArrow(_compare, _READS), "reads")
    part = lambda low, n: F.shiftrightunsigned("place", low).bitwiseAND((1 << n) - 1).cast("int")
    at, before, span = part(20, 31), part(10, 10), part(0, 10)
    settled = settled.select("d", "h", "anchor", part(56, 2).alias("kind"), at.alias("at"), (at - before).alias("low"), (at - before + span).alias("high"))
    whole = settled.filter("kind = 1").select("d", "h", F.col("low").alias("first"), (F.col("high") + length).alias("end"))
    different = settled.filter("kind = 2")
    crowded = different.groupBy("anchor").count().filter(F.col("count") > shard_reads).select("anchor", F.lit(True).alias("crowded"))
    different = different.join(cut_lineage(crowded, "crowded"), "anchor", "left").withColumn("crowded", F.coalesce("crowded", F.lit(False)))
    listed = different.groupBy("d", "h").agg(F.collect_list(F.struct("anchor", "at", "low", "high", "crowded")).alias("reads"))
    with_bytes = docs.join(listed, ["d", "h"])
    with_bytes = with_bytes.mapInArrow(lambda it: _extracted(it, length), "anchor bigint, d bigint, h bigint, at int, low int, high int, bytes binary")
    sharded = with_bytes.repartition("anchor").sortWithinPartitions("anchor")
    parts = cut_lineage(sharded.mapInArrow(lambda it: _shards(it, length, gram), "d bigint, h bigint, first int, end int"), "repeats")
    return whole.unionByName(parts)


def kept(text: bytes, ranges: list[tuple[int, int]]) -> tuple[bytes, int, int]:
    """What is left of a text without the ranges (in order of start), bytes removed, and removed runs."""
    parts, at, runs = [], 0, 0
    for a, b in ranges:
        if a > at or not runs:
            parts.append(text[at:a])
            runs += 1
        at = max(at, b)
    left = b"".join([*parts, text[at:]])
    return left, len(text) - len(left), runs


def dedup(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", length: int = LENGTH, gram: int = GRAM, shard_reads: int = SHARD_READS,
) -> DataFrame:
    """(doc_id, text, ranges): each row's bytes as they are, and the ranges to remove in order of start.

    Earlier is a smaller id, then a smaller place; a null id comes first. Rows equal in id and text count as
    one document, and each gets its result; different texts of one id follow in order of their digests. A null
    text is empty; texts of under ``length`` bytes have no windows.
    """
    own = picked(docs, doc_id=doc_id, text=text).withColumn("d", F.coalesce(F.col("doc_id").cast("bigint"), F.lit(_NO_ID)))
    # only where an id repeats do its rows need a digest; written, so that Spark sees how few such ids there are
    again = cut_lineage(own.groupBy("d").count().filter("count > 1").select("d", F.lit(True).alias("again")), "repeated-ids")
    own = own.join(again, "d", "left").select("doc_id", "text", "d", "again", F.when(F.col("again"), F.xxhash64("text")).otherwise(F.lit(0)).alias("h"))
    # rows equal in id and text are one document, or each would be a repeat of the others
    once = cut_lineage(own.filter("again").groupBy("d", "h").agg(F.min("text").alias("text")), "documents-of-repeated-ids")
    found = repeats(own.filter("again is null").select("d", "h", "text").unionByName(once), length, gram, shard_reads)
    by_text = cut_lineage(found.groupBy("d", "h").agg(F.array_sort(F.collect_set(F.struct("first", "end"))).alias("ranges")), "ranges")
    return own.join(by_text, ["d", "h"], "left").select("doc_id", "text", "ranges")


def digests(marked: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256."""
    @F.arrow_udf("n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string")
    def cut(texts: pa.Array, ranges: pa.Array) -> pa.Array:
        out = []
        for t, r in zip(text_bytes(texts), ranges):
            data = t.as_py()
            left, removed, runs = kept(data, [(x["first"], x["end"]) for x in r.as_py() or ()])
            out.append((len(data), removed, runs, hashlib.sha256(left).hexdigest()))
        return pa.array(out, pa.struct([("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string())]))

    return marked.select("doc_id", cut("text", "ranges").alias("c")).select("doc_id", "c.*")
