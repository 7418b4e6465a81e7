"""Benchmark passages in training text, by suffix arrays over shards of the training words.

A shard is a slice of documents inside a task. Its words become ids of the benchmark's
vocabulary, 0 for any other word, so a suffix ends at the first word that no benchmark text
has. The suffixes are sorted, and every suffix of every benchmark text is binary-searched. What is found
for one suffix after the other of a text, at one place after the other of a document, is one match: the longest
verbatim one, with its places in both.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import fresh, picked, raw, slices, text_bytes
from plumbline.session import cut_lineage

WINDOW = 10
#: Bytes of benchmark text that are sent to the tasks at once; a larger benchmark is searched part by part.
BENCHMARK_BYTES = 16 << 20

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_IS_WORD = np.zeros(256, bool)
_IS_WORD[48:58] = _IS_WORD[97:123] = _IS_WORD[128:] = True
_BLANKED = np.where(_IS_WORD[_LOWER], _LOWER, 32).astype(np.uint8).tobytes()
_MULTIPLIER = 0x9E3779B97F4A7C15
_CODES = np.random.default_rng(7).integers(1, 1 << 63, 256, np.uint64)


def _powers(n: int) -> np.ndarray:
    out = np.full(n, _MULTIPLIER, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


def words_of(text: bytes) -> list[bytes]:
    """The words of one text: A-Z lowered, maximal runs of 0-9, a-z and what isn't ASCII."""
    return text.translate(_BLANKED).split()


def word_hashes(data: np.ndarray, first: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit polynomial hash of each data[first:end]."""
    length = end - first
    out = np.zeros(len(first), np.uint64)
    coded = _CODES[data]
    for k in range(int(length.max(initial=0))):
        if k < 24:
            live = np.flatnonzero(length > k) if k else slice(None)
            out[live] = out[live] * np.uint64(_MULTIPLIER) + coded[first[live] + k]
        else:  # a few long words: their rest by running sums
            for i in np.flatnonzero(length > k):
                part = coded[first[i] + k:end[i]]
                tail = int(np.sum(part * _powers(len(part))[::-1], dtype=np.uint64))
                out[i] = (int(out[i]) * pow(_MULTIPLIER, len(part), 1 << 64) + tail) % (1 << 64)
            break
    return out


class Benchmark:
    """Words, windows and suffixes of the benchmark texts."""

    def __init__(self, items: list[tuple[object, bytes]], window: int = WINDOW):
        self.window = window
        texts = [(str(i), words_of(t)) for i, t in items]
        self.vocabulary = {w: k for k, w in enumerate(sorted({w for _, ws in texts for w in ws}), 1)}
        joined = list(self.vocabulary)
        ends = np.cumsum([0] + [len(w) for w in joined])
        hashes = word_hashes(np.frombuffer(b"".join(joined), np.uint8), ends[:-1], ends[1:])
        order = np.argsort(hashes)
        self.hashes, self.ids = hashes[order], np.arange(1, len(joined) + 1, dtype=np.int32)[order]
        assert len(np.unique(hashes)) == len(hashes), "two benchmark words have one hash"
        self.words = [b"", *joined]
        self.seen = np.zeros(1 << 20, bool)
        self.seen[(hashes >> np.uint64(44)).astype(np.int64)] = True
        # a window for each suffix of at least window words, or of the whole of a shorter item, and the places that begin with it
        self.windows: dict[tuple[int, ...], list[tuple[int, int]]] = {}
        self.items = [item for item, _ in texts]
        for t, (_, ws) in enumerate(texts):
            ids = [self.vocabulary[w] for w in ws]
            for j in range(max(1, len(ids) - window + 1) if ids else 0):
                self.windows.setdefault(tuple(ids[j:j + window]), []).append((t, j))
        self.keys = sorted(self.windows)
        self.lengths = np.array([len(k) for k in self.keys], np.int64)
        self.table = np.zeros((len(self.keys), window), np.int32)
        for r, k in enumerate(self.keys):
            self.table[r, :len(k)] = k
        self.places = [self.windows[k] for k in self.keys]

    def lookup(self, hashes: np.ndarray) -> np.ndarray:
        """Id of each word, 0 for words that the benchmark doesn't have."""
        out = np.zeros(len(hashes), np.int32)
        if len(self.hashes):
            maybe = np.flatnonzero(self.seen[(hashes >> np.uint64(44)).astype(np.int64)])
            h = hashes[maybe]
            at = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
            same = self.hashes[at] == h
            out[maybe[same]] = self.ids[at[same]]
        return out


def suffix_array(ids: np.ndarray, top: int) -> np.ndarray:
    """Starts of the suffixes of ``ids`` that begin with a word, in order; a 0 ends a suffix.

    Suffixes are first sorted by as many words as fit in 64 bits. Those that are still equal
    and have not ended are sorted by the rank of what follows, which doubles the depth each time.
    """
    bits = max(1, int(top).bit_length())
    depth = max(1, 63 // bits)
    n = len(ids)
    starts = np.flatnonzero(ids)
    padded = np.concatenate([ids, np.zeros(depth + 1, ids.dtype)])
    key = np.zeros(len(starts), np.uint64)
    open_ = np.ones(len(starts), bool)
    for k in range(depth):
        word = padded[starts + k]
        open_ &= word > 0
        key = (key << np.uint64(bits)) | np.where(open_, word, 0).astype(np.uint64)
    order = np.argsort(key, kind="stable")
    array, key, open_ = starts[order], key[order], open_[order]
    # rank: place of the first of the equals, counted from 1; 0 where a suffix ends
    group = np.concatenate([[True], key[1:] != key[:-1]]) if len(key) else np.zeros(0, bool)
    head = np.maximum.accumulate(np.where(group, np.arange(len(key)), 0)) if len(key) else np.zeros(0, np.int64)
    rank = np.zeros(n + 1, np.int64)
    rank[array] = head + 1
    tied = np.flatnonzero(open_ & (np.bincount(head, minlength=len(key))[head] > 1)) if len(key) else np.zeros(0, np.int64)
    while len(tied):
        follow = rank[np.minimum(array[tied] + depth, n)]
        order = np.lexsort((array[tied], follow, head[tied]))
        array[tied] = array[tied][order]
        follow, h = follow[order], head[tied]
        new = np.concatenate([[True], (h[1:] != h[:-1]) | (follow[1:] != follow[:-1])])
        head[tied] = np.maximum.accumulate(np.where(new, tied, 0))
        rank[array[tied]] = head[tied] + 1
        size = np.bincount(np.cumsum(new) - 1)
        tied = tied[(size[np.cumsum(new) - 1] > 1) & (follow > 0)]
        depth *= 2
    return array


def _compare(ids: np.ndarray, starts: np.ndarray, bench: Benchmark, rows: np.ndarray) -> np.ndarray:
    """-1, 0 or 1 as the suffix at each start lies before, begins with, or lies behind the window."""
    out = np.zeros(len(rows), np.int8)
    live = np.arange(len(rows))
    for k in range(bench.window):
        live = live[bench.lengths[rows[live]] > k]
        if not len(live):
            break
        a, b = ids[np.minimum(starts[live] + k, len(ids) - 1)], bench.table[rows[live], k]
        out[live[a < b]], out[live[a > b]] = -1, 1
        live = live[a == b]
    return out


def search(ids: np.ndarray, array: np.ndarray, bench: Benchmark) -> tuple[np.ndarray, np.ndarray]:
    """For each window the range of places in ``array`` whose suffixes begin with it. ``ids`` ends with 0."""
    rows = np.arange(len(bench.keys))
    found = []
    for upper in (False, True):
        low, high = np.zeros(len(rows), np.int64), np.full(len(rows), len(array), np.int64)
        while len(array):
            live = np.flatnonzero(low < high)
            if not len(live):
                break
            mid = (low[live] + high[live]) // 2
            side = _compare(ids, array[mid], bench, live)
            right = (side < 0) | ((side == 0) & upper)
            low[live[right]], high[live[~right]] = mid[right] + 1, mid[~right]
        found.append(low)
    return found[0], found[1]


def match(texts: pa.Array, bench: Benchmark) -> Iterator[tuple[int, list[tuple[str, int, int, int]]]]:
    """For each text its number of words and its longest matches: (item, first word there, first word here, words), in order.

    A match is as long as both texts agree, and at least a window, or the whole of a shorter item.
    """
    data, at = raw(texts)
    # a blank behind each text, so that no word or window reaches into the next
    n = len(at) - 1
    spaced = np.full(len(data) + n, 32, np.uint8)
    place = np.arange(len(data)) + np.repeat(np.arange(n), np.diff(at)) if n > 1 else slice(0, len(data))
    spaced[place] = np.frombuffer(data.tobytes().translate(_BLANKED), np.uint8)
    is_word = np.concatenate([[False], spaced != 32, [False]])
    first = np.flatnonzero(is_word[1:-1] & ~is_word[:-2])
    end = np.flatnonzero(is_word[1:-1] & ~is_word[2:]) + 1
    bounds = np.searchsorted(first, at + np.arange(n + 1))
    # word k of document d has place k + d in ids; a 0 stands behind each document
    ids = np.zeros(len(first) + n + 1, np.int32)
    found = bench.lookup(word_hashes(spaced, first, end))
    owner = np.repeat(np.arange(n), np.diff(bounds))
    ids[np.arange(len(first)) + owner] = found
    array = suffix_array(ids, len(bench.words))
    low, high = search(ids, array, bench)
    size = high - low
    window = np.repeat(np.arange(len(size)), size)
    where = array[np.repeat(low - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(size.sum())] if len(size) else np.zeros(0, np.int64)
    doc = np.searchsorted(bounds + np.arange(n + 1), where, side="right") - 1
    word = where - doc
    order = np.lexsort((where, doc))
    cuts = np.searchsorted(doc[order], np.arange(n + 1))
    for d in range(n):
        # matches that may still grow, by benchmark text and the distance between the two places
        open_: dict[tuple[int, int], list[int]] = {}
        found_: list[tuple[str, int, int, int]] = []
        for o in order[cuts[d]:cuts[d + 1]]:
            w, a = int(window[o]), int(word[o])
            b = a + int(bench.lengths[w])
            if spaced[first[a]:end[b - 1]].tobytes().split() != [bench.words[i] for i in bench.keys[w]]:
                continue  # another word with the same hash
            a, b = a - int(bounds[d]), b - int(bounds[d])
            for t, j in bench.places[w]:
                match_ = open_.get((t, a - j))
                if match_ and a <= match_[2]:  # the suffix before began one word earlier
                    match_[1], match_[2] = b, a + 1
                else:
                    if match_:
                        found_.append((bench.items[t], match_[0] - (a - j), match_[0], match_[1] - match_[0]))
                    open_[t, a - j] = [a, b, a + 1]
        found_ += [(bench.items[t], m[0] - shift, m[0], m[1] - m[0]) for (t, shift), m in open_.items()]
        yield int(bounds[d + 1] - bounds[d]), sorted(set(found_), key=lambda m: (m[2], -m[3], m[0], m[1]))


def runs_of(matches: list[tuple[str, int, int, int]]) -> list[tuple[int, int]]:
    """The words inside matches as (first, end) runs that don't touch. Matches come in order of their place."""
    runs: list[tuple[int, int]] = []
    for _, _, a, size in matches:
        if runs and a <= runs[-1][1]:
            runs[-1] = (runs[-1][0], max(a + size, runs[-1][1]))
        else:
            runs.append((a, a + size))
    return runs


_MATCHED = "struct<n_words:bigint,runs:array<struct<first:bigint,end:bigint>>,items:array<string>,matches:array<struct<item:string,item_first:bigint,first:bigint,words:bigint>>>"
_MATCH = pa.struct([("item", pa.string()), ("item_first", pa.int64()), ("first", pa.int64()), ("words", pa.int64())])
_KIND = pa.struct([
    ("n_words", pa.int64()), ("runs", pa.list_(pa.struct([("first", pa.int64()), ("end", pa.int64())]))), ("items", pa.list_(pa.string())), ("matches", pa.list_(_MATCH))])


def benchmark_parts(benchmark: DataFrame, item_id: str = "item_id", text: str = "text", limit: int = BENCHMARK_BYTES) -> list[DataFrame]:
    """The benchmark's different rows with an id and a text, dealt row by row into parts of about ``limit`` bytes.

    The rows of one id may lie in several parts; a part holds one row at least, so its bound is the longest text.
    """
    rows = picked(benchmark, item_id=item_id, text=text).filter("item_id is not null and text is not null").distinct()
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(1, -(-total // limit))
    return [rows] if parts == 1 else [rows.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == p) for p in range(parts)]


def _merged(results: list[DataFrame], keys: list[str]) -> DataFrame:
    """Matches against parts of a benchmark put together by document; runs are merged again."""
    every = results[0]
    for r in results[1:]:
        every = every.unionByName(r)
    both = every.groupBy(*keys).agg(
        F.max("n_words").alias("n_words"), F.sort_array(F.flatten(F.collect_list("runs"))).alias("runs"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"),
        F.array_distinct(F.flatten(F.collect_list("matches"))).alias("matches"))
    grown = F.aggregate(
        "runs", F.slice("runs", 1, 0),
        lambda acc, r: F.when((F.size(acc) > 0) & (r["first"] <= F.try_element_at(acc, F.lit(-1))["end"]), F.concat(
            F.slice(acc, 1, F.size(acc) - 1),
            F.array(F.struct(F.try_element_at(acc, F.lit(-1))["first"].alias("first"), F.greatest(F.try_element_at(acc, F.lit(-1))["end"], r["end"]).alias("end")))))
        .otherwise(F.concat(acc, F.array(r))))
    return both.withColumn("runs", grown)


def matcher(part: DataFrame, window: int = WINDOW):
    """A column function text -> (n_words, runs, items, matches) against the rows of one bounded part."""
    items = [(r.item_id, r.text.encode()) for r in part.collect()]
    items.sort(key=lambda x: (str(x[0]), x[1]))
    sent = part.sparkSession.sparkContext.broadcast(items)

    @F.arrow_udf(_MATCHED)
    def matched(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        bench = Benchmark(sent.value, window)
        for batch in batches:
            texts = text_bytes(batch)
            rows = [x for a, b in slices(texts) for x in match(texts[a:b], bench)]
            names = _MATCH.names
            yield pa.array([{
                "n_words": n, "runs": [{"first": a, "end": b} for a, b in runs_of(found)], "items": sorted({m[0] for m in found}),
                "matches": [dict(zip(names, m)) for m in found]} for n, found in rows], _KIND)

    return matched.asNondeterministic()


def find(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", window: int = WINDOW, limit: int = BENCHMARK_BYTES) -> DataFrame:
    """(doc_id, n_words, runs, items, matches): runs of words (first, end) inside matches, item ids as text, longest matches with places.

    A match (item, item_first, first, words) goes as far as both texts agree word by word. One row per row of ``docs``. Null and empty texts have no words; items with a null id or
    text take no part; an item of fewer than ``window`` words is one window; repeated items
    count once by id. With an empty benchmark nothing is hit.
    """
    rows = picked(docs, doc_id=doc_id, text=text)
    parts = benchmark_parts(benchmark, limit=limit)
    if len(parts) == 1:
        return rows.select("doc_id", matcher(parts[0], window)("text").alias("m")).select("doc_id", "m.*")
    # a number for each row joins the parts; it is written once, so it stays the same
    numbered = cut_lineage(rows.withColumn("row", F.monotonically_increasing_id()), "numbered")
    return _merged([numbered.select("row", "doc_id", matcher(p, window)("text").alias("m")).select("row", "doc_id", "m.*") for p in parts], ["row", "doc_id"]).drop("row")


def digests(found: DataFrame) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, sha256 of the joined item ids, contaminated, words of the longest match."""
    hit = F.aggregate("runs", F.lit(0).cast("bigint"), lambda n, r: n + r["end"] - r["first"])
    return found.select(
        "doc_id", "n_words", hit.alias("n_hit"), F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), (F.size("runs") > 0).alias("contaminated"),
        F.coalesce(F.array_max(F.transform("matches", lambda m: m["words"])), F.lit(0)).alias("longest"))


def clean(docs: DataFrame, benchmark: DataFrame, text: str = "text", window: int = WINDOW, limit: int = BENCHMARK_BYTES) -> DataFrame:
    """The rows of ``docs`` that hold no benchmark window, columns unchanged; a larger benchmark is applied part by part.

    Rows with a null or empty text stay, as do repeated rows; benchmark rows as in ``find``; a clash of column names does no harm.
    """
    for part in benchmark_parts(benchmark, limit=limit):
        name = fresh(docs, "match")
        docs = docs.withColumn(name, matcher(part, window)(F.col(f"`{text}`"))).filter(F.size(f"`{name}`.runs") == 0).drop(name)
    return docs
