"""SentencePiece segmentations sampled over the whole piece lattice, and lossless decoding.

Forward filtering sums, for each place in a chunk of text, the weights of all segmentations
up to it; backward sampling walks from the end and draws each piece by its share of that sum.
Draws are a hash of the row's key, the chunk's number and the step, so a repeated task, another
partitioning or another batch size gives the same pieces.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import fresh, picked, slices, text_bytes

SEED, THETA = 11, 1.0
#: Bytes of text whose lattices are held at a time.
LATTICE_BYTES = 1 << 19
#: Characters of chunks whose lattices a task of ``digests`` remembers from one slice of text to the next.
REMEMBERED = 1_000_000
#: Draws and shares are whole numbers of so many bits, so a chunk's tables are the same wherever they lie.
SHARE_BITS = 32
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
_RUN = re.compile(" *[^ ]+| +")


def _mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit mixing of counters (splitmix64)."""
    x = x + _MULTIPLIER
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Pieces:
    """The pieces of a model with byte fallback; a blank stands for its mark of word starts."""

    def __init__(self, path: str, theta: float = THETA):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.get_piece_size()
        self.size = n
        self.byte_ids = np.zeros(256, np.int32)
        self.bytes: list[bytes] = [b""] * n
        normal = {}
        scores = np.zeros(n)
        have = set()
        for i in range(n):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                value = int(piece[1:-1], 16)
                self.byte_ids[value], self.bytes[i] = i, bytes([value])
                have.add(value)
            elif not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i)):
                normal[piece.replace("▁", " ")] = i
                scores[i] = model.get_score(i)
                self.bytes[i] = piece.replace("▁", " ").encode()
        if len(have) < 256:
            raise ValueError("the model has no byte fallback")
        if any(" " in p.lstrip(" ") or "\n" in p for p in normal):
            raise ValueError("a piece reaches across words")
        # scores of merges are ranks: their weight falls as a power of the rank
        self.weight = -theta * np.log(2.0 - scores)
        prefixes: dict[str, int] = {}
        for p, i in normal.items():
            for k in range(1, len(p)):
                prefixes.setdefault(p[:k], -1)
            prefixes[p] = i
        hashes = np.array([self._hash(p) for p in prefixes], np.uint64)
        order = np.argsort(hashes)
        self.hashes, self.of_hash = hashes[order], np.array(list(prefixes.values()), np.int32)[order]
        assert len(np.unique(hashes)) == len(hashes), "two prefixes have one hash"
        self.seen = np.zeros(1 << 22, bool)
        self.seen[(hashes >> np.uint64(42)).astype(np.int64)] = True

    @staticmethod
    def _hash(text: str) -> int:
        h = 0
        for c in text:
            h = (h * int(_MULTIPLIER) + ord(c) + 1) % (1 << 64)
        return h

    def arcs(self, codes: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(first, end, piece) of all pieces inside the chunks; ``stop``: end of the chunk of each place.

        A character that is no piece gets an arc with ``size`` plus its code point.
        """
        live = np.arange(len(codes))
        h = np.zeros(len(codes), np.uint64)
        found, length = [], 0
        alone = np.ones(len(codes), bool)
        while len(live):
            h = h * _MULTIPLIER + (codes[live + length].astype(np.uint64) + np.uint64(1))
            length += 1
            maybe = np.flatnonzero(self.seen[(h >> np.uint64(42)).astype(np.int64)])
            at = np.minimum(np.searchsorted(self.hashes, h[maybe]), len(self.hashes) - 1)
            same = self.hashes[at] == h[maybe]
            maybe, at = maybe[same], at[same]
            piece = self.of_hash[at]
            full = piece >= 0
            first = live[maybe[full]]
            found.append((first, first + length, piece[full]))
            if length == 1:
                alone[first] = False
            going = live[maybe] + length < stop[live[maybe]]
            live, h = live[maybe[going]], h[maybe[going]]
        odd = np.flatnonzero(alone)
        found.append((odd, odd + 1, (self.size + codes[odd].astype(np.int64)).astype(np.int32)))
        return tuple(np.concatenate(x) for x in zip(*found))

    def decode(self, ids) -> str:
        """The text of a row's pieces; the blank put before it goes."""
        return b"".join(map(self.bytes.__getitem__, ids))[1:].decode()


class Lattice:
    """Forward sums and sampling tables of a list of different chunks."""

    def __init__(self, pieces: Pieces, chunks: list[str]):
        n = np.fromiter(map(len, chunks), np.int64, len(chunks))
        codes = np.frombuffer("".join(chunks).encode("utf-32-le"), np.uint32)
        start = np.cumsum(n) - n
        self.last = start + n - 1
        first, end, piece = pieces.arcs(codes, np.repeat(start + n, n))
        order = np.argsort(end, kind="stable")
        first, state, self.piece = first[order], end[order] - 1, piece[order]
        begins = np.repeat(start, n)
        self.source = np.where(first > begins[first] if len(first) else first, first - 1, -1)
        weight = np.where(self.piece < pieces.size, pieces.weight[np.minimum(self.piece, pieces.size - 1)], -20.0)
        total = np.zeros(len(codes) + 1)  # the last stands for the start of a chunk: log 1
        depth = (np.arange(len(codes)) - begins)[state] if len(state) else state
        shallow = depth.max(initial=0) < 1 << 16  # short numbers are sorted in linear time
        by_depth = np.argsort(depth.astype(np.uint16) if shallow else depth, kind="stable")
        cuts = np.searchsorted(depth[by_depth], np.arange(int(depth.max(initial=-1)) + 2))
        for a, b in zip(cuts[:-1], cuts[1:]):
            own = by_depth[a:b]
            value, to = weight[own] + total[self.source[own]], state[own]
            heads = np.flatnonzero(np.concatenate([[True], to[1:] != to[:-1]]))
            top = np.maximum.reduceat(value, heads)
            spread = np.repeat(top, np.diff(np.append(heads, len(own))))
            total[to[heads]] = top + np.log(np.add.reduceat(np.exp(value - spread), heads))
        share = np.floor(np.exp(weight + total[self.source] - total[state]) * (1 << SHARE_BITS)).astype(np.int64)
        running = np.cumsum(share)
        heads = np.flatnonzero(np.concatenate([[True], state[1:] != state[:-1]])) if len(state) else state
        sizes = np.diff(np.append(heads, len(state)))
        running -= np.repeat((running - share)[heads], sizes)
        self.key = np.minimum(running, 1 << SHARE_BITS, out=running)
        self.key += state << SHARE_BITS
        self.key[heads + sizes - 1] = (state[heads] + 1) << SHARE_BITS
        self.arcs_to = np.searchsorted(state, self.last, side="right")
        self.size = len(codes)

    def sample(self, chunk: np.ndarray, counter: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return sample(self.key, self.source, self.piece, self.last[chunk], counter)


def sample(key: np.ndarray, source: np.ndarray, piece: np.ndarray, last: np.ndarray, counter: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pieces of each occurrence of a chunk in order, and how many each has. ``last``: the chunk's last place; ``counter``: the occurrence's random key."""
    live = np.argsort(last, kind="stable")  # equal chunks together: neighbouring places of the table
    state = last[live]
    steps, count = [], np.zeros(len(last), np.int64)
    while len(live):
        u = (_mixed(counter[live] + np.uint64(len(steps))) >> np.uint64(64 - SHARE_BITS)).astype(np.int64)
        arc = np.searchsorted(key, (state << SHARE_BITS) + u, side="right")
        steps.append((live, piece[arc]))
        count[live] += 1
        state = source[arc].astype(np.int64)
        on = state >= 0
        live, state = live[on], state[on]
    ends = np.cumsum(count)
    out = np.zeros(int(ends[-1]) if len(ends) else 0, np.int32)
    for k, (rows, ids) in enumerate(steps):
        out[ends[rows] - 1 - k] = ids
    return out, count


class Remembered:
    """Lattices of chunks by number, kept from one slice of text to the next."""

    def __init__(self, pieces: Pieces, limit: int = REMEMBERED):
        self.pieces, self.limit = pieces, limit
        self.known: dict[str, int] = {}  # in the order of the numbers, as are the places and arcs of chunks
        self.last, self.arcs_to, self.uses = (np.zeros(0, np.int64) for _ in range(3))
        self.n_places = self.n_arcs = 0
        self.key, self.source, self.piece = np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros(0, np.int32)

    def numbers(self, chunks: list[str]) -> np.ndarray:
        """The number of each chunk; those of slices before don't hold any more."""
        if self.n_places > self.limit:
            self._forget()
        new = [c for c in dict.fromkeys(chunks) if c not in self.known]
        if new:
            self.known.update(zip(new, range(len(self.known), len(self.known) + len(new))))
            self._add(Lattice(self.pieces, new))
        number = np.fromiter(map(self.known.__getitem__, chunks), np.int64, len(chunks))
        self.uses += np.bincount(number, minlength=len(self.uses))
        return number

    def sample(self, chunk: np.ndarray, counter: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return sample(self.key[:self.n_arcs], self.source, self.piece, self.last[chunk], counter)

    def _add(self, found: Lattice) -> None:
        a, b = self.n_arcs, self.n_arcs + len(found.key)
        if b > len(self.key):  # with room for more, so that few slices copy what is held
            for name in ("key", "source", "piece"):
                held = getattr(self, name)
                setattr(self, name, np.concatenate([held[:a], np.zeros(b - a + b // 4, held.dtype)]))
        self.key[a:b] = found.key + (self.n_places << SHARE_BITS)
        self.source[a:b] = np.where(found.source >= 0, found.source + self.n_places, -1)
        self.piece[a:b] = found.piece
        self.last = np.concatenate([self.last, found.last + self.n_places])
        self.arcs_to = np.concatenate([self.arcs_to, found.arcs_to + a])
        self.uses = np.concatenate([self.uses, np.zeros(len(found.last), np.int64)])
        self.n_places, self.n_arcs = self.n_places + found.size, b

    def _forget(self) -> None:
        """Keeps the chunks met most often, at least twice: half of the limit at most. Older uses count half."""
        places, arcs = np.diff(self.last + 1, prepend=0), np.diff(self.arcs_to, prepend=0)
        often = np.flatnonzero(self.uses > 1)
        often = often[np.argsort(-self.uses[often], kind="stable")]
        kept = np.sort(often[np.cumsum(places[often]) <= self.limit // 2])
        chunks = list(self.known)
        self.known = {chunks[k]: n for n, k in enumerate(kept.tolist())}
        places, arcs = places[kept], arcs[kept]
        last, arcs_to = np.cumsum(places) - 1, np.cumsum(arcs)
        at = np.repeat(self.arcs_to[kept] - arcs_to, arcs) + np.arange(arcs.sum())
        down = np.repeat(self.last[kept] - last, arcs)
        source = self.source[at]
        self.key, self.piece = self.key[at] - (down << SHARE_BITS), self.piece[at]
        self.source = np.where(source >= 0, source - down, -1).astype(np.int32)
        self.last, self.arcs_to, self.uses = last, arcs_to, self.uses[kept] // 2
        self.n_places, self.n_arcs = int(places.sum()), len(at)


def chunks_of(text: str) -> list[str]:
    """Chunks no piece reaches across: blanks with the word behind them, and line feeds. A blank is put before the text."""
    out: list[str] = []
    if text:
        for k, line in enumerate((" " + text).split("\n")):
            if k:
                out.append("\n")
            parts = line.split(" ")
            if "" in parts[1:]:
                out += _RUN.findall(line)
            else:
                out += parts[:1] if parts[0] else []
                out += [" " + p for p in parts[1:]]
    return out


def _utf8(codes: np.ndarray, k: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Byte k of the UTF-8 form of each code point."""
    shift = 6 * (size - 1 - k)
    lead = np.array([0, 0, 0xC0, 0xE0, 0xF0])[size]
    return np.where(size == 1, codes, np.where(k == 0, lead | (codes >> shift), 0x80 | ((codes >> shift) & 0x3F)))


def encode(pieces: Pieces, texts: list[str], keys: np.ndarray, remembered: Remembered | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Sampled ids of all texts one after the other, and how many each has. ``keys``: random key of each text."""
    split = [chunks_of(t) for t in texts]
    every = list(chain.from_iterable(split))
    if remembered is None:
        number = dict.fromkeys(every)
        number.update(zip(number, range(len(number))))
        chunk = np.fromiter(map(number.__getitem__, every), np.int64, len(every))
    else:
        chunk = remembered.numbers(every)
    counts = np.fromiter(map(len, split), np.int64, len(split))
    del every, split
    if not len(chunk):
        return np.zeros(0, np.int32), counts
    place = np.arange(len(chunk)) - np.repeat(np.cumsum(counts) - counts, counts)
    counter = _mixed(np.repeat(keys.astype(np.uint64), counts) + _mixed(place.astype(np.uint64)))
    ids, per_chunk = (remembered or Lattice(pieces, list(number))).sample(chunk, counter)
    odd = ids >= pieces.size
    if odd.any():  # characters in bytes
        code = np.where(odd, ids.astype(np.int64) - pieces.size, 0)
        size = np.where(odd, 1 + (code > 0x7F) + (code > 0x7FF) + (code > 0xFFFF), 1)
        per_chunk = np.add.reduceat(size, np.cumsum(per_chunk) - per_chunk)
        k = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
        wide = np.repeat(odd, size)
        ids, code, size = np.repeat(ids, size), np.repeat(code, size), np.repeat(size, size)
        ids[wide] = pieces.byte_ids[_utf8(code[wide], k[wide], size[wide])]
    ends = np.concatenate([[0], np.cumsum(per_chunk)])
    bounds = np.concatenate([[0], np.cumsum(counts)])
    return ids, np.diff(ends[bounds])


def model_path(name: str = "piece_bpe_32k.model") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _encoded(pieces: Pieces, texts: pa.Array, keys: pa.Array, remembered: Remembered | None = None) -> Iterator[tuple[list[str], np.ndarray, np.ndarray]]:
    texts, key = texts.fill_null(""), keys.to_numpy(zero_copy_only=False).view(np.uint64)
    for a, b in list(slices(text_bytes(texts), LATTICE_BYTES)):  # first all, so that no second copy of the texts is held
        rows = texts[a:b].to_pylist()
        yield rows, *encode(pieces, rows, key[a:b], remembered)


def row_key(doc_id: str = "doc_id", seed: int = SEED):
    """Random key of a row; a null id gives the key of the seed alone."""
    return F.xxhash64(F.lit(seed), F.col(f"`{doc_id}`").cast("string"))


def encode_column(model: str, theta: float = THETA, verify: bool = False):
    """A column function (text, key) -> ids; null and empty texts have none. ``verify``: decode every row, and fail if it isn't the text."""
    @F.arrow_udf("array<int>")
    def ids_of(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        pieces = Pieces(model, theta)
        for texts, keys in batches:
            ids, counts = [np.zeros(0, np.int32)], [np.zeros(1, np.int64)]
            for rows, i, n in _encoded(pieces, texts, keys):
                ids.append(i)
                counts.append(n)
                at = np.cumsum([0, *n.tolist()]).tolist()
                for source, a, b in zip(rows, at, at[1:]) if verify else ():
                    if pieces.decode(i[a:b].tolist()) != source:
                        raise ValueError(f"pieces don't decode to their text, which begins with {source[:80]!r}")
            yield pa.ListArray.from_arrays(pa.array(np.cumsum(np.concatenate(counts)).astype(np.int32)), pa.array(np.concatenate(ids)))

    return ids_of


def decode_column(model: str):
    """A column function ids -> text; null and no ids give an empty text."""
    @F.arrow_udf("string")
    def text_of(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        pieces = Pieces(model)
        for ids in batches:
            yield pa.array([pieces.decode(x.as_py() or ()) for x in ids], pa.string())

    return text_of


def sampled(docs: DataFrame, model: str | None = None, doc_id: str = "doc_id", text: str = "text", seed: int = SEED, theta: float = THETA, verify: bool = False) -> DataFrame:
    """``docs`` with ``piece_ids``, one sampled segmentation of each whole text (``_piece_ids`` if that name is taken), decoded again with ``verify``."""
    ids = encode_column(model or model_path(), theta, verify)
    return docs.withColumn(fresh(docs, "piece_ids"), ids(F.col(f"`{text}`"), row_key(doc_id, seed)))


def digests(docs: DataFrame, model: str | None = None, doc_id: str = "doc_id", text: str = "text", seed: int = SEED, theta: float = THETA) -> DataFrame:
    """doc_id, n_pieces, ids_crc32 (little-endian 32-bit ids), text_sha256 of the decoded text, lossless.

    ``lossless``: decoding gives the source text; null counts as empty. Rows with the same id and text get the same pieces.
    """
    path = model or model_path()
    rows = picked(docs, doc_id=doc_id, text=text)
    kind = pa.struct([("n_pieces", pa.int64()), ("ids_crc32", pa.int64()), ("text_sha256", pa.string()), ("lossless", pa.bool_())])

    @F.arrow_udf("n_pieces bigint, ids_crc32 bigint, text_sha256 string, lossless boolean")
    def there_and_back(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        pieces = Pieces(path, theta)
        remembered = Remembered(pieces)
        for texts, keys in batches:
            out = []
            for rows, ids, counts in _encoded(pieces, texts, keys, remembered):
                at = 0
                for source, n in zip(rows, counts.tolist()):
                    own = ids[at:at + n]
                    back = pieces.decode(own.tolist())
                    out.append((n, zlib.crc32(own.astype("<u4")), hashlib.sha256(back.encode()).hexdigest(), back == source))
                    at += n
            yield pa.array(out, kind)

    return rows.select("doc_id", there_and_back("text", row_key("doc_id", seed)).alias("d")).select("doc_id", "d.*")
