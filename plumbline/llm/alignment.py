"""Alignment of two tokenizations of the same text: a byte-level BPE (A) and SentencePiece pieces with byte fallback (B).

Spans come from the tokenizers themselves: character offsets of A, byte spans of B (those of its encoding
proto; the installed release gives them as an offset mapping and has no immutable proto any more). They are the coarse cuts. Where a span can't tell - a character that A cuts into several tokens, a byte
that B writes as a token of its own - the bytes of the decoded token do.

Neither tokenizer joins what a single blank between two other characters parts, so a text is aligned
chunk by chunk and a chunk's alignment is remembered. Corpus-wide counts of id pairs never meet a
document one by one: a task sums up shards of bounded size, a shard's pairs get the corpus-wide counts,
and these go back to the shard's documents.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, fields
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.llm.common import picked, slices, text_bytes
from plumbline.session import cut_lineage

#: Bytes of text to a shard; a longer text is a shard of its own.
SHARD_BYTES = 4 << 20
#: Chunks a task remembers from one shard to the next, chunks encoded as one text, and characters of text cut into chunks at a time.
REMEMBERED, ROW_CHUNKS, GROUP_CHARS = 250_000, 1000, 1 << 19

# a blank with something else on both sides; other white space may lean on blanks, so it is no cut
_CUT = re.compile(r"(?<=\S) (?=\S)")


@dataclass
class Aligned:
    """Aligned chunks in a row. ``links``: pairs of overlapping tokens, each A id << 32 | B id, chunk after chunk."""

    n_a: np.ndarray
    n_b: np.ndarray
    n_groups: np.ndarray
    n_links: np.ndarray
    whole: np.ndarray  # both token rows join to the chunk's bytes
    links: np.ndarray
    groups: list[str]


def bare(chunks: list[str]) -> bool:
    """Whether no chunk has white space at its edges."""
    return list(map(str.strip, chunks)) == chunks


def byte_level(token: str, letters: dict[str, int]) -> bytes:
    return bytes(letters[c] for c in token)


class Aligner:
    """The two tokenizers and the bytes of their tokens."""

    def __init__(self, byte_bpe: str, pieces: str):
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(byte_bpe)
        self.a.encode_special_tokens = True  # their strings in a text are ordinary text
        # the byte-level rule: printable bytes stand for themselves, the others follow 255 in order
        plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
        others = iter(range(256, 512))
        letters = {chr(b if b in plain else next(others)): b for b in range(256)}
        self.a_bytes = {i: byte_level(t, letters) for t, i in self.a.get_vocab(with_added_tokens=False).items()}
        self.b = sentencepiece.SentencePieceProcessor(model_file=pieces)
        self.b_bytes: list[bytes] = []
        self.is_byte: list[bool] = []
        joins = False
        for i in range(self.b.get_piece_size()):
            piece = self.b.id_to_piece(i)
            self.is_byte.append(self.b.is_byte(i))
            if self.is_byte[i]:
                self.b_bytes.append(bytes([int(piece[1:-1], 16)]))
            elif self.b.is_control(i) or self.b.is_unknown(i):
                self.b_bytes.append(b"")
            else:
                self.b_bytes.append(piece.replace("▁", " ").encode())
                joins |= "▁" in piece[1:] and bool(piece.strip("▁"))
        self.a_size = np.zeros(max(self.a_bytes) + 1, np.int64)
        for i, t in self.a_bytes.items():
            self.a_size[i] = len(t)
        self.b_size, self.is_byte = np.array([len(t) for t in self.b_bytes]), np.array(self.is_byte)
        self.text = [str(i) for i in range(max(len(self.a_size), len(self.b_size)))]
        self.signed = [t + sign for sign in ",|;" for t in self.text]
        self.signed_size = np.array(list(map(len, self.signed)))
        self.cuts = not joins  # else a piece could reach over a blank, and texts are aligned whole

    def chunks(self, text: str) -> list[str]:
        """The text in parts that can be aligned alone; the blank at a cut is left out."""
        if not text:
            return []
        if not self.cuts:
            return [text]
        parts = text.split(" ")
        if "" not in parts and bare(parts):
            return parts  # each blank is a cut
        return _CUT.split(text)

    @staticmethod
    def rows(chunks: list[str], size: int) -> list[list[str]]:
        """The chunks, reordered, in rows of at most ``size`` that are encoded as one text.

        White space at the edges of a chunk must not meet white space of the next, and a blank at its end not the blank
        between chunks: chunks that begin with white space come first, those that end with it last, the others alone.
        """
        alone: list[str] = []
        if not bare(chunks):
            alone = [c for c in chunks if c[-1] == " " or c[-1].isspace() and c[0].isspace()]
            known = set(alone)
            chunks = sorted((c for c in chunks if c not in known), key=lambda c: c[-1].isspace() - c[0].isspace())
        return [[c] for c in alone] + [chunks[k:k + size] for k in range(0, len(chunks), size)]

    def align(self, chunks: list[str]) -> Aligned:
        """The chunks, a row of ``rows``, are encoded as one text. If its tokens don't join to it, one chunk is to blame, and each is encoded alone."""
        found = self._row(chunks)
        if found is None and len(chunks) == 1:
            none = np.zeros(1, np.int64)
            return Aligned(none, none, none, none, np.zeros(1, bool), np.zeros(0, np.int64), [""])
        if found is None:
            each = [self.align([c]) for c in chunks]
            arrays = [np.concatenate([getattr(x, f.name) for x in each]) for f in fields(Aligned)[:-1]]
            return Aligned(*arrays, [g for x in each for g in x.groups])
        return found

    def a_ends(self, text: str, ids: np.ndarray, spans: np.ndarray) -> np.ndarray:
        """Byte end of each A token. A span ends cleanly if the next begins there or later; inside a character only the decoded bytes tell."""
        if text.isascii():
            return spans[:, 1]
        points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        at = np.concatenate([[0], np.cumsum(1 + (points > 0x7F) + (points > 0x7FF).astype(np.int64) + (points > 0xFFFF))])
        clean = np.concatenate([spans[1:, 0] >= spans[:-1, 1], [True]])
        return self._refined(np.where(clean, at[spans[:, 1]], 0), clean, self.a_size[ids])

    def b_ends(self, ids: np.ndarray, spans: np.ndarray) -> np.ndarray:
        """Byte end of each B token, behind the added blank. A byte token's span may be empty, so its one byte tells."""
        return self._refined(spans[:, 1] + 1, ~self.is_byte[ids], self.b_size[ids])

    @staticmethod
    def _refined(ends: np.ndarray, clean: np.ndarray, size: np.ndarray) -> np.ndarray:
        """``ends`` where they are clean; elsewhere the last clean end and the decoded bytes since."""
        decoded = np.cumsum(size)
        last = np.maximum.accumulate(np.where(clean, np.arange(len(ends)), -1))
        base = np.where(last < 0, 0, ends[last] - decoded[last])
        return np.where(clean, ends, base + decoded)

    def _row(self, chunks: list[str]) -> Aligned | None:
        """Both tokenizers put a blank before each chunk: A gets it written, B adds the first."""
        joined = " ".join(chunks)
        source = (" " + joined).encode()
        e = self.a.encode(" " + joined, add_special_tokens=False)
        p = self.b.encode(joined, return_type="offset_mapping", return_bytes=True)
        if b"".join(map(self.a_bytes.__getitem__, e.ids)) != source or b"".join(map(self.b_bytes.__getitem__, p["ids"])) != source:
            return None
        a, b = np.array(e.ids, np.int64), np.array(p["ids"], np.int64)
        a_end = self.a_ends(" " + joined, a, np.fromiter(chain.from_iterable(e.offsets), np.int64, 2 * len(a)).reshape(-1, 2))
        b_end = self.b_ends(b, np.fromiter(chain.from_iterable(p["offsets"]), np.int64, 2 * len(b)).reshape(-1, 2))
        # how many B tokens, and A tokens, end at or before each byte
        b_upto, a_upto = (np.cumsum(np.bincount(ends, minlength=len(source) + 1)) for ends in (b_end, a_end))
        # the B tokens that each A token overlaps: the first that ends behind its start, up to the last that starts before its end
        first, last = b_upto[np.concatenate([[0], a_end[:-1]])], b_upto[a_end - 1] + 1
        size = last - first
        of_a = np.repeat(np.arange(len(a)), size)
        of_b = np.repeat(first - (np.cumsum(size) - size), size) + np.arange(size.sum())
        # both end at the end of a chunk
        bounds = np.cumsum([len(c) if c.isascii() else len(c.encode()) for c in chunks]) + np.arange(1, len(chunks) + 1)
        last_a, last_b = b_upto[a_end] > b_upto[a_end - 1], a_upto[b_end] > a_upto[b_end - 1]
        cuts = a_end[last_a]
        # tokens in the order of the groups' text, each with the sign behind it: A's of a group, then B's
        a_group, b_group = np.cumsum(last_a) - last_a, np.cumsum(last_b) - last_b
        ends_a, ends_b = a_upto[cuts], np.concatenate([[0], b_upto[cuts]])
        written = np.empty(len(a) + len(b), np.int64)
        written[np.arange(len(a)) + ends_b[a_group]] = a + last_a * len(self.text)
        written[np.arange(len(b)) + ends_a[b_group]] = b + (2 * last_b) * len(self.text)
        text = "".join(map(self.signed.__getitem__, written.tolist()))
        upto = {"a": a_upto[bounds], "b": b_upto[bounds], "g": np.searchsorted(cuts, bounds, side="right")}
        n_a, n_b, n_groups = (np.diff(v, prepend=0) for v in upto.values())
        ends = np.cumsum(self.signed_size[written])[upto["a"] + upto["b"] - 1].tolist()
        return Aligned(
            n_a, n_b, n_groups, np.diff(np.concatenate([[0], np.cumsum(size)])[upto["a"]], prepend=0), np.ones(len(chunks), bool), a[of_a] << 32 | b[of_b],
            [text[x:y - 1] for x, y in zip([0, *ends], ends)])


def tokenizer_paths() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


_LONGS = T.ArrayType(T.LongType())
#: A shard's rows: one with its pairs and chunks, one for each document. Numbers that only tasks read are 32-bit integers in bytes.
SHARDS = T.StructType([
    T.StructField("shard", T.LongType()), T.StructField("doc_id", T.LongType()), T.StructField("n_a", T.LongType()),
    T.StructField("n_b", T.LongType()), T.StructField("n_groups", T.LongType()), T.StructField("n_links", T.LongType()),
    T.StructField("groups_sha256", T.StringType()), T.StructField("chunks", T.BinaryType()),
    T.StructField("pairs", _LONGS), T.StructField("times", _LONGS), T.StructField("ends", T.BinaryType()), T.StructField("pair_of", T.BinaryType())])
SUMS = ["n_a", "n_b", "n_groups", "n_links"]


class Sharder:
    """Aligns documents and sums up a shard of them at a time. What is remembered of a chunk has its number as its place."""

    def __init__(self, aligner: Aligner, remembered: int = REMEMBERED):
        self.aligner, self.remembered = aligner, remembered
        self.known: dict[str, int] = {}  # in the order of the numbers
        self.groups: list[str] = []
        self.held = {f.name: [] for f in fields(Aligned)[:-1]}  # arrays, put together when they are read
        self.uses = np.zeros(0, np.int64)

    def _forget(self) -> None:
        """Keeps the chunks met most often, at least twice: half of what may be remembered at most. Older uses count half."""
        often = np.flatnonzero(self.uses > 1)
        kept = np.sort(often[np.argsort(-self.uses[often], kind="stable")[:self.remembered // 2]])
        links, numbers = self._links(kept), kept.tolist()
        chunks = list(self.known)
        self.known = {chunks[k]: n for n, k in enumerate(numbers)}
        self.groups = [self.groups[k] for k in numbers]
        self.held = {name: [links if name == "links" else self._column(name)[kept]] for name in self.held}
        self.uses = self.uses[kept] // 2

    def _links(self, chunks: np.ndarray) -> np.ndarray:
        """The links of the numbered chunks, one after the other."""
        size = self._column("n_links")[chunks]
        end = np.cumsum(self._column("n_links"))[chunks]
        return self._column("links")[np.repeat(end - np.cumsum(size), size) + np.arange(size.sum())]

    def _column(self, name: str) -> np.ndarray:
        self.held[name] = [np.concatenate([np.zeros(0, np.int64), *self.held[name]])]
        return self.held[name][0]

    def ids(self, texts: list[str]) -> list[np.ndarray]:
        """Numbers of the chunks of each text."""
        known = self.known
        chunks = [self.aligner.chunks(t) for t in texts]
        every = list(chain.from_iterable(chunks))
        missing = [c for c in dict.fromkeys(every) if c not in known]
        for part in self.aligner.rows(missing, ROW_CHUNKS):
            known.update(zip(part, range(len(self.groups), len(self.groups) + len(part))))
            row = self.aligner.align(part)
            self.groups += row.groups
            for name, parts in self.held.items():
                parts.append(getattr(row, name))
        numbers = np.fromiter(map(known.__getitem__, every), np.int64, len(every))
        at = np.cumsum([0, *map(len, chunks)])
        return [numbers[a:b] for a, b in zip(at, at[1:])]

    def shard(self, number: int, doc_ids: pa.Array, texts: list[str | None]) -> pa.RecordBatch:
        """The rows of one shard. Documents whose tokens don't join to their bytes have none."""
        ids, group, size = [], [], 0
        for t in texts:
            group.append(t or "")
            size += len(group[-1])
            if size >= GROUP_CHARS:
                ids += self.ids(group)
                group, size = [], 0
        ids += self.ids(group)
        whole = self._column("whole").astype(bool)
        ids = [own if whole[own].all() else own[:0] for own in ids]
        bounds = np.cumsum([0, *map(len, ids)])
        used, local = np.unique(np.concatenate([np.zeros(0, np.int64), *ids]), return_inverse=True)
        times = np.bincount(local, minlength=len(used))
        uses = np.zeros(len(self.groups), np.int64)
        uses[:len(self.uses)] = self.uses
        uses[used] += times
        self.uses = uses
        size, links = self._column("n_links")[used], self._links(used)
        pairs, pair_of = np.unique(links, return_inverse=True)
        count = np.bincount(pair_of, np.repeat(times, size), len(pairs)).astype(np.int64)
        sums = {}
        for name in SUMS:
            running = np.concatenate([[0], np.cumsum(self._column(name)[used][local])]).astype(np.int64)
            sums[name] = running[bounds[1:]] - running[bounds[:-1]]
        groups = self.groups.__getitem__
        digests = [hashlib.sha256(";".join(map(groups, own.tolist())).encode()).hexdigest() if len(own) else "" for own in ids]
        n, packed = len(ids), local.astype(np.int32).tobytes()
        columns = {
            "shard": pa.array(np.full(n + 1, number)), "doc_id": pa.concat_arrays([pa.nulls(1, pa.int64()), doc_ids.cast(pa.int64())]),
            **{k: pa.concat_arrays([pa.nulls(1, pa.int64()), pa.array(v, pa.int64())]) for k, v in sums.items()},
            "groups_sha256": pa.array([None, *digests], pa.string()),
            "chunks": pa.array([None, *(packed[4 * a:4 * b] for a, b in zip(bounds.tolist(), bounds[1:].tolist()))], pa.binary()),
            **{k: pa.concat_arrays([pa.ListArray.from_arrays(pa.array([0, len(v)], pa.int32()), pa.array(v, pa.int64())), pa.nulls(n, pa.list_(pa.int64()))])
               for k, v in (("pairs", pairs), ("times", count))},
            **{k: pa.array([v.astype(np.int32).tobytes(), *[None] * n], pa.binary()) for k, v in (("ends", np.cumsum(size)), ("pair_of", pair_of))},
        }
        if len(self.groups) > self.remembered:  # between shards nothing refers to what is remembered
            self._forget()
        return pa.RecordBatch.from_arrays([columns[f.name] for f in SHARDS.fields], SHARDS.names)


def shards(docs: DataFrame, byte_bpe: str, pieces: str, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """Rows of ``SHARDS``, written. ``docs``: doc_id, text."""
    def aligned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        sharder, number = Sharder(Aligner(byte_bpe, pieces)), TaskContext.get().partitionId() << 32
        ids, texts, size = [], [], 0

        def emit() -> pa.RecordBatch:
            return sharder.shard(number, pa.concat_arrays(ids), [t for part in texts for t in part])

        for batch in batches:
            column = batch.column("text")
            for a, b in slices(text_bytes(column), shard_bytes // 4):
                more = column[a:b].to_pylist()
                if size and size + sum(len(t or "") for t in more) > shard_bytes:
                    yield emit()
                    ids, texts, size, number = [], [], 0, number + 1
                texts.append(more)
                ids.append(batch.column("doc_id")[a:b])
                size += sum(len(t or "") for t in more)
        if texts:
            yield emit()

    return cut_lineage(docs.mapInArrow(aligned, SHARDS), "shards")


def pair_counts(found: DataFrame) -> DataFrame:
    """(pair, total, is_best), written: links of each id pair in all shards, and whether no pair of its B id has more.

    Best counts are a row for each B id, so there are never more than the B vocabulary has.
    """
    one = found.filter("pairs is not null").select(F.explode(F.arrays_zip("pairs", "times")).alias("x"))
    counts = cut_lineage(one.groupBy(F.col("x.pairs").alias("pair")).agg(F.sum("x.times").alias("total")), "pairs")
    b_id = F.col("pair").bitwiseAND(F.lit((1 << 32) - 1)).alias("b")
    best = counts.groupBy(b_id).agg(F.max("total").alias("most"))
    return counts.withColumn("b", b_id).join(F.broadcast(best), "b").select("pair", "total", (F.col("total") == F.col("most")).alias("is_best"))


_RESULT = "doc_id bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, n_best bigint, count_sum bigint, groups_sha256 string"


def _scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A shard's rows come in order: its chunks, then its pairs by number, then its documents."""
    total, best, sums = [], [], None
    for batch in batches:
        kind, shard = batch.column("kind").to_numpy(), batch.column("shard").to_numpy()
        cuts = [0, *(np.flatnonzero((kind[1:] != kind[:-1]) | (shard[1:] != shard[:-1])) + 1).tolist(), len(kind)]
        for a, b in zip(cuts, cuts[1:]):
            part = batch.slice(a, b - a)
            if a < b and kind[a] == 0:
                ends, pair_of = (np.frombuffer(part.column(k)[0].as_py(), np.int32) for k in ("ends", "pair_of"))
                total, best, sums = [], [], None
            elif a < b and kind[a] == 1:
                total.append(part.column("total").to_numpy())
                best.append(part.column("is_best").to_numpy(zero_copy_only=False))
            elif a < b:
                if sums is None:  # of each chunk
                    every = [np.concatenate(x) if x else np.zeros(0, np.int64) for x in (total, best)]
                    running = [np.concatenate([[0], np.cumsum(x[pair_of].astype(np.int64))]) for x in every]
                    firsts = np.concatenate([[0], ends[:-1]]).astype(np.int64)
                    sums = [r[ends] - r[firsts[:len(ends)]] for r in running]
                chunks = part.column("chunks").to_pylist()
                at = np.cumsum([0, *(len(c) // 4 for c in chunks)])
                chunk = np.frombuffer(b"".join(chunks), np.int32)
                running = [np.concatenate([[0], np.cumsum(s[chunk])]).astype(np.int64) for s in sums]
                count_sum, n_best = (r[at[1:]] - r[at[:-1]] for r in running)
                yield pa.RecordBatch.from_arrays([
                    part.column("doc_id"), *[part.column(k) for k in SUMS], pa.array(n_best), pa.array(count_sum), part.column("groups_sha256")],
                    ["doc_id", *SUMS, "n_best", "count_sum", "groups_sha256"])


def align(
    docs: DataFrame, byte_bpe: str | None = None, pieces: str | None = None, doc_id: str = "doc_id", text: str = "text", shard_bytes: int = SHARD_BYTES,
) -> DataFrame:
    """One row per row of ``docs``: tokens, groups, links, links of the corpus-wide best count, the sum of counts, the groups' digest.

    Null and empty texts, and texts whose tokens don't join to their bytes, have zeros and an empty digest.
    Rows with equal or null ids are rows like others; an empty table gives none; other columns don't matter.
    """
    first, second = tokenizer_paths()
    found = shards(picked(docs, doc_id=doc_id, text=text), byte_bpe or first, pieces or second, shard_bytes)
    tables = found.filter("pairs is not null")
    needed = tables.select("shard", F.posexplode("pairs").alias("place", "pair")).join(pair_counts(found), "pair")
    every = (
        tables.select("shard", F.lit(0).alias("kind"), "ends", "pair_of")
        .unionByName(needed.select("shard", F.lit(1).alias("kind"), "place", "total", "is_best"), allowMissingColumns=True)
        .unionByName(found.filter("pairs is null").select("shard", F.lit(2).alias("kind"), "doc_id", *SUMS, "groups_sha256", "chunks"), allowMissingColumns=True))
    return every.repartition("shard").sortWithinPartitions("shard", "kind", "place").mapInArrow(_scored, _RESULT)
