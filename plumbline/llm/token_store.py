"""Token ids in ORC: range-partitioned by document id, one sorted run a file, read by stripes."""

from __future__ import annotations

import os
import re
import struct
import unicodedata
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.llm.common import picked, slices, text_bytes
from plumbline.session import scratch_path

#: Written file format: rows to an index entry and bytes to a stripe.
INDEX_ROWS, STRIPE_BYTES = 1000, 16 << 20
#: Chunks of text whose ids a task remembers, and as many older ones.
REMEMBERED = 300_000

STORED = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("part", T.IntegerType()), T.StructField("local_start", T.LongType()),
    T.StructField("n_tokens", T.LongType()), T.StructField("ids", T.ArrayType(T.IntegerType()))])

_LETTERS = re.compile("[a-zß-öø-ÿ]+")
_CLOSED = re.compile("([a-zß-öø-ÿ]+)([!-&(-/:;=?@[-`{-~]+)")  # no apostrophe, no angle bracket


def _packed(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


class ChunkEncoder:
    """Ids of whole texts by a tokenizer that drops white space, remembered by chunk.

    The tokenizer's words never reach across a blank or a line feed, and its normaliser works
    inside them, so a text's ids are those of its chunks in order. The end of a sentence is
    split off by the same rule: letters and other characters are different words. A chunk of
    small letters is one word, so it goes to the merges at once, as byte-level letters.
    Special tokens are found in the raw text, before it is lower-cased, so a text that holds
    one in any casing goes to the tokenizer whole.
    """

    def __init__(self, path: str, remembered: int = REMEMBERED):
        from tokenizers import Tokenizer

        self.tokenizer, self.remembered = Tokenizer.from_file(path), remembered
        self.tokenize = self.tokenizer.model.tokenize
        self.known: dict[str, bytes] = {"": b""}
        self.older: dict[str, bytes] = {}
        # bytes as letters, by the byte-level rule: printable ones stand for themselves, others follow 255
        plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
        others = iter(range(256, 512))
        self.special = [t.content.lower() for t in self.tokenizer.get_added_tokens_decoder().values()]
        # what all special tokens begin with, as far as casing doesn't touch it: few texts have it
        self.sign = re.match(r"[!-@\[-`{-~]*", os.path.commonprefix(self.special))[0]
        self.letters = {b: chr(b if b in plain else next(others)) for b in range(256)}

    def _word(self, word: str) -> bytes:
        found = self.known.get(word) or self.older.get(word)
        if found is None:
            level = word if word.isascii() else "".join(map(self.letters.__getitem__, word.encode()))
            found = _packed([t.id for t in self.tokenize(level)])
        self.known[word] = found
        return found

    def _chunk(self, chunk: str) -> bytes:
        """The ids of a chunk that isn't among the newer ones."""
        found = self.older.get(chunk)
        if found is None:
            if _LETTERS.fullmatch(chunk):
                return self._word(chunk)
            m = _CLOSED.fullmatch(chunk)
            if m:
                found = self._word(m[1]) + (self.known.get(m[2]) or self._chunk(m[2]))
            else:
                found = _packed(self.tokenizer.encode(chunk, add_special_tokens=False).ids)
        self.known[chunk] = found
        return found

    def encode(self, text: str) -> bytes:
        """Little-endian unsigned 32-bit ids of a text."""
        if self.special and self.sign in text and any(t in text.lower() for t in self.special):
            return _packed(self.tokenizer.encode(text, add_special_tokens=False).ids)
        # lower case comes first where that commutes with the tokenizer's own steps
        if text.isascii() or ("Σ" not in text and "İ" not in text and unicodedata.is_normalized("NFC", text)):
            text = text.lower()
        chunks = text.replace("\n", " ").split(" ")
        ids = list(map(self.known.get, chunks))
        if None in ids:
            known = self.known
            i = ids.index(None)
            for _ in range(ids.count(None)):
                i = ids.index(None, i)
                ids[i] = known.get(chunks[i]) or self._chunk(chunks[i])
            if len(known) > self.remembered:  # what was not used since the last time goes
                self.known, self.older = {"": b""}, known
        return b"".join(ids)


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def write(docs: DataFrame, path: str, tokenizer: str, doc_id: str = "doc_id", text: str = "text", end_id: int = 2, partitions: int | None = None) -> None:
    """Encode every whole text, append ``end_id``, and write ORC in ascending order of id.

    Texts are range-partitioned by id before they are encoded, so each task writes one sorted
    file. Ids are integers in ORC's run-length encoding; each file has row indexes and a Bloom
    filter on doc_id, and its stripes hold their smallest and largest doc_id. A null text is
    empty; null ids come first; rows with the same id follow in order of their text's digest.
    """
    rows = picked(docs, doc_id=doc_id, text=text).withColumn("tie", F.xxhash64("text"))
    keys = [F.col("doc_id"), F.col("tie")]
    dealt = rows.repartitionByRange(partitions, *keys) if partitions else rows.repartitionByRange(*keys)
    ordered = dealt.sortWithinPartitions(*keys).select("doc_id", "text")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encoder, part, at = ChunkEncoder(tokenizer), TaskContext.get().partitionId(), 0
        tail = np.array([end_id], "<u4").tobytes()
        for batch in batches:
            texts = batch.column("text").fill_null("")
            for a, b in slices(text_bytes(texts)):
                ids = [encoder.encode(x) + tail for x in texts[a:b].to_pylist()]
                ends = np.cumsum([0] + [len(x) // 4 for x in ids])
                lists = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(np.frombuffer(b"".join(ids), "<u4").view(np.int32)))
                yield pa.RecordBatch.from_arrays([
                    batch.column("doc_id")[a:b], pa.array(np.full(b - a, part, np.int32)), pa.array(ends[:-1] + at), pa.array(np.diff(ends)), lists], STORED.names)
                at += int(ends[-1])

    (ordered.mapInArrow(encode, STORED).write.option("orc.bloom.filter.columns", "doc_id").option("orc.create.index", "true")
     .option("orc.row.index.stride", INDEX_ROWS).option("orc.stripe.size", STRIPE_BYTES).orc(path))


def read(spark: SparkSession, path: str, low: int | None = None, high: int | None = None, ids: list[int] | None = None) -> DataFrame:
    """Stored rows with their place ``start`` in the ids of all documents, stripes read in parallel.

    ``low``, ``high`` and ``ids`` choose documents; they reach the scan, which skips files, stripes
    and row groups by their statistics and Bloom filters.
    """
    stored = spark.read.schema(STORED).orc(path)
    # one row for each written file
    totals = stored.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    before = F.coalesce(F.sum("n").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    firsts = totals.select("part", before.alias("first"))
    for test in ([F.col("doc_id") >= low] if low is not None else []) + ([F.col("doc_id") <= high] if high is not None else []) + ([F.col("doc_id").isin(ids)] if ids is not None else []):
        stored = stored.filter(test)
    # a file's number and offset: as many rows as tasks wrote
    return stored.join(F.broadcast(firsts), "part").withColumn("start", F.col("first") + F.col("local_start")).select(
        "doc_id", "start", "n_tokens", "ids")


def digests(stored: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and the crc32 of each document's ids as little-endian 32-bit integers."""
    @F.arrow_udf("bigint")
    def crc(ids: pa.Array) -> pa.Array:
        at, flat = ids.offsets.to_numpy(), ids.values.to_numpy(zero_copy_only=False).astype("<u4", copy=False)
        return pa.array([zlib.crc32(flat[a:b]) for a, b in zip(at[:-1], at[1:])], pa.int64())

    return stored.select("doc_id", "start", "n_tokens", crc("ids").alias("ids_crc32"))


def round_trip(docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """Write the ids of ``docs`` into the shared folder and read their digests back."""
    spark = docs.sparkSession
    path = scratch_path(spark, "tokens")
    write(docs, path, tokenizer or tokenizer_path())
    return digests(read(spark, path))
