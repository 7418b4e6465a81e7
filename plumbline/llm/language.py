"""Language identification by compression against per-language zstandard dictionaries."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import fresh, picked
from plumbline.operators.spread import top_per_group

#: Bounds of the training sample: documents and characters of each, so a language gets a dictionary of up to 128 kB.
SAMPLE_DOCS, SAMPLE_CHARS = 64, 2000
#: Texts are compressed in pieces, so that the dictionary counts for all of a long text.
PIECE = 4096
LEVEL = 5
#: Least share by which the best size must lie below the second for the text to be accepted.
MARGIN = 0.005

_ASCII = re.compile("[A-Za-z]")
_BLANK = bytes(b if b > 127 or chr(b).isalpha() else 32 for b in range(256))


def held_out(doc_id: str = "doc_id"):
    """crc32 of the id as text leaves 2 on division by 4; false for a null id."""
    return F.coalesce(F.crc32(F.col(f"`{doc_id}`").cast("string")) % 4 == 2, F.lit(False))


def has_letter(text: str) -> bool:
    return bool(_ASCII.search(text)) or any(map(str.isalpha, text))


def _plain(text: str) -> bytes:
    """Lower case, ASCII other than letters blank, runs of blanks as one."""
    return b" ".join(text.lower().encode("utf-8", "replace").translate(_BLANK).split())


def train(docs: DataFrame, text: str = "text", lang: str = "lang", doc_id: str = "doc_id",
          sample_docs: int = SAMPLE_DOCS, sample_chars: int = SAMPLE_CHARS) -> dict[str, bytes]:
    """Raw-content dictionaries by language, from a bounded sample of the rows that are not held out.

    Sampled are the ``sample_docs`` ids of each language that are first by hash; each gives ``sample_chars`` characters
    of one text, the first by digest if rows share the id. So no more than that comes to the driver, however often an id
    occurs. Rows with a null id, text or language teach nothing.
    """
    ids = picked(docs, doc_id=doc_id, lang=lang, filled=text).select(
        "doc_id", "lang", (F.length("filled") > 0).alias("filled"))
    ids = ids.filter(F.col("doc_id").isNotNull() & F.col("lang").isNotNull() & F.col("filled") & ~held_out()).select("doc_id", "lang").distinct()
    chosen = top_per_group(ids, ["lang"], [F.xxhash64("doc_id"), F.col("doc_id")], sample_docs)
    rows = picked(docs, doc_id=doc_id, lang=lang, text=text).filter("length(text) > 0").join(
        F.broadcast(chosen), ["doc_id", "lang"], "left_semi")  # sample_docs rows a language at most
    start = F.substring("text", 1, sample_chars)
    parts = rows.groupBy("lang", "doc_id").agg(F.min(F.struct(F.xxhash64("text").alias("h"), start.alias("text"))).alias("x")).select("lang", "doc_id", "x.text")
    out: dict[str, list[bytes]] = {}
    for r in sorted(parts.collect(), key=lambda r: (r.lang, r.doc_id)):
        out.setdefault(r.lang, []).append(_plain(r.text))
    # a raw dictionary of under eight bytes is none
    return {k: b" ".join(v) + b" " * 8 for k, v in out.items()}


class Classifier:
    """Sizes of a text under each language's dictionary."""

    def __init__(self, dictionaries: dict[str, bytes], level: int = LEVEL, piece: int = PIECE):
        self.piece, self.langs, self.packers = piece, sorted(dictionaries), []
        for lang in self.langs:
            data = zstandard.ZstdCompressionDict(dictionaries[lang], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            data.precompute_compress(level=level)
            self.packers.append(zstandard.ZstdCompressor(
                level=level, dict_data=data, write_checksum=False, write_content_size=False, write_dict_id=False))

    def sizes(self, text: str) -> list[int]:
        data = _plain(text)
        pieces = [data[i:i + self.piece] for i in range(0, len(data), self.piece)] or [b""]
        return [sum(len(c.compress(p)) for p in pieces) for c in self.packers]

    def predict(self, text: str | None) -> tuple[str, float]:
        """The language with the least size, and the share by which that lies below the second."""
        if not text or not self.langs or not has_letter(text):
            return "und", 0.0
        ranked = sorted(zip(self.sizes(text), self.langs))
        if len(ranked) == 1:
            return ranked[0][1], 1.0
        return ranked[0][1], 1.0 - ranked[0][0] / ranked[1][0]


def predict(docs: DataFrame, dictionaries: dict[str, bytes], text: str = "text", margin: float = MARGIN) -> DataFrame:
    """``docs`` with a struct ``language`` (lang_pred, score, accepted).

    The text alone decides. Null, empty and letterless texts get ``und``, score 0 and are not
    accepted; ties go to the language that is first by name; a score below ``margin`` is not
    accepted. With no dictionary every text gets ``und``; with one, score 1. If ``docs`` has a
    column ``language``, the new one is called ``_language``.
    """
    kind = pa.struct([("lang_pred", pa.string()), ("score", pa.float64()), ("accepted", pa.bool_())])

    @F.arrow_udf("lang_pred string, score double, accepted boolean")
    def judge(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        model = Classifier(dictionaries)
        for texts in batches:
            found = [model.predict(t.as_py()) for t in texts]
            yield pa.array([(p, s, p != "und" and s >= margin) for p, s in found], kind)

    return docs.withColumn(fresh(docs, "language"), judge.asNondeterministic()(F.col(f"`{text}`")))


def accepted(docs: DataFrame, text: str = "text", lang: str = "lang", doc_id: str = "doc_id", margin: float = MARGIN) -> DataFrame:
    """The rows whose language is told by a clear margin, columns unchanged."""
    judged = predict(docs, train(docs, text, lang, doc_id), text, margin)
    name = judged.columns[-1]
    return judged.filter(F.col(f"`{name}`.accepted")).drop(name)
