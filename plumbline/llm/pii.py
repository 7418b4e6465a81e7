"""Personal data in whole texts, disguised forms included, with spans in source characters.

A text goes through transducers that undo disguises. Each keeps, for every character it
puts out, the source characters it stands for, so that a span found in the normalised text
maps back to the source.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import fresh, picked

KINDS = ("email", "ip", "card", "phone")
Span = tuple[str, int, int]

_LOCAL = re.compile(r"[A-Za-z0-9._%+-]+")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_IP = re.compile(r"[0-9](?<![0-9][0-9])[0-9]*+\.([0-9]++)\.([0-9]++)\.([0-9]++)")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def _emails(text: str) -> Iterator[Span]:
    """As the pattern finds them from left to right; in linear time, by going from ``@`` to ``@``."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL_CHARS:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            yield "email", start, m.end()
        done = m.end() if m else at + 1
        at = text.find("@", done)


def base_spans(text: str) -> list[Span]:
    """Emails, addresses, cards and phones as written, in order of start, then kind."""
    found = list(_emails(text))
    for m in _CARD.finditer(text):
        digits = m.group().replace(" ", "").replace("-", "")
        if 14 <= len(digits) <= 19 and luhn(digits):
            found.append(("card", *m.span()))
    if "." in text:
        for m in _IP.finditer(text):
            if all(len(p.lstrip("0")) < 4 and int(p[-3:]) <= 255 for p in m.group().split(".")):
                found.append(("ip", *m.span()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 10 <= sum("0" <= c <= "9" for c in m.group()) <= 15:
                found.append(("phone", *m.span()))
    return sorted(found, key=_order)


def _order(span: Span) -> tuple[int, int]:
    return span[1], KINDS.index(span[0])


# Cyrillic and Greek letters that look like Latin ones; invisible characters.
_LIKE = dict(zip(
    "абвеԁһіјклмнорԛсѕтухԝАВСЕНІЈКМОРЅТХΑΒΕΖΗΙΚΜΝΟΡΤΥΧανορ",
    "a6bedhijkлмhopqcstyxwABCEHIJKMOPSTXABEZHIKMNOPTYXavop"))
_INVISIBLE = "­​‌‍⁠﻿"
# Digits in words by language.
_SPELLED = {w: str(i) for words in (
    "zero one two three four five six seven eight nine",
    "null eins zwei drei vier fünf sechs sieben acht neun",
    "zéro un deux trois quatre cinq six sept huit neuf",
    "cero uno dos tres cuatro cinco seis siete ocho nueve",
) for i, w in enumerate(words.split())} | {"oh": "0"}


def _look(c: str) -> str:
    """The plain form of one character: a look-alike, a compatibility form, or nothing for invisible ones."""
    if c in _LIKE:
        return _LIKE[c]
    if c in _INVISIBLE:
        return ""
    plain = unicodedata.normalize("NFKC", c)
    return plain if plain != c and plain.isascii() and plain.strip() else c


class Tape:
    """A text and, for each of its characters, the source characters it stands for."""

    def __init__(self, text: str, first: list[int] | None = None, end: list[int] | None = None):
        self.text = text
        self.first = list(range(len(text))) if first is None else first
        self.end = list(range(1, len(text) + 1)) if end is None else end

    def rewrite(self, edits: list[tuple[int, int, str]]) -> Tape:
        """Each (start, end, new) in order put in place; a new character stands for all it replaces."""
        if not edits:
            return self
        parts, first, end, at = [], [], [], 0
        for a, b, new in edits:
            parts += [self.text[at:a], new]
            first += self.first[at:a] + [self.first[a]] * len(new)
            end += self.end[at:a] + [self.end[b - 1]] * len(new)
            at = b
        return Tape("".join([*parts, self.text[at:]]), first + self.first[at:], end + self.end[at:])

    def source(self, start: int, end: int) -> tuple[int, int]:
        return self.first[start], self.end[end - 1]


def homoglyphs(tape: Tape) -> Tape:
    return tape.rewrite([(i, i + 1, new) for i, c in enumerate(tape.text) if not c.isascii() and (new := _look(c)) != c])


_NUMBER = "(?:" + "|".join(sorted(_SPELLED, key=len, reverse=True)) + "|[0-9]+)"
_DOTS = "dot|point|punkt|punto"
# numbers apart by blanks and the like, or by a word for a dot
_SPOKEN = re.compile(
    rf"(?<!\w)(?:(?:plus[\s-]++(?={_NUMBER}))?{_NUMBER}(?:(?:\s++(?:{_DOTS})\s++|(?:[\s,-]|\.(?=\s))++){_NUMBER})++)(?!\w)", re.IGNORECASE)
_WORD = re.compile(r"[^\W\d_]+|[0-9]+")


def spelled_digits(tape: Tape) -> Tape:
    """A run of at least two numbers, one of them in words, becomes a run of digits; ``plus`` before it a sign, ``dot`` in it a dot."""
    edits = []
    for m in _SPOKEN.finditer(tape.text):
        words = [w.group().lower() for w in _WORD.finditer(m.group())]
        if any(w in _SPELLED for w in words):
            for w in _WORD.finditer(tape.text, *m.span()):
                word = w.group().lower()
                new = "+" if word == "plus" else "." if word in _DOTS.split("|") else _SPELLED.get(word, word)
                edits.append((w.start(), w.end(), new))
    # what separates two numbers of a run goes
    closed, last = [], None
    for a, b, new in edits:
        if last is not None and a > last and re.fullmatch(r"[\s,.-]+", tape.text[last:a]):
            closed.append((last, a, ""))
        closed.append((a, b, new))
        last = b
    return tape.rewrite(closed)


# Words for the at sign that are hardly ever anything else; ends of hosts that make ``point`` a dot after ``at``.
_ATS = "arroba|arobase|arobas|klammeraffe|ät"
_ENDS = frozenset("com net org edu gov info fr eu uk ch".split())
_BRACKETED = re.compile(rf"[\[({{<]\s*+(at|@|{_ATS}|\.|{_DOTS})\s*+[\])}}>]", re.IGNORECASE)
_WORDED = re.compile(rf"\s(?:{_DOTS}|{_ATS})\s", re.IGNORECASE)
# a name whole with all its dots in words, so that no search begins inside one
_BARE = re.compile(
    rf"(?P<name>[A-Za-z0-9._%+-]++(?:\s++(?i:{_DOTS})\s++[A-Za-z0-9._%+-]++)*+)"
    rf"(?:(?P<at>@|\s++(?i:at|{_ATS})\s++)(?P<host>[A-Za-z0-9-]++(?:(?:\s++(?i:{_DOTS})\s++|\.)[A-Za-z0-9-]++)++))?+")
_DOT = re.compile(rf"(?<!\s)\s++({_DOTS})\s++", re.IGNORECASE)
_HOST_DOT = re.compile(rf"(?<!\s)\s++({_DOTS})\s++|\.", re.IGNORECASE)
_DIGIT_DOT = re.compile(rf"(?<=[0-9])\s++(?:{_DOTS})\s++(?=[0-9])", re.IGNORECASE)


def _bracketed(text: str) -> Iterator[tuple[int, int, str]]:
    """Each bracketed sign with the blanks around it."""
    done = 0
    for m in _BRACKETED.finditer(text):
        a, b = m.span()
        while a > done and text[a - 1].isspace():
            a -= 1
        while b < len(text) and text[b].isspace():
            b += 1
        done = b
        yield a, b, "." if m[1] == "." or m[1].lower() in _DOTS.split("|") else "@"


def _address(text: str, m: re.Match[str]) -> list[tuple[int, int, str]]:
    """What makes a name, a sign and a host an address, or nothing where they may be plain words."""
    sign = m["at"].strip().lower()
    name = [(*d.span(), d[1].lower()) for d in _DOT.finditer(text, *m.span("name"))]
    host = [(*d.span(), (d[1] or ".").lower()) for d in _HOST_DOT.finditer(text, *m.span("host"))]
    end = m.end()
    if sign in ("at", "@"):  # "at some point in": the word stands for a dot only before an end that is no word
        if text[host[-1][1]:end].lower() not in _ENDS:
            plain = next((k for k, d in enumerate(host) if d[2] == "point"), len(host))
            end = host[plain][0] if plain < len(host) else end
            host = host[:plain]
        if all(d[2] != "point" for d in host):
            last = max((k for k, d in enumerate(name) if d[2] == "point"), default=-1)
            name = name[last + 1:]
    while host and not ((last := text[host[-1][1]:end]).isalpha() and len(last) > 1):
        end = host.pop()[0]
    worded = [d for d in host if d[2] != "."]
    if not host or sign == "at" and not name and not worded:
        return []
    at = [] if sign == "@" else [(*m.span("at"), "@")]
    return [*((a, b, ".") for a, b, _ in name), *at, *((a, b, ".") for a, b, _ in worded)]


def at_and_dot(tape: Tape) -> Tape:
    """``[at]``, ``(dot)``, ``[.]`` and the like anywhere; bare words where they make up an address, or dots between digits."""
    tape = tape.rewrite(list(_bracketed(tape.text)))
    if not _WORDED.search(tape.text):
        return tape
    tape = tape.rewrite([(*m.span(), ".") for m in _DIGIT_DOT.finditer(tape.text)])
    return tape.rewrite([e for m in _BARE.finditer(tape.text) if m["at"] for e in _address(tape.text, m)])


def _is_odd(text: str) -> bool:
    try:
        text.encode("latin-1")
        return "\u00ad" in text
    except UnicodeEncodeError:
        return True


def disguises(text: str) -> list[Callable[[Tape], Tape]]:
    """The transducers that may change ``text``, in the order in which they run; each is told by its own pattern."""
    odd = _is_odd(text)
    steps: list[Callable[[Tape], Tape]] = [homoglyphs] if odd else []
    if odd or _SPOKEN.search(text):
        steps.append(spelled_digits)
    if odd or _WORDED.search(text) or _BRACKETED.search(text):
        steps.append(at_and_dot)
    return steps


def all_spans(text: str, base: list[Span] | None = None) -> list[Span]:
    """The base spans, and those of disguised identifiers that don't lie inside a base span of their kind."""
    base = base_spans(text) if base is None else base
    steps = disguises(text)
    if not steps:
        return base
    tape = Tape(text)
    for step in steps:
        tape = step(tape)
    if tape.text == text:
        return base
    added, waiting = [], {k: [s for s in base if s[0] == k][::-1] for k in KINDS}
    for kind, start, end in base_spans(tape.text):
        a, b = tape.source(start, end)
        same = waiting[kind]  # those of a kind don't overlap, so the next that ends behind a is the only one that can hold it
        while same and same[-1][2] <= a:
            same.pop()
        if not (same and same[-1][1] <= a and b <= same[-1][2]):
            added.append((kind, a, b))
    return sorted([*base, *added], key=_order)


def joined(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def redact(text: str, spans: list[Span]) -> str:
    """Each span replaced by its kind in angle brackets; what overlaps is replaced once, by the first kind."""
    parts, at, upto = [], 0, -1
    for kind, a, b in spans:
        if a >= upto:
            parts += [text[at:a], f"<{kind.upper()}>"]
        at = upto = max(upto, b)
    return "".join([*parts, text[at:]])


def find(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, base, spans): arrays of (kind, first, end) in code points for each row.

    Null and empty texts have no spans; repeated rows each give a row; an id may be null.
    """
    kind = pa.list_(pa.struct([("kind", pa.string()), ("first", pa.int64()), ("end", pa.int64())]))
    names = ["kind", "first", "end"]

    @F.arrow_udf("struct<base:array<struct<kind:string,first:bigint,end:bigint>>,spans:array<struct<kind:string,first:bigint,end:bigint>>>")
    def spans_of(texts: pa.Array) -> pa.Array:
        base = [base_spans(t) if t else [] for t in (x.as_py() for x in texts)]
        full = [all_spans(t.as_py(), b) if t.is_valid else [] for t, b in zip(texts, base)]
        return pa.StructArray.from_arrays(
            [pa.array([[dict(zip(names, s)) for s in row] for row in rows], kind) for rows in (base, full)], ["base", "spans"])

    found = picked(docs, doc_id=doc_id, text=text).select("doc_id", spans_of("text").alias("f"))
    return found.select("doc_id", "f.base", "f.spans")


def digests(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, counts of base spans by kind, sha256 of the joined base spans, all spans joined, n_added."""
    found = find(docs, doc_id, text)
    line = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", s.kind, s.first, s.end)), ",")
    count = lambda k: F.size(F.filter("base", lambda s: s.kind == k)).cast("bigint").alias(f"n_{k}")
    return found.select(
        "doc_id", *[count(k) for k in KINDS], F.sha2(line(F.col("base")).cast("binary"), 256).alias("base_sha256"),
        line(F.col("spans")).alias("spans"), (F.size("spans") - F.size("base")).cast("bigint").alias("n_added"))


def redacted(docs: DataFrame, text: str = "text", n_chars: str = "n_chars") -> DataFrame:
    """``docs`` with every span of personal data replaced by its kind; ``n_chars``, if there, counts anew. Null stays null."""

    @F.arrow_udf("string")
    def clean(texts: pa.Array) -> pa.Array:
        out = []
        for x in texts:
            t = x.as_py()
            spans = all_spans(t) if t else []
            out.append(redact(t, spans) if spans else t)
        return pa.array(out, pa.string())

    name = fresh(docs, "clean")
    cleaned = docs.withColumn(name, clean.asNondeterministic()(F.col(f"`{text}`")))
    return cleaned.select(*[
        F.col(f"`{name}`").alias(text) if c == text
        else F.char_length(f"`{name}`").cast(docs.schema[c].dataType).alias(c) if c == n_chars and text in docs.columns
        else F.col(f"`{c}`") for c in docs.columns])
