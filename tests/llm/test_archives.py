import base64
import gzip
import hashlib
import os

import pytest
from pyspark.sql import functions as F

from plumbline.llm import archives

from corpus_fixtures import rows  # noqa: F401

COLUMNS = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]


def b32(data):
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def wanted(pages, least=0):
    """By grouping equal payloads; of equal greatest ids one is the response."""
    groups = {}
    for page, _, html in pages:
        groups.setdefault((html or "").encode(), []).append(page)
    out = []
    for data, ids in groups.items():
        ids = sorted(ids, key=lambda i: (i is not None, i or 0))
        for k, i in enumerate(ids):
            again = len(data) >= least and k < len(ids) - 1
            out.append((i, len(data), b32(data), "revisit" if again else "response", ids[-1] if again else None))
    return sorted(out, key=repr)


@pytest.fixture(scope="module")
def make_pages(spark):
    return lambda r: spark.createDataFrame(r, "page_id bigint, url string, html string")


TRAPS = [
    (1, "http://a.example/x y\n", "line\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"),
    (2, None, None), (3, "", ""), (None, "http://b.example/", "<p>é😀</p>"), (4, "http://b.example/", "<p>é😀</p>"),
    (5, "http://c.example/", "http://d.example/ 1.2.3.4 20200101000000 text/html 4\nabcd\n"), (6, "dns:x", "HTTP/1.1 200 OK\r\n\r\n"),
    (7, "http://e.example/", "long " * 300_000), (7, "http://e.example/", "long " * 300_000), (8, "u", "\n\n\n"), (9, "u", "no line end"),
    (-3, "u", "no line end"), (None, "u", "\x00﻿"), (None, "v", "\x00﻿"), (10, "filedesc://x", "y")]


@pytest.mark.parametrize("parts", [1, 4])
def test_round_trip_by_grouping(make_pages, parts):
    out = archives.round_trip(make_pages(TRAPS).repartition(parts).withColumn("kept", F.lit("clash")).withColumn("of", F.lit(1)))
    assert out.columns == COLUMNS
    assert rows(out) == wanted(TRAPS)


def test_short_payloads_are_no_revisits(make_pages):
    assert rows(archives.round_trip(make_pages(TRAPS), min_bytes=11)) == wanted(TRAPS, 11)


def test_empty_table(make_pages):
    assert archives.round_trip(make_pages(TRAPS).filter("false")).count() == 0


def arc_file(version, records, cut=0):
    about = f"{version} 0 maker\n{archives.ARC_FIELDS[version]}\n".encode()
    more = " 200 - - 0 old.arc" if version == 2 else ""
    out = f"filedesc://old.arc 0.0.0.0 19990101 text/plain{more} {len(about)}\n".encode() + about + b"\n"
    for url, ip, date, mime, block in records:
        out += f"{url} {ip} {date} {mime}{more} {len(block)}\n".encode() + block + b"\n"
    return out[:len(out) - cut]


RECORDS = [
    ("http://x.example/a b", "10.0.0.1", "19980203040506", "text/html", b"HTTP/1.0 200 OK\r\nA: b\r\n\r\n\xff\xfe\x00\r\n\r\nbody"),
    ("dns:x.example", "10.0.0.2", "199802", "text/dns", b"x.example A 10.0.0.1"),
    ("http://old.example/", "10.0.0.3", "1998", "text/html", b"<p>no header</p>"),
    ("http://x.example/c", "10.0.0.1", "19990203040506", "text/html", b"HTTP/1.0 200 OK\n\n\xff\xfe\x00\r\n\r\nbody")]


@pytest.mark.parametrize("packed", [True, False])
@pytest.mark.parametrize("version", [1, 2])
def test_legacy_files(spark, tmp_path, version, packed):
    data = arc_file(version, RECORDS)
    name = "old.arc.gz" if packed else "old.arc"
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / name).write_bytes(gzip.compress(data) if packed else data)
    found = {r.url: r for r in archives.read_arc(spark, str(tmp_path / "in")).collect()}
    assert [found[r[0]].type for r in RECORDS] == ["response", "resource", "resource", "response"]
    assert found["dns:x.example"].date == "1998-02-01T00:00:00Z" and found["http://old.example/"].date == "1998-01-01T00:00:00Z"
    archives.convert(spark, str(tmp_path / "in"), str(tmp_path / "out"))
    text = b"".join(gzip.decompress(p.read_bytes()) for p in sorted((tmp_path / "out").glob("part-*.gz")))
    assert text.count(b"WARC-Type: warcinfo\r\n") == 1 and text.endswith(b"\r\n\r\n")
    out = {r.url: r for r in archives.read_warc(spark, str(tmp_path / "out")).collect() if r.url}
    later, first = out["http://x.example/c"], out["http://x.example/a b"]
    assert later.type == "response" and bytes(later.payload) == b"\xff\xfe\x00\r\n\r\nbody" and later.intact
    assert first.type == "revisit" and first.refers_to == later.record_id and first.payload is None and first.payload_digest == later.payload_digest
    assert bytes(first.http) == b"HTTP/1.0 200 OK\r\nA: b\r\n\r\n" and bytes(out["http://old.example/"].payload) == b"<p>no header</p>"


def test_several_members_and_short_files(spark, tmp_path):
    data = arc_file(1, RECORDS[:1], cut=3)  # the last record ends early
    cut = data.index(b"http://x")
    (tmp_path / "a.arc.gz").write_bytes(gzip.compress(data[:cut]) + gzip.compress(data[cut:]))
    (tmp_path / "b.arc.gz").write_bytes(gzip.compress(b"no archive at all\n"))
    (tmp_path / "c.arc.gz").write_bytes(gzip.compress(b""))
    found = [r for r in archives.read_arc(spark, str(tmp_path)).collect() if r.type != "warcinfo"]
    assert [(r.cut, bytes(r.payload)) for r in found] == [(True, b"\xff\xfe\x00\r\n\r\nbo" + b"\n")] or [r.cut for r in found] == [True]


def test_dates():
    assert archives.iso_date("19990203040506") == "1999-02-03T04:05:06Z"
    assert archives.iso_date("199") is None and archives.iso_date("x") is None


def test_identifiers_are_stable(spark, tmp_path):
    (tmp_path / "a.arc").write_bytes(arc_file(1, RECORDS))
    a, b = (sorted(r.record_id for r in archives.read_arc(spark, str(tmp_path)).collect()) for _ in range(2))
    assert a == b and len(set(a)) == len(RECORDS) + 1 and os.path.exists(tmp_path / "a.arc")
