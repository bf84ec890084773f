import base64
import hashlib
import random

import pyarrow.fs as pafs
import pytest
from pyspark.sql import functions as F

from filmroll.llm import warc

SCHEMA = "page_id long, url string, html string, digest string, refers_to int"


def pages(spark, rows):
    return spark.createDataFrame([(i, u, h, "x", 1) for i, u, h in rows], SCHEMA)


def digest(html):
    return base64.b32encode(hashlib.sha1((html or "").encode()).digest()).decode()


def back(df, split):
    found = warc.read(df, split=split)
    return sorted((tuple(r) for r in warc.digests(found).collect()), key=str), {r.record_id: bytes(r.payload) for r in found.where("payload is not null").collect()}


def test_round_trip_at_any_split(spark):
    rnd = random.Random(5)
    rows = [(i, f"http://a/{i}\n", "".join(rnd.choice("abé<> \n") for _ in range(rnd.choice([0, 3, 400, 9000])))) for i in range(60)]
    rows += [(100 + i, None, rows[i][2]) for i in range(0, 20)] + [(200, "u", None), (201, "u", ""), (202, "u", "x" * 3_000_000)]
    first = {}
    for i, _, h in rows:
        first[h or ""] = min(i, first.get(h or "", i))
    want = sorted(((i, len((h or "").encode()), digest(h), "response" if first[h or ""] == i else "revisit",
                    None if first[h or ""] == i else first[h or ""]) for i, _, h in rows), key=str)
    archives = warc.write(warc.plan(pages(spark, rows)), archive_bytes=40_000)
    assert archives.count() > 1
    for split in (1, 300, 7_000, 1 << 25) if archives.agg({"length": "sum"}).first()[0] < 300_000 else (300, 7_000, 1 << 25):
        got, payload = back(archives, split)
        assert got == want
    assert all(payload[f"<urn:page:{i}>"] == (h or "").encode() for i, _, h in rows if first[h or ""] == i)


def test_ranges_are_read_by_many_tasks(spark):
    """Adaptive plans would merge rows as small as ranges into one task."""
    rows = [(i, "u", "".join(chr(97 + (i * j) % 26) for j in range(2000))) for i in range(400)]
    archives = warc.write(warc.plan(pages(spark, rows)), archive_bytes=20_000)
    total = archives.agg({"length": "sum"}).first()[0]
    for ranges in (5, 40):
        found = warc.read(archives, split=total // ranges)
        tasks = found.select(F.spark_partition_id().alias("task")).distinct().count()
        assert tasks >= min(ranges, spark.sparkContext.defaultParallelism)
        assert found.count() == 400


def test_magic_inside_a_record_is_not_a_record(tmp_path):
    import zlib
    fake = b"\x1f\x8b\x08" * 50 + b"\x1f\x8b\x08\x00\x00\x00\x00\x00\x00\x03junk"
    parts, at, offsets = [], 0, []
    for i in range(20):
        body = warc.record(i, "u", fake * (i + 1), base64.b32encode(hashlib.sha1(fake * (i + 1)).digest()).decode(), "response", None)
        c = zlib.compressobj(0, zlib.DEFLATED, 31)  # stored, so the magic stands in the archive as it is
        parts.append(c.compress(body) + c.flush())
        offsets.append(at)
        at += len(parts[-1])
    path = tmp_path / "a.warc.gz"
    path.write_bytes(b"".join(parts))
    for split in (64, 1000, at):
        found = []
        with pafs.LocalFileSystem().open_input_file(str(path)) as f:
            for start in range(0, at, split):
                found += [o for o, _ in warc.members(f, at, start, min(at, start + split))]
        assert found == offsets


def test_headers_of_any_length(spark):
    rnd = random.Random(7)
    urls = {i: "http://a/" + "".join(rnd.choices("abcdefghijklmnopqrstuvwxyz0123456789-_", k=100_000)) for i in range(4)} | {9: "http://a/" + "a" * 3_000_000, 10: "http://b/"}
    archives = warc.write(warc.plan(pages(spark, [(i, u, f"page {i}") for i, u in urls.items()])))
    for split in (20_000, 70_000, 1 << 25):
        rows = warc.read(archives, split=split).collect()
        assert {r.record_id: r.target_uri for r in rows} == {f"<urn:page:{i}>": u for i, u in urls.items()} and len(rows) == len(urls)


def test_headers_cut_anywhere_between_reads(tmp_path, monkeypatch):
    import zlib
    monkeypatch.setattr(warc, "HEAD", 5)
    path = tmp_path / "a.warc.gz"
    for n in range(12):
        raw = b"".join(c.compress(warc.record(i, "u" * n, b"abc", "", "response", None)) + c.flush() for i in range(2) for c in [zlib.compressobj(6, zlib.DEFLATED, 31)])
        path.write_bytes(raw)
        with pafs.LocalFileSystem().open_input_file(str(path)) as f:
            assert sum(len(list(warc.members(f, len(raw), at, at + 1))) for at in range(len(raw))) == 2


def test_damage_is_an_error(tmp_path):
    import zlib
    c = zlib.compressobj(6, zlib.DEFLATED, 31)
    raw = c.compress(warc.record(1, "u", b"abc" * 500, "", "response", None)) + c.flush()
    path = tmp_path / "a.warc.gz"
    path.write_bytes(raw[:-4])
    with pafs.LocalFileSystem().open_input_file(str(path)) as f, pytest.raises(ValueError):
        list(warc.members(f, len(raw) - 4, 0, len(raw) - 4))


def test_ties_repeats_nulls_and_empty_tables(spark):
    rows = [(5, "a", "same"), (5, "a", "same"), (None, "b", "same"), (7, "c", "same"), (None, None, None)]
    got, _ = back(warc.write(warc.plan(pages(spark, rows))), 1 << 20)
    d = digest("same")
    assert got == sorted([(5, 4, d, "response", None), (5, 4, d, "response", None), (None, 4, d, "revisit", 5), (7, 4, d, "revisit", 5),
                          (None, 0, digest(""), "response", None)], key=str)
    empty = warc.write(warc.plan(pages(spark, [])))
    assert empty.count() == 0 and warc.read(empty).count() == 0


def test_least_leaves_small_payloads_alone(spark):
    got, _ = back(warc.write(warc.plan(pages(spark, [(1, "a", "abc"), (2, "a", "abc"), (3, "a", "long" * 9), (4, "a", "long" * 9)]), least=10)), 1 << 20)
    assert [(r[0], r[3], r[4]) for r in got] == [(1, "response", None), (2, "response", None), (3, "response", None), (4, "revisit", 3)]


def test_archives_are_listed_with_their_length(spark, tmp_path):
    archives = warc.write(warc.plan(pages(spark, [(1, "a", "abc")])), folder=str(tmp_path / "w"))
    listed = warc.archives(spark, str(tmp_path / "w") + "/*.warc.gz")
    assert [r.length for r in listed.collect()] == [r.length for r in archives.collect()]
    assert [r.page_id for r in warc.digests(warc.read(listed)).collect()] == [1]
