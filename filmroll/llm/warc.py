"""WARC archives: a writer with revisit records, and a splittable reader of gzip members.

Writing: every record is one gzip member. Of records with equal payloads of at least `least` bytes, the one with
the smallest id is the response and the others are revisits that refer to it; which is which is decided by a
shuffle of digests alone. Each task streams its records into archives of about `archive_bytes`, under names of its
own, so a task that runs again writes other files; only the files that finished tasks report are archives, and
that list is itself a stored table.

Reading: archives are cut into byte ranges of `split` bytes, dealt over the cluster. A task scans its range for
the gzip magic, and validates each candidate by decoding it: a member whose content starts as a WARC record
does, up to the end of its headers. From the first such member it goes from member to member, checking each one's
length and CRC, and owns the records that start inside its range, however far the last one reaches beyond. A magic that
occurs by chance inside compressed data doesn't decode to a record's headers and is passed over. A record that fails its
check after its headers were valid is an error, not skipped.

Defined cases: a null payload is empty; an empty payload is a record without content; repeated rows each get a
record; a null id is no id: it is written as such, read back as null, and counts as larger than any other; a payload may be as long as a row; an empty table gives no
archives and no records; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from filmroll.llm.common import stored
from filmroll.session import attach, shared_path

ARCHIVE_BYTES = 1 << 30
SPLIT = 32 << 20
#: Most reading tasks for each core: more ranges than that share tasks with their neighbours.
ROUNDS = 16
#: Bytes read at a time, and those read and decoded at a time to validate a candidate.
CHUNK = 1 << 20
HEAD = 64 << 10
LEVEL = 6
MAGIC = b"\x1f\x8b\x08"
VERSION = b"WARC/1."
#: Records carry no time of their own here, so that equal input makes equal records.
DATE = "1970-01-01T00:00:00Z"


def plan(pages: DataFrame, least: int = 0) -> DataFrame:
    """page_id, url, payload, digest, record_type, refers_to of every row: which records are responses."""
    rows = pages.select(F.col("page_id").cast("bigint").alias("page_id"), F.coalesce(F.col("url").cast("string"), F.lit("")).alias("url"),
                        F.coalesce("html", F.lit("")).alias("html"))
    rows = rows.withColumn("digest", F.unhex(F.sha1(F.encode("html", "UTF-8"))))
    thin = rows.select("page_id", "digest", F.octet_length("html").alias("n"))
    first = F.min(F.struct(F.col("page_id").isNull().alias("unknown"), F.col("page_id"))).alias("first")
    groups = (thin.where(F.col("n") >= least).groupBy("digest").agg(first, F.count("*").alias("copies"))
              .where("copies > 1").select("digest", F.col("first.page_id").alias("first"), F.lit(True).alias("shared")))
    return attach(rows, groups, ["digest"], "left", label="shared").select(
        "page_id", "url", "html", "digest",
        F.when(F.col("shared") & ~F.col("page_id").eqNullSafe(F.col("first")), "revisit").otherwise("response").alias("record_type"),
        F.when(F.col("shared") & ~F.col("page_id").eqNullSafe(F.col("first")), F.col("first")).alias("refers_to"))


def _line(text: str) -> str:
    return " ".join(text.split())


def record(page_id: int | None, url: str, payload: bytes, digest: str, kind: str, refers_to: int | None) -> bytes:
    """One WARC record: headers, an HTTP block (without its payload in a revisit), two line ends."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + (payload if kind == "response" else b"")
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>", f"WARC-Date: {DATE}",
            f"WARC-Target-URI: {_line(url)}", f"WARC-Payload-Digest: sha1:{digest}"]
    if kind == "revisit":
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _open(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(_uri(uri))


def _write(folder: str, archive_bytes: int):
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = _open(folder)
        out, path, done = None, "", []
        size = records = 0
        for b in batches:
            for p, url, html, digest, kind, ref in zip(*(b.column(c) for c in ("page_id", "url", "html", "digest", "record_type", "refers_to"))):
                if out is None:
                    path, size, records = f"{base}/{uuid.uuid4().hex}.warc.gz", 0, 0
                    out = fs.open_output_stream(path, compression=None)
                c = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
                r = record(p.as_py(), url.as_py(), html.as_py().encode(), base64.b32encode(digest.as_py()).decode(), kind.as_py(), ref.as_py())
                member = c.compress(r) + c.flush()
                out.write(member)
                size, records = size + len(member), records + 1
                if size >= archive_bytes:
                    out.close()
                    done, out = [*done, (path, size, records)], None
        if out is not None:
            out.close()
            done.append((path, size, records))
        scheme = folder.split(":", 1)[0] + "://" if "://" in folder else ""
        if done:
            yield pa.RecordBatch.from_arrays([pa.array([scheme + d[0] for d in done]), pa.array([d[1] for d in done], pa.int64()), pa.array([d[2] for d in done], pa.int64())],
                                             ["path", "length", "records"])
    return task


def write(planned: DataFrame, folder: str | None = None, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Writes the records of `plan()`; returns the archives: path, length, records."""
    spark = planned.sparkSession
    folder = _uri(folder or shared_path(spark, "warc"))
    fs, base = _open(folder)
    fs.create_dir(base, recursive=True)
    return stored(planned.mapInArrow(_write(folder, archive_bytes), "path string, length bigint, records bigint"), "archives")


def _uri(path: str) -> str:
    """`file:/a` and `file:///a` are one place; the first isn't understood everywhere."""
    return "file://" + path.removeprefix("file:") if path.startswith("file:/") and not path.startswith("file://") else path


def _headers(head: bytes) -> dict[str, str]:
    found = {}
    for line in head.decode("utf-8", "replace").split("\r\n")[1:]:
        name, _, value = line.partition(":")
        found[name.strip().lower()] = value.strip()
    return found


def _valid(file, length: int, at: int) -> bool:
    """Does a gzip member start at `at` whose content starts with a record's headers? They may be of any length."""
    d, held, start, tail = zlib.decompressobj(31), b"", b"", b""
    try:
        while not d.eof:
            if not held and at < length:
                file.seek(at)
                held = file.read(min(HEAD, length - at))
                at += len(held)
            out, over = d.decompress(held, HEAD), not held
            held = d.unconsumed_tail
            start += out[:len(VERSION) - len(start)]
            if start != VERSION[:len(start)]:
                return False
            if b"\r\n\r\n" in tail + out:
                return True
            if over and not out:
                return False
            tail = (tail + out)[-3:]
    except zlib.error:
        pass
    return False


def first_record(file, length: int, start: int, stop: int) -> int | None:
    """Offset of the first record that starts in [start, stop)."""
    at = start
    while at < stop:
        file.seek(at)
        data = file.read(min(CHUNK, length - at))
        near = data.find(MAGIC)
        while near >= 0 and at + near < stop:
            if _valid(file, length, at + near):
                return at + near
            near = data.find(MAGIC, near + 1)
        if at + len(data) >= length:
            return None
        at += max(1, len(data) - len(MAGIC) + 1)
    return None


def members(file, length: int, start: int, stop: int) -> Iterator[tuple[int, bytes]]:
    """Offset and content of every record that starts in [start, stop)."""
    at = first_record(file, length, start, stop)
    if at is None:
        return
    held, read = b"", at
    while at < stop and at < length:
        d, out = zlib.decompressobj(31), []
        begun = read - len(held)
        while not d.eof:
            if not held:
                if read >= length:
                    raise ValueError(f"the record at {at} is cut short")
                file.seek(read)
                held = file.read(min(CHUNK, length - read))
                read += len(held)
            out.append(d.decompress(held))
            held = d.unused_data
        content = b"".join(out)
        if not content.startswith(VERSION):
            raise ValueError(f"no record at {begun}")
        yield begun, content
        at = read - len(held)


def parse(content: bytes) -> dict:
    """A record's fields; the payload of a response is checked against its digest."""
    head, _, rest = content.partition(b"\r\n\r\n")
    headers = _headers(head)
    size = int(headers["content-length"])
    if len(rest) < size:
        raise ValueError(f"record {headers.get('warc-record-id')} is shorter than its length")
    http, _, payload = rest[:size].partition(b"\r\n\r\n")
    kind, digest = headers["warc-type"], headers.get("warc-payload-digest", "").removeprefix("sha1:")
    if kind == "response" and digest and base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest:
        raise ValueError(f"record {headers.get('warc-record-id')} differs from its digest")
    return {"record_id": headers.get("warc-record-id"), "record_type": kind, "target_uri": headers.get("warc-target-uri"),
            "payload_digest": digest, "refers_to": headers.get("warc-refers-to"),
            "payload_bytes": len(payload) if kind == "response" else int(_headers(http).get("content-length", 0)),
            "payload": payload if kind == "response" else None}


_FIELDS = ["path", "start", "record_id", "record_type", "target_uri", "payload_digest", "refers_to", "payload_bytes"]
_SCHEMA = "path string, start bigint, record_id string, record_type string, target_uri string, payload_digest string, refers_to string, payload_bytes bigint"


def _read(payload: bool, batch_bytes: int = 8 << 20):
    fields = [*_FIELDS, "payload"] if payload else _FIELDS
    kinds = {"start": pa.int64(), "payload_bytes": pa.int64(), "payload": pa.binary()}

    def out(rows):
        return pa.RecordBatch.from_arrays([pa.array([r[f] for r in rows], kinds.get(f, pa.string())) for f in fields], fields)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, length, start, stop in zip(*(b.column(c).to_pylist() for c in ("path", "length", "start", "stop"))):
                fs, name = _open(path)
                rows, held = [], 0
                with fs.open_input_file(name) as file:
                    for at, content in members(file, length, start, stop):
                        rows.append(parse(content) | {"path": path, "start": at})
                        held += len(content) if payload else 256
                        if held > batch_bytes:
                            yield out(rows)
                            rows, held = [], 0
                if rows:
                    yield out(rows)
    return task


def archives(spark: SparkSession, pattern: str) -> DataFrame:
    """path, length of the archives that a path or pattern names; their bytes are not read."""
    return spark.read.format("binaryFile").load(pattern).select("path", "length")


def read(archive: DataFrame, split: int = SPLIT, payload: bool = True) -> DataFrame:
    """Every record of the archives (path, length): where it is, its fields and, if asked for, its payload. Rows of ranges are
    tiny, so the number of tasks is set by the ranges, of which one task gets neighbours when there are very many."""
    count = archive.agg(F.sum(F.ceil(F.col("length") / split))).first()[0] or 1
    ranges = (archive.where("length > 0").select("path", "length", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("length") - 1, F.lit(split).cast("bigint"))).alias("start"))
              .select("path", "length", "start", F.least(F.col("start") + split, "length").alias("stop")))
    return ranges.repartitionByRange(min(int(count), ROUNDS * archive.sparkSession.sparkContext.defaultParallelism), "path", "start").mapInArrow(_read(payload), _SCHEMA + (", payload binary" if payload else ""))


ORACLE = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, strlen(html)::BIGINT AS payload_bytes, sha1(html) AS h FROM p),
w AS (SELECT *, count(*) OVER (PARTITION BY h) AS copies, min(page_id) OVER (PARTITION BY h) AS first FROM d)
SELECT page_id, payload_bytes,
    array_to_string(list_transform(range(32), lambda i: 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'[
        1 + ((('0x' || substr(h || '00', (i * 5) // 4 + 1, 3))::BIGINT >> (7 - (i * 5) % 4)) & 31)::INT]), '') AS payload_digest,
    CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
    CASE WHEN page_id <> first THEN first END AS refers_to FROM w"""


def digests(records: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of records that `write` wrote."""
    number = lambda c: F.regexp_extract(F.col(c), "^<urn:page:(-?[0-9]*)>$", 1)
    known = lambda c: F.when(number(c) != "", number(c).cast("bigint"))
    return records.select(known("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", known("refers_to").alias("refers_to"))
