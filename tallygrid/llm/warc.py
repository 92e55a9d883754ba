"""WARC archives, written with a gzip member for each record and read back in byte ranges.

A reader's task has a range of a file's bytes: it looks for gzip's magic, takes a place for a record only if what is
inflated there begins with a WARC header that can be parsed, and owns the records that start in its range; it reads on
beyond the range's end for the last of them. From one record the next follows without a search. A payload may hold
members of its own, though (an archive within an archive), and a range may begin inside such a payload. So each range also
says where the first record after it starts, and a range whose first record isn't where the one before says is read
again from there: what is found is what a reader from the file's start finds.

Spark's own text writer writes the members, and so commits them as it does any table: rows are members without their last
byte, a zero, and the separator of lines is that zero.
"""

from __future__ import annotations

import base64
import datetime
import hashlib
import re
import urllib.parse
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..workspace import rename_files
from .shared import broadcast_if_small, importable, materialize

#: Bytes of a range; of what is read at once; of what is returned at once.
RANGE, READ, BATCH = 64 << 20, 1 << 20, 8 << 20
#: Payloads of fewer bytes are always written.
LEAST = 1_000
#: Repeated payloads (30 bytes each) that are broadcast; more take a shuffled join.
REPEATED_ROWS = 500_000

MAGIC, VERSION, LINE = b"\x1f\x8b\x08", b"WARC/", b"\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def _member(data: bytes) -> bytes:
    pack = zlib.compressobj(6, zlib.DEFLATED, 31)
    return pack.compress(data) + pack.flush()


def _record(kind: str, fields: dict[str, str | None], block: bytes) -> bytes:
    """A member that ends in a zero byte: its last bytes are the high ones of its size, after 16 MB and more an empty
    member follows."""
    fields = {"WARC-Type": kind} | fields | {"Content-Length": str(len(block))}
    head = "".join(f"{k}: {v}\r\n" for k, v in fields.items() if v is not None)
    out = _member(b"WARC/1.1\r\n" + head.encode() + LINE + block + LINE + LINE)
    return out if out[-1] == 0 else out + _member(b"")


def _uri(url: str | None) -> str | None:
    """Without what would end a header's line: blanks and control characters are percent-encoded."""
    return None if url is None else re.sub(r"[\x00-\x20\x7f-\xa0]", lambda m: urllib.parse.quote(m[0]), url)


def _named(page: str | None) -> str:
    return f"<urn:page:{urllib.parse.quote(page or '', safe='')}>"


def page_of(record_id: Column) -> Column:
    """The id, as text, of the row for which write() made a record; a null or empty id is null."""
    return F.nullif(F.url_decode(F.regexp_extract(record_id, "^<urn:page:(.*)>$", 1)), F.lit(""))


def write(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", least: int = LEAST, date: datetime.datetime | None = None) -> None:
    """Write a record for each row into a new folder of .warc.gz files: a response, or a revisit of an equal payload.

    Of rows with equal payloads of `least` bytes or more, those with the largest id (usually one; all that repeat that id)
    are responses; the others are revisits, which name it and have no payload. A null id is less than any; if no copy has
    an id, all are responses. Smaller payloads are responses always. Text is written as UTF-8, binary payloads as they
    are; a null payload is empty, a null url is left out, blanks and control characters of urls are percent-encoded. An
    empty table gives a folder without records. Other columns are ignored. date: of the records, by default that of the
    call. Payloads are read twice, for their digests and to be written; they are shuffled only if more than
    REPEATED_ROWS are repeated.
    """
    importable(pages.sparkSession)
    when = (date or datetime.datetime.now(datetime.timezone.utc)).strftime("%Y-%m-%dT%H:%M:%SZ")
    body = F.coalesce(F.col(payload_col).cast("binary"), F.lit(b""))
    rows = pages.select(F.col(id_col).alias("page"), F.col(url_col).cast("string").alias("url"), body.alias("body"), F.unhex(F.sha1(body)).alias("digest"))
    large = rows.where(F.octet_length("body") >= least)
    again = large.groupBy("digest").agg(F.max("page").alias("first"), F.count("*").alias("n")).where("n > 1 AND first IS NOT NULL").drop("n")
    again = materialize(again, "repeated-payloads")
    at = rows.join(broadcast_if_small(again, REPEATED_ROWS), "digest", "left")
    refers = F.when((F.octet_length("body") >= least) & F.col("first").isNotNull() & ~F.col("page").eqNullSafe(F.col("first")), F.col("first"))
    at = at.select(F.col("page").cast("string").alias("page"), "url", "body", "digest", refers.cast("string").alias("refers"))

    def members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, size = [_record("warcinfo", {"WARC-Record-ID": f"<urn:uuid:{uuid.uuid4()}>", "WARC-Date": when, "Content-Type": "application/warc-fields"}, b"format: WARC File Format 1.1\r\n")], 0
        for batch in batches:
            for k in range(len(batch)):
                page, url, body, digest, refers = (c[k].as_py() for c in batch.columns)
                fields = {
                    "WARC-Record-ID": _named(page), "WARC-Date": when, "WARC-Target-URI": _uri(url), "WARC-Payload-Digest": f"sha1:{base64.b32encode(digest).decode()}",
                    "WARC-Refers-To": None if refers is None else _named(refers), "WARC-Profile": None if refers is None else PROFILE, "Content-Type": "application/http;msgtype=response",
                }
                http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(body)}\r\n\r\n".encode()
                out.append(_record("response" if refers is None else "revisit", fields, http + body if refers is None else http))
                size += len(out[-1])
                if size >= BATCH:
                    yield pa.RecordBatch.from_arrays([pa.array([x[:-1] for x in out], pa.binary())], ["value"])
                    out, size = [], 0
        if size:
            yield pa.RecordBatch.from_arrays([pa.array([x[:-1] for x in out], pa.binary())], ["value"])

    at.mapInArrow(members, "value binary").select(F.col("value").cast("string").alias("value")).write.option("lineSep", "\0").text(path)
    rename_files(pages.sparkSession, path, ".txt", ".warc.gz")


class _Window:
    """A file, of which the bytes asked for last are at hand."""

    def __init__(self, path: str):
        store, at = (fs.LocalFileSystem(), re.sub("^file:/*", "/", path)) if path.startswith(("file:", "/")) else fs.FileSystem.from_uri(re.sub("^s3[an]:", "s3:", path))
        self.file = store.open_input_file(at)
        self.base, self.data = 0, b""

    def get(self, at: int, n: int) -> memoryview:
        """n bytes from `at` on; fewer only at the file's end."""
        if at < self.base or at + n > self.base + len(self.data):
            self.base, self.data = at, self.file.read_at(max(n, READ), at)
        return memoryview(self.data)[at - self.base : at - self.base + n]


def _head(data: bytearray) -> tuple[dict[str, str], int] | None:
    """The fields (by lower-case names) of a record, and where its block begins; None if that isn't a WARC header."""
    end = data.find(LINE + LINE)
    if end < 0 or not data.startswith(VERSION):
        return None
    fields = {}
    for line in data[:end].decode("utf-8", "replace").split("\r\n")[1:]:
        name, colon, value = line.partition(":")
        if not colon:
            return None
        fields[name.strip().lower()] = value.strip()
    return (fields, end + 4) if fields.get("content-length", "").isascii() and fields.get("content-length", "").isdigit() and "warc-type" in fields else None


def _inflate(window: _Window, at: int, least: int = 1 << 14) -> tuple[bytearray, int, bool] | None:
    """(bytes, where the next member begins, whether it is whole) of the member that begins there. None: no member does,
    or its text is no record's."""
    unpack, out, step, begin, whole = zlib.decompressobj(31), bytearray(), least, at, True
    try:
        while whole and not unpack.eof:
            part = window.get(at, step)
            out += unpack.decompress(part)
            whole = len(part) > 0
            at, step = at + len(part), min(4 * step, READ) if least > 16 else step
            if not VERSION.startswith(bytes(out[:5])):
                return None
    except zlib.error:  # what came before the damage is had by small steps
        if least > 16:
            return _inflate(window, begin, 16)
        whole = False
    return (out, at - len(unpack.unused_data), whole) if whole or _head(out) else None


def _next(window: _Window, at: int, stop: int) -> int:
    """The first place from `at` on, before stop, with gzip's magic; -1 if there is none."""
    while at < stop:
        part = bytes(window.get(at, READ))
        if (k := part.find(MAGIC)) >= 0:
            return at + k if at + k < stop else -1
        if len(part) < READ:
            return -1
        at += len(part) - len(MAGIC) + 1
    return -1


def _walk(window: _Window, at: int, stop: int, known: bool) -> Iterator[tuple[int, int, tuple[dict[str, str], int] | None, bytearray]]:
    """(place, where the next begins, header, bytes) of the records that start before stop; at last, where the first
    beyond starts (-1: not known), without a header and bytes. known: one begins at `at`. A damaged record has no next."""
    while at < stop:
        if not known and (at := _next(window, at, stop)) < 0:
            break
        got = _inflate(window, at)
        head = got and _head(got[0])
        if got and not got[2]:
            yield at, -1, head, got[0]
        elif head:
            yield at, got[1], head, got[0]
        if got and got[2] and (head or known and not got[0]):  # an empty member is passed where members follow each other
            at, known = got[1], True
        else:
            at, known = at + 1, False
    yield at, at if known else -1, None, bytearray()


def _ranges(spark: SparkSession, path: str, size: int) -> DataFrame:
    """(path, start, stop, first, known) of all files, dealt over tasks."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "length")  # names and sizes only
    at = files.where("length > 0").select("path", F.explode(F.sequence(F.lit(0).cast("long"), F.col("length") - 1, F.lit(size).cast("long"))).alias("start"), "length")
    at = at.select("path", "start", F.least(F.col("start") + size, "length").alias("stop"), F.col("start").alias("first"), (F.col("start") == 0).alias("known"))
    return at.repartition(max(1, min(at.count(), 100_000)))


_INDEX = "path string, start long, stop long, first long, next long"


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each range, from where it is to be read: where its first record starts (-1: it has none) and the next beyond."""
    for batch in batches:
        for r in batch.to_pylist():
            first = r["first"] if r["known"] else -1
            for place, after, head, _ in _walk(_Window(r["path"]), r["first"], r["stop"], r["known"]):
                if first < 0 and head:
                    first = place
            yield pa.RecordBatch.from_pylist([{"path": r["path"], "start": r["start"], "stop": r["stop"], "first": first, "next": after}], pa.schema([("path", pa.string()), *((c, pa.int64()) for c in ("start", "stop", "first", "next"))]))


def index(spark: SparkSession, path: str, size: int = RANGE) -> DataFrame:
    """(path, start, stop, first, next) of each range of all files below path: where its first record starts, and the first
    after it; -1 for none. Written to the shared folder: a row a range."""
    importable(spark)
    found = materialize(_ranges(spark, path, size).mapInArrow(_scan, _INDEX), "warc-index")
    order = Window.partitionBy("path").orderBy("start")
    before = F.last(F.when(F.col("next") >= 0, F.col("next")), ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1))
    while True:
        # What the ranges before say counts if it leads into this range or beyond; behind damage, nothing is said.
        said = found.withColumn("said", before)
        wrong = F.coalesce((F.col("said") >= F.col("start")) & (F.col("first") != F.when(F.col("said") < F.col("stop"), F.col("said")).otherwise(-1)), F.lit(False))
        said = materialize(said.withColumn("wrong", wrong), "warc-index")
        bad = said.where("wrong")
        if bad.isEmpty():
            return found
        none = bad.where("said >= stop").select("path", "start", "stop", F.lit(-1).cast("long").alias("first"), F.lit(-1).cast("long").alias("next"))
        again = bad.where("said < stop").select("path", "start", "stop", F.col("said").alias("first"), F.lit(True).alias("known"))
        right = said.where("NOT wrong").select("path", "start", "stop", "first", "next")
        found = materialize(right.unionByName(none).unionByName(again.repartition("path", "start").mapInArrow(_scan, _INDEX)), "warc-index")


_RECORD = pa.schema([
    ("path", pa.string()), ("offset", pa.int64()), ("length", pa.int64()), ("type", pa.string()), ("record_id", pa.string()), ("uri", pa.string()), ("date", pa.string()), ("refers_to", pa.string()),
    ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("intact", pa.bool_()), ("headers", pa.map_(pa.string(), pa.string())), ("payload", pa.binary()),
])


def _sha1(told: str) -> str | None:
    """A header's digest, in base 32 or hexadecimal digits, as lower-case hexadecimal digits."""
    name, _, digest = told.partition(":")
    if name.lower() != "sha1":
        return None
    try:
        return digest.lower() if len(digest) == 40 else base64.b32decode(digest.upper()).hex()
    except ValueError:
        return None


def _parsed(path: str, place: int, after: int, head: tuple[dict[str, str], int], data: bytearray, payload: bool) -> dict:
    fields, at = head
    n, kind = int(fields["content-length"]), fields["warc-type"].lower()
    whole = after >= 0 and len(data) >= at + n
    block, length = memoryview(data)[at : at + n], None
    if fields.get("content-type", "").lower().startswith("application/http") and (k := data.find(LINE + LINE, at, at + n)) >= 0:
        if m := re.search(rb"(?i)^content-length:\s*(\d+)\s*$", data[at:k], re.M):
            length = int(m[1])
        block = memoryview(data)[k + 4 : at + n]
    told = _sha1(fields.get("warc-payload-digest", ""))
    own = hashlib.sha1(block).hexdigest()
    revisit = kind == "revisit"
    return {
        "path": path, "offset": place, "length": after - place if after >= 0 else None, "type": kind, "record_id": fields.get("warc-record-id"), "uri": fields.get("warc-target-uri"), "date": fields.get("warc-date"),
        "refers_to": fields.get("warc-refers-to"), "payload_bytes": length if revisit else len(block), "payload_digest": told if revisit else own, "intact": whole and (revisit or told in (None, own)), "headers": fields, "payload": bytes(block) if payload and not revisit else None,
    }


def read(spark: SparkSession, path: str, payload: bool = True, size: int = RANGE) -> DataFrame:
    """A row for each record of the gzipped archives below path (a folder, a file or a pattern), in no order.

    (path, offset, length: of the member; type, record_id, uri, date, refers_to; payload_bytes, payload_digest: SHA-1 in
    hexadecimal digits; intact; headers: all fields, by lower-case names; payload). The payload is the block, of
    HTTP messages what follows their headers. A revisit has none: its size (HTTP's Content-Length) and digest are those that
    its headers tell, null if they don't. intact: the member is whole and has the digest that it tells. A record that is
    damaged behind its header has a row with what could be read, without a length; what is damaged before that is passed
    over, up to the next header. payload=False: without payloads' bytes. size: bytes of a range; results don't depend on it.
    Files are opened where tasks run, by pyarrow (local or shared folders, S3, GCS, HDFS); a record must fit a task's memory.
    """
    found = index(spark, path, size).where("first >= 0")
    names = ["path", "first", "stop"]
    schema = "path string, offset long, length long, type string, record_id string, uri string, date string, refers_to string, payload_bytes long, payload_digest string, intact boolean, headers map<string,string>, payload binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                out, held = [], 0
                for place, after, head, data in _walk(_Window(r["path"]), r["first"], r["stop"], True):
                    if head:
                        out.append(_parsed(r["path"], place, after, head, data, payload))
                        held += len(data) if payload else 1_000
                    if held >= BATCH or (not head and out):
                        yield pa.RecordBatch.from_pylist(out, _RECORD)
                        out, held = [], 0

    dealt = found.select(*names).repartition(max(1, min(found.count(), 100_000)))
    out = dealt.mapInArrow(run, schema)
    return out if payload else out.drop("payload")
