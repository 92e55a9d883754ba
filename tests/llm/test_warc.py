"""Archives: what is written comes back, however the bytes are dealt out, also where payloads are archives or bytes are damaged."""

import glob
import gzip
import hashlib
import os
import random

import pytest

from tallygrid.llm import shared, warc

from . import brute

LARGE = "x" * 1_500
ROWS = [
    (1, "http://a.org/1", "<p>é</p>"), (2, "http://a.org/2", LARGE), (3, "http://a.org/3", LARGE), (9, "http://a.org/9\r\nWARC-Type: none", LARGE), (4, None, "<p>é</p>"),
    (5, "http://b.org", None), (6, "http://b.org", ""), (None, "http://c.org", LARGE), (None, "http://c.org", "y" * 1_000), (None, "http://d.org", "y" * 1_000), (7, "", "z" * 999), (8, "", "z" * 999),
    (10, "u", "\r\n\r\nWARC/1.1\r\n\r\n" * 100), (11, "u", "w" * 1_000), (11, "u", "w" * 1_000), (12, "u", "ab" * 3_000_000),
]


@pytest.fixture(scope="module", autouse=True)
def reachable(spark):
    shared.importable(spark)


def wanted(rows):
    out = []
    first = {}
    for i, _, x in rows:
        if i is not None:
            first[x] = max(i, first.get(x, i))
    for i, _, x in rows:
        body = x if isinstance(x, bytes) else (x or "").encode()
        to = first.get(x) if len(body) >= 1_000 and first.get(x) != i else None
        out.append((i, len(body), hashlib.sha1(body).hexdigest(), "response" if to is None else "revisit", to))
    return sorted(out, key=repr)


def told(df):
    at = df.where("type <> 'warcinfo'").select(warc.page_of(df["record_id"]).cast("long"), "payload_bytes", "payload_digest", "type", warc.page_of(df["refers_to"]).cast("long"))
    return sorted(map(tuple, at.collect()), key=repr)


def test_what_is_written_comes_back(spark, tmp_path):
    warc.write(brute.frame(spark, ROWS, "page_id long, url string, html string"), f"file://{tmp_path}/a")
    found = warc.read(spark, f"file://{tmp_path}/a").cache()
    assert told(found) == wanted(ROWS)
    assert found.where("NOT intact").count() == 0
    bodies = {r[0]: bytes(r[1]) for r in found.where("type = 'response'").select("record_id", "payload").collect()}
    assert bodies["<urn:page:12>"] == b"ab" * 3_000_000 and bodies["<urn:page:1>"] == "<p>é</p>".encode() and bodies["<urn:page:10>"] == ROWS[12][2].encode()
    assert {r[0] for r in found.select("uri").collect()} >= {"http://a.org/9%0D%0AWARC-Type:%20none", "http://a.org/1", None}
    raw = b"".join(gzip.open(f).read() for f in glob.glob(f"{tmp_path}/a/*.warc.gz"))  # any reader of gzip reads them
    assert raw.count(b"WARC-Type: revisit") == len([x for x in wanted(ROWS) if x[3] == "revisit"])


def test_empty_tables_and_records_of_over_16_mb(spark, tmp_path):
    warc.write(brute.frame(spark, ROWS, "page_id long, url string, html string").limit(0), f"file://{tmp_path}/none")
    assert told(warc.read(spark, f"file://{tmp_path}/none")) == []
    rows = [(1, "u", bytes(17 << 20)), (2, "u", b"after"), (3, "u", random.Random(1).randbytes(17 << 20)), (4, "u", b"last")]
    warc.write(brute.frame(spark, rows, "page_id long, url string, html binary", 1), f"file://{tmp_path}/long")
    found = warc.read(spark, f"file://{tmp_path}/long", size=1 << 20)
    assert told(found) == wanted(rows) and found.where("NOT intact").count() == 0 and "payload" in found.columns


@pytest.mark.parametrize("size", [5_000, 40_000])
def test_ranges_do_not_change_what_is_found(spark, tmp_path, size):
    """Payloads that are archives, in members that aren't packed: their own members stand in the file as they are."""
    rng = random.Random(3)
    inner = b"".join(warc._record("response", {"WARC-Record-ID": f"<urn:page:{900 + k}>"}, rng.randbytes(rng.randint(0, 500))) for k in range(40))
    rows = [(k, inner if k % 3 == 0 else rng.randbytes(rng.randint(0, 3_000))) for k in range(24)]
    os.makedirs(tmp_path / "a")
    with open(tmp_path / "a" / "x.warc.gz", "wb") as f:
        for k, x in rows:
            f.write(gzip.compress(gzip.decompress(warc._record("response", {"WARC-Record-ID": f"<urn:page:{k}>"}, x)), 0))
    raw = (tmp_path / "a" / "x.warc.gz").read_bytes()
    assert raw.count(warc.MAGIC) > 300 and inner in raw
    wrong = warc.materialize(warc._ranges(spark, f"file://{tmp_path}/a", size).mapInArrow(warc._scan, warc._INDEX), "scan")  # what ranges find alone
    starts = {r["first"] for r in warc.index(spark, f"file://{tmp_path}/a", size).collect()}
    assert {r["first"] for r in wrong.collect()} != starts or size == 40_000
    assert told(warc.read(spark, f"file://{tmp_path}/a", payload=False, size=size)) == sorted(((i, len(x), hashlib.sha1(x).hexdigest(), "response", None) for i, x in rows), key=repr)


def test_damage_ends_with_the_next_record(spark, tmp_path):
    rng = random.Random(4)
    parts = [warc._record("response", {"WARC-Record-ID": f"<urn:page:{k}>"}, rng.randbytes(2_000)) for k in range(30)]
    parts[10] = parts[10][:1_500] + bytes(20) + parts[10][1_520:]  # behind its header
    parts[20] = b"\0" * len(parts[20])
    parts[29] = parts[29][:1_000]
    os.makedirs(tmp_path / "a")
    (tmp_path / "a" / "x.warc.gz").write_bytes(b"".join(parts))
    for size in (3_000, 10**6):
        found = {r["record_id"]: r for r in warc.read(spark, f"file://{tmp_path}/a", size=size).collect()}
        assert {*found} == {f"<urn:page:{k}>" for k in range(30) if k != 20}
        assert {k for k, r in found.items() if not r["intact"]} == {"<urn:page:10>", "<urn:page:29>"}
        assert found["<urn:page:10>"]["length"] is None and found["<urn:page:11>"]["length"] == len(parts[11])
