"""Archives round trip under any split, and damaged ones."""

import gzip
import hashlib

import pytest
from pyspark.sql import functions as F

from rostrum.llm import warc
from rostrum.llm.common import shared_dir

PAGE = "page_id long, url string, html string"


@pytest.fixture(scope="module")
def pages(spark):
    big = "<p>é</p>" * 200
    rows = [(i, f"http://h{i}.example/\n{i}", f"<b>{i}</b>" * (i % 200)) for i in range(120)]
    rows += [(500, None, big), (501, "u", big), (502, "u", big), (503, "u", None), (504, "u", ""), (505, "u", "small"), (506, "u", "small"), (None, "n", big), (502, "again", big)]
    return spark.createDataFrame(rows, PAGE)


def wanted(rows):
    top: dict = {}
    for r in rows:
        raw = (r["html"] or "").encode()
        top[raw] = max(top.get(raw, -1), -1 if r["page_id"] is None else r["page_id"])
    out = []
    for r in rows:
        raw = (r["html"] or "").encode()
        revisit = len(raw) >= 1000 and r["page_id"] != top[raw]
        out.append((str(r["page_id"]), len(raw), hashlib.sha1(raw).hexdigest(), "revisit" if revisit else "response", top[raw] if revisit else None))
    return sorted(out, key=str)


@pytest.mark.parametrize("split", [64, 1000, 1 << 23])
def test_round_trip(pages, clash, split):
    path = shared_dir(pages.sparkSession)
    archives = warc.write_archives(warc.with_revisits(clash(pages), path), path)
    got = warc.read_archives(archives, split).where("record_type <> 'warcinfo'").collect()
    cut = [(str(r["page_id"]), r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in got]
    assert sorted(cut, key=str) == wanted(pages.collect())
    assert not any(r["error"] for r in got)
    html = {(r["page_id"], r["html"]) for r in pages.collect()}
    urls = sorted((str(r["page_id"]), str(r["url"])) for r in pages.collect())
    assert sorted((str(r["page_id"]), str(r["url"])) for r in got) == urls
    assert all((r["page_id"], bytes(r["payload"]).decode() or None) in html or (r["page_id"], bytes(r["payload"]).decode()) in html for r in got if r["record_type"] == "response")


def test_magic_inside_payloads_is_no_record(tmp_path):
    trap = b"\x1f\x8b\x08" + bytes(7) + b"WARC/" + b"\x1f\x8b\x08\x00" * 50
    file = b"".join(warc._member("resource", [("WARC-Record-ID", f"<urn:page:{k}>")], trap * 20, 0) for k in range(30))
    path = tmp_path / "a.warc.gz"
    path.write_bytes(file)
    ends = [*range(0, len(file), 777), len(file)]
    found = [r["page_id"] for a, b in zip(ends[:-1], ends[1:], strict=True) for r in warc.records_in(f"file://{path}", a, b)]
    assert found == list(range(30))


def test_many_ranges_are_read_by_many_tasks(spark):
    pages = spark.range(200).selectExpr("(1L << 60) + id AS page_id", "if(id % 9 = 0, NULL, concat('http://h/', id)) AS url", "repeat(sha2(string(id), 512), 40) AS html")
    path = shared_dir(spark)
    archives = warc.write_archives(warc.with_revisits(pages.unionByName(pages.limit(1).withColumn("page_id", F.lit(None).cast("long"))).coalesce(2), path), path)
    got = warc.read_archives(archives, 512).withColumn("task", F.spark_partition_id()).where("record_type <> 'warcinfo'").collect()
    assert len({r["task"] for r in got}) > 20
    assert sorted(r["page_id"] for r in got if r["page_id"] is not None) == [(1 << 60) + k for k in range(200)]


def test_headers_tell_records_from_what_begins_like_one():
    import zlib

    pack = lambda data: (lambda z: z.compress(data) + z.flush())(zlib.compressobj(6, zlib.DEFLATED, 31))
    assert warc._begins_record(warc._member("resource", [("WARC-Record-ID", "x")], b"y", 6))
    assert warc._begins_record(pack(b"WARC/1.0\r\nWARC-Type: metadata\r\nX: a\r\n b: folded\r\nContent-Length: 1\r\n\r\nz\r\n\r\n"))
    for bad in (b"WARC/", b"WARC/1.0\r\nno header\r\n\r\n", b"WARC/1.0\r\nWARC-Type: a\r\n\r\n", b"WARC/1.0\r\nWARC-Type: a\r\nContent-Length: many\r\n\r\n", b"WARC/x\r\n\r\n", b""):
        assert not warc._begins_record(pack(bad))


def test_damage_costs_one_record(tmp_path):
    members = [warc._member("resource", [("WARC-Record-ID", f"<urn:page:{k}>")], bytes([k]) * 5000, 6) for k in range(6)]
    file = bytearray(b"".join(members))
    at = len(members[0]) + len(members[1]) // 2
    file[at : at + 4] = b"\0\0\0\0"
    path = tmp_path / "b.warc.gz"
    path.write_bytes(bytes(file[:-9]))
    out = list(warc.records_in(f"file://{path}", 0, len(file)))
    assert [r["page_id"] for r in out if not r.get("error")] == [0, 2, 3, 4]
    assert sum(bool(r.get("error")) for r in out) == 2


def test_members_are_plain_gzip():
    assert gzip.decompress(warc._member("warcinfo", [], b"x", 6)).startswith(b"WARC/1.1\r\n")


def test_no_rows(spark):
    assert warc.archived(spark.createDataFrame([], PAGE)).count() == 0
