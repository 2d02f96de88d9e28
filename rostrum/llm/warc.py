"""WARC archives: a writer with revisit records, and a splittable reader.

Archives are gzip files with one member for each record, so a reader can start
at any member. The reader's tasks each get a range of bytes: they look for the
gzip magic, accept a candidate only if it decodes to the headers of a WARC record, and own the records that start inside their range, reading past its
end where the last of them does.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator
from urllib.parse import quote, unquote

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batches_of, exact_ids, shared_dir, stored
from .files import open_in, open_out, own_name

MAGIC = b"\x1f\x8b\x08"
#: Bytes that tell whether a member begins like a WARC record.
LOOK = 4096
DATE = "1970-01-01T00:00:00Z"
RECORD = (
    "page_id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long, "
    "payload binary, archive string, offset long, error string"
)
NUMBERS = ("page_id", "payload_bytes", "refers_to", "offset")
#: Tasks that read, where there are as many ranges.
MOST_TASKS = 20_000


def with_revisits(pages: DataFrame, path: str, least: int = 1000) -> DataFrame:
    """Adds payload_bytes, payload_digest (hex SHA-1), record_type and refers_to to (page_id, url, html).

    Of records with equal payloads of ``least`` bytes or more the one with the
    largest page_id is the response, the others are revisits of it. Null html
    is an empty payload. Rows that tie for the largest page_id are responses
    all; a null page_id is smaller than any other.

    Digests that occur once never need a partner, so only the others are
    joined; Spark sends them to all tasks if they are few, and splits a hot
    digest otherwise.
    """
    rows = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html"))
    rows = rows.withColumn("payload_bytes", F.octet_length("html").cast("long")).withColumn("payload_digest", F.sha1("html"))
    groups = rows.where(F.col("payload_bytes") >= least).groupBy(F.col("payload_digest").alias("same"))
    groups = groups.agg(F.count(F.lit(1)).alias("n"), F.max("page_id").alias("holder")).where("n > 1").drop("n")
    groups = stored(groups, f"{path}/groups")
    rows = rows.join(groups, F.col("payload_digest") == F.col("same"), "left").drop("same")
    revisit = F.col("holder").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("holder"))
    rows = rows.withColumn("record_type", F.when(revisit, "revisit").otherwise("response"))
    return rows.withColumn("refers_to", F.when(revisit, F.col("holder"))).drop("holder")


def _header(value: str) -> str:
    """Header values hold no blanks or controls: a value with any has these and its percent signs escaped."""
    odd = r"[\x00-\x20\x7f-\xa0\u2028\u2029]"
    return quote(value, safe="/:?#[]@!$&'()*+,;=~", errors="surrogatepass") if re.search(odd, value) else value


def _member(kind: str, headers: list[tuple[str, object]], block: bytes, level: int) -> bytes:
    lines = [("WARC-Type", kind), *headers, ("WARC-Date", DATE), ("Content-Length", len(block))]
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in lines) + "\r\n"
    pack = zlib.compressobj(level, zlib.DEFLATED, 31)
    return pack.compress(head.encode() + block + b"\r\n\r\n") + pack.flush()


def _encode(row, level: int) -> bytes:
    payload = row.html.encode()
    headers = [] if pd.isna(row.page_id) else [("WARC-Record-ID", f"<urn:page:{row.page_id}>")]
    if not pd.isna(row.url):
        url = _header(row.url)
        headers += [("WARC-Target-URI", url), *([("X-Target-URI-Escaped", "yes")] if url != row.url else [])]
    digest = base64.b32encode(bytes.fromhex(row.payload_digest)).decode()
    headers.append(("WARC-Payload-Digest", f"sha1:{digest}"))
    if row.record_type == "revisit":
        headers += [
            ("WARC-Refers-To", f"<urn:page:{row.refers_to}>"),
            ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"),
            ("X-Payload-Length", len(payload)),
        ]
        return _member("revisit", headers, b"", level)
    headers.append(("Content-Type", "application/http; msgtype=response"))
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n"
    return _member("response", headers, http.encode() + payload, level)


def write_archives(rows: DataFrame, path: str, level: int = 3) -> DataFrame:
    """Writes the rows of ``with_revisits``, an archive for each task, and returns the archives: (archive, bytes, records).

    The returned table is committed before it can be read, so each record is in
    exactly one archive that it names, whatever executors were lost meanwhile.
    """

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out, name, size, n = None, own_name(f"{path}/archives/part", ".warc.gz"), 0, 0
        for batch in batches:
            for row in batch.itertuples(index=False):
                if out is None:
                    out = open_out(name)
                    size += out.write(_member("warcinfo", [("Content-Type", "application/warc-fields")], b"format: WARC/1.1\r\n", level))
                size += out.write(_encode(row, level))
                n += 1
        if out is not None:
            out.close()
            yield pd.DataFrame({"archive": [name], "bytes": [size], "records": [n]})

    with batches_of(rows.sparkSession):
        made = exact_ids(rows, write, "archive string, bytes long, records long", "page_id", "refers_to")
        return stored(made, f"{path}/list")


def _candidates(data: bytes, start: int, end: int) -> Iterator[int]:
    """Offsets at or after ``start`` and before ``end`` where a WARC record's member begins."""
    at = data.find(MAGIC, start)
    while 0 <= at < end:
        if _begins_record(data[at : at + LOOK]):
            yield at
        at = data.find(MAGIC, at + 1)


def _begins_record(data: bytes) -> bool:
    """Whether a member that begins so holds a WARC record: a version, then lines of names and values, as far as they are decoded.

    Headers that end within ``LOOK`` bytes of the member must name the record's type and length.
    """
    try:
        head, end, _ = zlib.decompressobj(31).decompress(data, 16 * LOOK).partition(b"\r\n\r\n")
    except zlib.error:
        return False
    version, *lines = head.split(b"\r\n")
    if not re.fullmatch(rb"WARC/\d+\.\d+", version):
        return False
    lines = [x.partition(b":") for x in (lines if end else lines[:-1]) if x[:1] not in (b" ", b"\t")]  # without those that go on
    if not all(colon for _, colon, _ in lines):
        return False
    fields = {name.strip().lower(): value.strip() for name, _, value in lines}
    return not end or (bool(fields.get(b"warc-type")) and fields.get(b"content-length", b"").isdigit())


def _parsed(data: bytes) -> dict:
    """The fields of a record; those of records without a page stay None."""
    head, _, block = data.partition(b"\r\n\r\n")
    lines = [x.partition(":") for x in head.decode("utf-8", "replace").split("\r\n")[1:]]
    fields = {k.strip().lower(): v.strip(" \t") for k, _, v in lines}
    block = block[: int(fields["content-length"])]
    number = lambda name: int(m[1]) if (m := re.fullmatch(r"<urn:page:(-?\d+)>", fields.get(name, ""))) else None
    url = fields.get("warc-target-uri")
    out = {"page_id": number("warc-record-id"), "url": unquote(url, errors="surrogatepass") if url and "x-target-uri-escaped" in fields else url, "record_type": fields["warc-type"]}
    out["refers_to"] = number("warc-refers-to")
    said = fields.get("warc-payload-digest", "").removeprefix("sha1:")
    said = base64.b32decode(said).hex() if said else None
    if out["record_type"] == "revisit":
        return out | {"payload_bytes": int(fields.get("x-payload-length", 0)), "payload_digest": said}
    payload = block.partition(b"\r\n\r\n")[2] if fields.get("content-type", "").startswith("application/http") else block
    digest = hashlib.sha1(payload).hexdigest()
    out |= {"payload": payload, "payload_bytes": len(payload), "payload_digest": digest}
    return out | {"error": "payload digest differs"} if said and said != digest else out


def records_in(path: str, start: int, end: int) -> Iterator[dict]:
    """The records of one archive that start in [start, end); damaged ones come with ``error``."""
    with open_in(path) as f:
        size = f.size()
        # what is past the end tells whether a record begins at the very end
        data, base = f.read_at(min(end + LOOK, size) - start, start), start
        whole = base + len(data) >= size
        at = next(_candidates(data, 0, end - base), None)
        while at is not None and base + at < end:
            unpack, out, used = zlib.decompressobj(31), [], at
            record = {"archive": path, "offset": base + at}
            try:
                while not unpack.eof:
                    if used >= len(data):
                        if whole:
                            raise EOFError("the archive ends inside a record")
                        more = f.read_at(1 << 20, base + len(data))
                        data, whole = data + more, base + len(data) + len(more) >= size
                        continue
                    out.append(unpack.decompress(data[used : used + (1 << 16)]))
                    used = min(used + (1 << 16), len(data))
                used -= len(unpack.unused_data)
                record |= _parsed(b"".join(out))
            except (zlib.error, EOFError, KeyError, ValueError) as e:
                record["error"], used = f"{type(e).__name__}: {e}", at + 1
            yield record
            if data[used : used + 3] == MAGIC:
                at = used
            else:  # damage, padding, or the end of what was read
                if used + LOOK > len(data) and not whole:
                    data += f.read_at(1 << 20, base + len(data))
                    whole = base + len(data) >= size
                at = next(_candidates(data, used, min(len(data), max(0, end - base))), None)


def read_archives(archives: DataFrame, split_bytes: int = 8 << 20) -> DataFrame:
    """All records of the archives (archive, bytes), read by ranges of ``split_bytes`` whatever the archives' sizes.

    Returns page_id, url, record_type, payload_bytes, payload_digest,
    refers_to, payload, archive, offset, error; warcinfo records included.
    Damaged records keep archive, offset and error only. No archives, no rows.

    Ranges are dealt to ``MOST_TASKS`` tasks at most, by number: a list of
    ranges is small, and by its size Spark would give all to one task.
    """

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in RECORD.split(", ")]
        frame = lambda rows: pd.DataFrame([[x if x is None or c not in NUMBERS else str(x) for c, x in zip(names, r, strict=True)] for r in rows], columns=names, dtype=object)
        for batch in batches:
            for archive, start, end in batch.itertuples(index=False):
                rows, held = [], 0
                for r in records_in(archive, start, end):
                    rows.append([r.get(c) for c in names])
                    held += len(r.get("payload") or b"")
                    if held > 8 << 20:
                        yield frame(rows)
                        rows, held = [], 0
                if rows:
                    yield frame(rows)

    starts = F.explode(F.sequence(F.lit(0).cast("long"), F.col("bytes") - 1, F.lit(split_bytes).cast("long")))
    splits = archives.where("bytes > 0").select("archive", starts.alias("start"))
    splits = splits.withColumn("end", F.col("start") + split_bytes)
    tasks = min(MOST_TASKS, max(1, splits.count()))
    return exact_ids(splits.repartition(tasks), read, RECORD, *NUMBERS)


def archived(pages: DataFrame, least: int = 1000) -> DataFrame:
    """The records of ``pages`` (page_id, url, html) after a round trip through archives.

    Other columns are not read, whatever their names.
    """
    path = shared_dir(pages.sparkSession)
    return read_archives(write_archives(with_revisits(pages, path, least), path)).where(
        F.col("record_type").isNull() | (F.col("record_type") != "warcinfo")
    )
