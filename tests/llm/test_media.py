"""Containers round trip, and those of other shapes."""

import struct

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from rostrum.llm import media


@settings(max_examples=40, deadline=None)
@given(st.binary(max_size=60_000))
def test_round_trip(raw):
    payload = media.padded(raw)
    assert len(payload) % 576 == 0
    assert payload.startswith(raw)
    assert set(payload[len(raw) :]) <= {255}
    file = media.container(payload)
    (track,) = media.tracks(file)
    assert media.samples(file, track) == payload


def test_column(docs, clash):
    stored = media.wrapped(clash(docs).drop("media"), "text", ("doc_id", "lang"))
    back = media.payloads(stored, ("doc_id", "n_bytes")).collect()
    got = sorted((str(r["doc_id"]), r["n_bytes"], bytes(r["payload"])) for r in back)
    raw = [(str(r["doc_id"]), (r["text"] or "").encode()) for r in docs.collect()]
    assert got == sorted((d, len(b), media.padded(b)) for d, b in raw)
    assert {r["codec"] for r in back} == {"raw "}


def box(kind, *parts):
    body = b"".join(parts)
    return struct.pack(">I4s", 8 + len(body), kind) + body


def video(wide=False):
    """Five samples of unlike sizes in three chunks, two of them keyframes, before and after the sample tables."""
    sizes = [10, 20, 5, 7, 8]
    data = bytes(range(50))
    head = box(b"ftyp", b"mp42", bytes(4))
    table = lambda kind, values, n: box(kind, struct.pack(">II", 0, n), np.array(values, ">u4").tobytes())
    starts = [len(head) + 16 + x for x in (0, 30, 42)]
    chunk = box(b"co64", struct.pack(">II", 0, 3), np.array(starts, ">u8").tobytes()) if wide else table(b"stco", starts, 3)
    stbl = box(
        b"stbl", box(b"stsd", struct.pack(">II", 0, 1), box(b"avc1", bytes(70))), table(b"stts", [2, 100, 3, 200], 2), table(b"stss", [1, 4], 2), table(b"stsc", [1, 2, 1, 3, 1, 1], 2),
        box(b"stsz", struct.pack(">III", 0, 0, 5), np.array(sizes, ">u4").tobytes()), chunk,
    )
    mdia = box(b"mdia", box(b"mdhd", struct.pack(">IIIIIHH", 0, 0, 0, 1000, 800, 0, 0)), box(b"hdlr", struct.pack(">II4s", 0, 0, b"vide"), bytes(13)), box(b"minf", stbl))
    mdat = struct.pack(">I4sQ", 1, b"mdat", 16 + len(data)) + data
    return head + mdat + box(b"moov", box(b"trak", mdia)), starts, sizes


@pytest.mark.parametrize("wide", [False, True])
def test_video(wide):
    file, starts, sizes = video(wide)
    out = media.probe(file)
    assert (out["codec"], out["handler"], out["duration_s"], out["n_samples"], out["error"]) == ("avc1", "vide", 0.8, 5, None)
    assert out["keyframes"] == [{"start": starts[0], "end": starts[0] + 10}, {"start": starts[1] + 5, "end": starts[1] + 12}]


def test_other_bytes(spark):
    file = video()[0]
    rows = [(1, None), (2, b""), (3, b"not a container at all"), (4, bytearray(file)), (5, bytearray(file[:-30])), (6, bytearray(file))]
    df = spark.createDataFrame(rows, "id long, media binary")
    out = {r["id"]: r for r in media.probed(df).collect()}
    assert (out[1]["codec"], out[1]["error"]) == (None, None)
    assert all(out[k]["error"] for k in (2, 3, 5))
    assert out[4]["keyframes"] == out[6]["keyframes"]
    assert len(out[4]["keyframes"]) == 2


def test_no_rows(no_docs):
    assert media.payloads(media.wrapped(no_docs, "text", ("doc_id",)), ("doc_id", "n_bytes")).count() == 0
