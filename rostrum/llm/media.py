"""Media columns: ISO media containers, walked but not decoded.

``probed`` adds to a column of container bytes what its boxes tell: codec,
duration, and the byte ranges of keyframes, from the sample tables alone.
``wrapped`` stores any bytes losslessly as the samples of a container.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from .common import exact_ids, small_batches

#: Boxes that hold boxes; the number is that of bytes before the first of them.
HOLDERS = {b"moov": 0, b"trak": 0, b"mdia": 0, b"minf": 0, b"stbl": 0, b"edts": 0, b"dinf": 0, b"mvex": 0, b"stsd": 8}
UNIT = 576
RATE = 8000
KEY_EVERY = 16
PER_CHUNK = 32


def boxes(data, start: int, end: int, path: tuple = ()) -> Iterator[tuple[tuple, int, int]]:
    """(path, first, last) of the boxes in [start, end), outer ones first; the path is that of types and positions."""
    at, n = start, 0
    while at + 8 <= end:
        size, kind = struct.unpack_from(">I4s", data, at)
        head = 8
        if size == 1:
            size, head = struct.unpack_from(">Q", data, at + 8)[0], 16
        elif size == 0:
            size = end - at
        if size < head or at + size > end:
            raise ValueError(f"box {kind!r} at {at} has size {size}")
        here = (*path, (kind, n))
        yield here, at + head, at + size
        if kind in HOLDERS and path[-1:] != ((b"stsd", 0),):
            yield from boxes(data, at + head + HOLDERS[kind], at + size, here)
        at, n = at + size, n + 1


def _numbers(data, at: int, n: int, kind: str, end: int) -> np.ndarray:
    width = np.dtype(kind).itemsize
    if at + n * width > end:
        raise ValueError("a sample table ends early")
    return np.frombuffer(data, kind, n, at).astype(np.int64)


def tracks(data: bytes) -> list[dict]:
    """Each track's handler, codec, timescale, duration and samples (offset, size, sync), in the order of the file."""
    found: dict = {}
    for path, first, last in boxes(data, 0, len(data)):
        if len(path) < 2 or path[1][0] != b"trak":
            continue
        track, kind = found.setdefault(path[1], {}), path[-1][0]
        inside = path[-2][0]
        if kind == b"mdhd":
            at = first + (20 if data[first] else 12)
            track["timescale"], track["duration"] = struct.unpack_from(">IQ" if data[first] else ">II", data, at)
        elif kind == b"hdlr":
            track["handler"] = data[first + 8 : first + 12].decode("latin-1")
        elif inside == b"stsd":
            track.setdefault("codec", kind.decode("latin-1"))
        elif kind in (b"stts", b"stsc", b"stss", b"stco", b"co64"):
            n, width = struct.unpack_from(">I", data, first + 4)[0], {b"stts": 2, b"stsc": 3}.get(kind, 1)
            table = _numbers(data, first + 8, n * width, ">u8" if kind == b"co64" else ">u4", last)
            track["stco" if kind == b"co64" else kind.decode()] = table.reshape(n, width) if width > 1 else table
        elif kind == b"stsz":
            same, n = struct.unpack_from(">II", data, first + 4)
            track["sizes"] = np.full(n, same, np.int64) if same else _numbers(data, first + 12, n, ">u4", last)
    return [_sampled(t, len(data)) for t in found.values()]


def _sampled(track: dict, length: int) -> dict:
    """Resolves the sample tables: chunk runs to samples, samples to offsets."""
    sizes, offsets = track.get("sizes", np.empty(0, np.int64)), track.get("stco", np.empty(0, np.int64))
    runs = track.get("stsc", np.empty((0, 3), np.int64))
    n = len(sizes)
    where, chunk = np.empty(0, np.int64), np.empty(0, np.int64)
    if n:
        until = np.append(runs[1:, 0], len(offsets) + 1)
        each = np.repeat(runs[:, 1], until - runs[:, 0])  # samples of each chunk
        chunk = np.repeat(np.arange(len(each)), each)[:n]
        if len(chunk) < n or len(each) > len(offsets):
            raise ValueError("the chunks don't hold all samples")
        before = np.cumsum(sizes) - sizes
        first = np.r_[True, chunk[1:] != chunk[:-1]]
        where = offsets[chunk] + before - before[first][np.cumsum(first) - 1]
        if (where < 0).any() or (where + sizes > length).any():
            raise ValueError("a sample lies outside the file")
    sync = np.ones(n, bool)
    if "stss" in track:
        sync[:] = False
        sync[track["stss"][track["stss"] <= n] - 1] = True
    times = track.get("stts", np.empty((0, 2), np.int64))
    scale = track.get("timescale") or 1
    return {
        "handler": track.get("handler"), "codec": track.get("codec"), "timescale": scale,
        "duration_s": float((times[:, 0] * times[:, 1]).sum() or track.get("duration", 0)) / scale,
        "offsets": where, "sizes": sizes, "sync": sync,
    }


def samples(data: bytes, track: dict) -> bytes:
    """The bytes of a track's samples, in their order; neighbours are read as one range."""
    start, end = track["offsets"], track["offsets"] + track["sizes"]
    cut = np.flatnonzero(start[1:] != end[:-1])
    return b"".join(data[a:b] for a, b in zip(start[np.r_[0, cut + 1]], end[np.r_[cut, len(end) - 1]], strict=True)) if len(start) else b""


def _box(kind: bytes, *parts: bytes) -> bytes:
    body = b"".join(parts)
    return struct.pack(">I4s", 8 + len(body), kind) + body


def container(payload: bytes) -> bytes:
    """A file whose one track holds ``payload``, a positive multiple of 576 bytes, as 8-bit samples at 8 kHz.

    576 samples make a unit of the sample tables; every 16th unit is marked as
    a keyframe, 32 units make a chunk.
    """
    if not payload or len(payload) % UNIT:
        raise ValueError("the payload must be a positive multiple of 576 bytes")
    n = len(payload) // UNIT
    head = _box(b"ftyp", b"isom", struct.pack(">I", 512), b"isomiso2mp41")
    large = len(payload) >= 1 << 31
    data = struct.pack(">I4sQ", 1, b"mdat", 16 + len(payload)) if large else struct.pack(">I4s", 8 + len(payload), b"mdat")
    base = len(head) + len(data)
    starts = np.arange(0, n, PER_CHUNK, dtype=np.int64) * UNIT + base
    wide = bool(starts[-1] >= 1 << 32)
    keys = np.arange(1, n + 1, KEY_EVERY)
    full, rest = divmod(n, PER_CHUNK)
    runs = ([(1, PER_CHUNK, 1)] if full else []) + ([(full + 1, rest, 1)] if rest else [])
    table = lambda kind, rows, form: _box(kind, struct.pack(">II", 0, len(rows)), np.asarray(rows, form).tobytes())
    entry = _box(b"raw ", bytes(6), struct.pack(">HIIHHHHI", 1, 0, 0, 1, 8, 0, 0, RATE << 16))
    stbl = _box(
        b"stbl",
        _box(b"stsd", struct.pack(">II", 0, 1), entry),
        table(b"stts", [(n, UNIT)], ">u4"),
        table(b"stss", keys, ">u4"),
        table(b"stsc", runs, ">u4"),
        _box(b"stsz", struct.pack(">III", 0, UNIT, n)),
        table(b"co64", starts, ">u8") if wide else table(b"stco", starts, ">u4"),
    )
    url = _box(b"dref", struct.pack(">II", 0, 1), _box(b"url ", struct.pack(">I", 1)))
    minf = _box(b"minf", _box(b"smhd", bytes(8)), _box(b"dinf", url), stbl)
    length = n * UNIT
    mdhd = _box(b"mdhd", struct.pack(">IQQIQHH", 1 << 24, 0, 0, RATE, length, 0x55C4, 0))
    hdlr = _box(b"hdlr", struct.pack(">II4s", 0, 0, b"soun"), bytes(12), b"samples\0")
    matrix = struct.pack(">9I", 1 << 16, 0, 0, 0, 1 << 16, 0, 0, 0, 1 << 30)
    tkhd = _box(b"tkhd", struct.pack(">IQQIIQ", (1 << 24) | 7, 0, 0, 1, 0, length), bytes(8), struct.pack(">HHHH", 0, 0, 256, 0), matrix, bytes(8))
    mvhd = _box(b"mvhd", struct.pack(">IQQIQIH", 1 << 24, 0, 0, RATE, length, 1 << 16, 256), bytes(10), matrix, bytes(24), struct.pack(">I", 2))
    moov = _box(b"moov", mvhd, _box(b"trak", tkhd, _box(b"mdia", mdhd, hdlr, minf)))
    return b"".join((head, data, payload, moov))


def padded(raw: bytes) -> bytes:
    """``raw`` with bytes 255 up to a positive multiple of 576."""
    return raw + b"\xff" * (-len(raw) % UNIT if raw else UNIT)


def wrapped(df: DataFrame, text: str, keep: tuple[str, ...]) -> DataFrame:
    """(keep..., n_bytes, media): each whole text's UTF-8, padded, in a container of its own.

    Null counts as empty; an empty text is one unit of padding. Other columns
    are not read. Equal texts give equal bytes.
    """

    def wrap(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            raw = [("" if t is None else t).encode() for t in batch[text]]
            yield batch[list(keep)].assign(n_bytes=[len(r) for r in raw], media=[container(padded(r)) for r in raw])

    small_batches(df.sparkSession)
    types = {f.name: f.dataType.simpleString() for f in df.schema}
    kept = ", ".join(f"`{c}` {types[c]}" for c in keep)
    return exact_ids(df.select(*dict.fromkeys((*keep, text))), wrap, f"{kept}, n_bytes long, media binary", *(c for c in keep if types[c] == "bigint"))


PROBE = (
    "codec string, handler string, timescale long, duration_s double, n_samples long, "
    "keyframes array<struct<start:long,end:long>>, error string"
)


def probe(data: bytes | None, read: bool = False):
    """What ``probed`` adds, for one file: that of its first track; with ``read`` also the track's bytes."""
    none = dict.fromkeys(("codec", "handler", "timescale", "duration_s", "n_samples", "keyframes", "error"))
    if data is None:
        return (none, None) if read else none
    try:
        t = tracks(data := bytes(data))[0]
    except (ValueError, IndexError, struct.error) as e:
        none["error"] = f"{type(e).__name__}: {e}"
        return (none, None) if read else none
    at, size = t["offsets"][t["sync"]], t["sizes"][t["sync"]]
    keys = [{"start": int(a), "end": int(a + s)} for a, s in zip(at, size, strict=True)]
    out = {k: t[k] for k in ("codec", "handler", "timescale", "duration_s")} | {"n_samples": len(t["sizes"]), "keyframes": keys, "error": None}
    return (out, samples(data, t)) if read else out


def probed(df: DataFrame, media: str = "media") -> DataFrame:
    """Adds codec, handler, timescale, duration_s, n_samples, keyframes and error to a column of container bytes.

    All columns are kept but those named like a new one, which are replaced.
    Null media give nulls; bytes that are no container give ``error``.
    """
    new = [c.split()[0] for c in PROBE.split(", ")]
    kept = [c for c in df.columns if c not in new]
    types = {f.name: f.dataType.simpleString() for f in df.schema}

    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [probe(x) for x in batch[media]]
            extra = {c: pd.Series([r[c] for r in found], index=batch.index, dtype="object") for c in new}
            yield batch.assign(**extra).astype({"timescale": "Int64", "n_samples": "Int64", "duration_s": "float64"})

    small_batches(df.sparkSession)
    return exact_ids(df.select(*kept), add, ", ".join(f"`{c}` {types[c]}" for c in kept) + ", " + PROBE, *(c for c in kept if types[c] == "bigint"))


def payloads(df: DataFrame, keep: tuple[str, ...], media: str = "media") -> DataFrame:
    """(keep..., the columns of ``probed``, payload): the first track's samples read back from the stored bytes."""
    new = [c.split()[0] for c in PROBE.split(", ")]
    types = {f.name: f.dataType.simpleString() for f in df.schema}

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            both = [probe(x, True) for x in batch[media]]
            found, back = [r for r, _ in both], [p for _, p in both]
            extra = {c: pd.Series([r[c] for r in found], index=batch.index, dtype="object") for c in new}
            out = batch.assign(**extra, payload=back)[[*keep, *new, "payload"]]
            yield out.astype({"timescale": "Int64", "n_samples": "Int64", "duration_s": "float64"})

    small_batches(df.sparkSession)
    kept = ", ".join(f"`{c}` {types[c]}" for c in keep)
    return exact_ids(df.select(*dict.fromkeys((*keep, media))), read, f"{kept}, {PROBE}, payload binary", *(c for c in keep if types[c] == "bigint"))
