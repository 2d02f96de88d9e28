"""Removal of long repeats by suffix arrays.

Each byte covered by a string of ``length`` bytes that also starts anywhere
else is removed; strings are judged on the input, and never cross texts.

1. Anchors. Every string of that length has in it one least hash of 32 bytes,
   the same wherever the string lies. Only strings whose least hash occurs more
   than once can repeat, so only the stretches around such anchors are looked
   at; nothing that repeats is lost.
2. Shards. Tasks put stretches together to shards of bounded size, build the
   suffix array of each (refined after Larsson and Sadakane) and its common
   prefixes (after Kasai), and mark what repeats inside the shard.
3. Across shards. The suffix arrays are not merged. The strings of one least
   hash, in runs, go from all shards to one place. Runs of equal digests repeat
   as they are; for the others the window hashes of all strings are sorted, and
   strings of equal hashes that the bytes confirm to be equal are marked. Where
   a least hash has very many runs, strings are grouped by their MD5 instead.
4. The marks of a text are put together and its bytes removed.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import exact_ids, shared_dir, small_batches, stored
from .shingles import running
from .suffixes import anchors, heads, intervals, merged, repeated_starts, window_hashes

LENGTH = 200
#: Bytes of an anchor.
WIDTH = 32
#: Bytes of stretches in a shard; a longer text is a shard of its own.
SHARD = 1 << 20
#: Runs of one anchor that are merged in one place; more are parted by their strings.
MOST_RUNS = 20_000


def row_key(docs: DataFrame) -> Column:
    """A digest of id and text. Equal rows share it, and whatever is found for one holds for the other."""
    return F.unhex(F.md5(F.concat_ws(":", F.coalesce(docs["doc_id"].cast("string"), F.lit("null")), F.coalesce(docs["text"], F.lit("")))))


def _bytes(text: str | None) -> np.ndarray:
    return np.frombuffer((text or "").encode(), np.uint8)


def _anchored(rows: DataFrame, length: int, width: int) -> DataFrame:
    """(short, hashes, times): the hashes of a row's anchors and how often each occurs. ``short`` is 64 bits of the row's key, enough to route by."""

    def find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [np.unique(anchors(_bytes(t), length, width)[1].view(np.int64), return_counts=True) for t in batch["text"]]
            some = [len(h) > 0 for h, _ in found]
            hashes, times = ([f[k] for f in found if len(f[0])] for k in (0, 1))
            if hashes:  # pandas gives columns without rows a type that is no list
                yield pd.DataFrame({"short": batch["short"][some], "hashes": hashes, "times": times})

    return rows.select("short", "text").mapInPandas(find, "short long, hashes array<long>, times array<long>")


MARKED = "key binary, starts array<long>, ends array<long>, body binary, runs array<struct<anchor:long,at:int,start:long,n:int>>"


class _Shard:
    """Stretches of texts that are searched together."""

    def __init__(self, length: int, width: int):
        self.length, self.width, self.parts, self.size = length, width, [], 0

    def add(self, key: bytes, text: str | None, wanted: np.ndarray) -> None:
        """Takes the stretches of a text around its repeated anchors."""
        data = _bytes(text)
        least, _ = anchors(data, self.length, self.width)
        if not len(least):
            return
        place = np.minimum(np.searchsorted(wanted, least), len(wanted) - 1)
        first, last = intervals(wanted[place] == least)
        for a, b in zip(first.tolist(), last.tolist(), strict=True):
            stretch = data[a : b - 1 + self.length]
            self.parts.append((key, a, stretch, least[a:b]))
            self.size += len(stretch) + 1

    def marked(self) -> pd.DataFrame:
        """A row for each stretch: what repeats in the shard, and its runs for the merging, equal ones once."""
        if not self.parts:
            return pd.DataFrame(columns=["key", "starts", "ends", "body", "runs"])
        stop = np.array([255], np.uint8)  # no byte of UTF-8
        data = np.concatenate([x for _, _, s, _ in self.parts for x in (s, stop)])
        again, rows, at, seen = repeated_starts(data, self.length), [], 0, set()
        for key, start, stretch, least in self.parts:
            n = len(least)
            first, last = intervals(again[at : at + n])
            starts, ends = merged(first + start, last - 1 + self.length + start)
            change = np.flatnonzero(np.r_[True, least[1:] != least[:-1]])
            raw, runs = stretch.tobytes(), []
            for a, b in zip(change.tolist(), np.r_[change[1:], n].tolist(), strict=True):
                size = b - a - 1 + self.length
                digest = hashlib.blake2b(raw[a : a + size], digest_size=16).digest()
                if digest not in seen:
                    seen.add(digest)
                    runs.append((int(least[a].view(np.int64)), a, a + start, size))
            rows.append((key, starts, ends, raw if runs else b"", runs))
            at += len(stretch) + 1
        self.parts, self.size = [], 0
        return pd.DataFrame(rows, columns=["key", "starts", "ends", "body", "runs"])


def _sharded(rows: DataFrame, length: int, width: int, shard: int) -> DataFrame:
    """The marks of all shards. ``rows`` has key, text and wanted, the repeated anchors of the text."""

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = _Shard(length, width)
        for batch in batches:
            for key, text, wanted in zip(batch["key"], batch["text"], batch["wanted"], strict=True):
                held.add(key, text, np.sort(np.asarray(wanted, np.int64).view(np.uint64)))
                if held.size >= shard:
                    yield held.marked()
        yield held.marked()

    return rows.select("key", "text", "wanted").mapInPandas(search, MARKED)


def _merge(keys: list, starts: np.ndarray, bodies: list[bytes], group: np.ndarray, length: int) -> list[tuple]:
    """(key, start, end) of what repeats in runs of which several share an anchor; ``group`` ascends."""
    digests = np.array([hashlib.blake2b(b, digest_size=16).hexdigest() for b in bodies])
    _, which, times = np.unique(digests, return_inverse=True, return_counts=True)
    out = []
    whole = times[which] > 1
    for i in np.flatnonzero(whole):  # equal runs of several shards
        out.append((keys[i], int(starts[i]), int(starts[i]) + len(bodies[i])))
    # one run of each digest, in groups of several digests
    one = np.zeros(len(bodies), bool)
    one[np.unique(which, return_index=True)[1]] = True
    several = np.bincount(group[one], minlength=group[-1] + 1) > 1
    # a run longer than an anchor's reach may repeat within itself: its shard has seen to that
    use = np.flatnonzero(one & several[group])
    if not len(use):
        return out
    data = np.frombuffer(b"".join(bodies[i] for i in use), np.uint8)
    sizes = np.array([len(bodies[i]) for i in use])
    windows = sizes - length + 1
    offsets = np.cumsum(sizes) - sizes
    at = np.repeat(offsets, windows) + np.arange(windows.sum()) - np.repeat(np.cumsum(windows) - windows, windows)
    run = np.repeat(np.arange(len(use)), windows)
    hashes = window_hashes(running(data), length)[at]
    order = np.argsort(hashes)
    ordered = hashes[order]
    left, right = np.searchsorted(ordered, hashes), np.searchsorted(ordered, hashes, "right")
    like = np.flatnonzero(right - left > 1)
    if not len(like):
        return out
    # strings of equal hashes are held against the first of them, eight bytes at a time
    eight = np.concatenate([heads(data), np.zeros(1, np.uint64)])
    other = at[order[left[like]]]
    same = np.ones(len(like), bool)
    steps = [*range(0, length - 7, 8), *([length - 8] if length % 8 else [])]
    for step in steps:
        same &= eight[at[like] + step] == eight[other + step]
    mark = np.zeros(len(at), bool)
    mark[like[same]] = True
    bounds = np.cumsum(windows)
    for i, (lo, hi) in enumerate(zip(np.r_[0, bounds[:-1]].tolist(), bounds.tolist(), strict=True)):
        if mark[lo:hi].any() and not whole[use[i]]:
            for a, b in zip(*intervals(mark[lo:hi]), strict=True):
                out.append((keys[use[i]], int(starts[use[i]] + a), int(starts[use[i]] + b - 1 + length)))
    del run
    return out


def _merged_shards(runs: DataFrame, length: int) -> DataFrame:
    """(key, start, end): what repeats across shards. ``runs`` has anchor, key, start and body."""

    def merge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest = None
        for batch in batches:
            if rest is not None:
                batch = pd.concat([rest, batch], ignore_index=True)
            full = batch["anchor"] != batch["anchor"].iloc[-1]  # the last group may go on
            rest, batch = batch[~full], batch[full]
            if len(batch) >= 2000 or (len(batch) and len(rest) >= 2000):
                yield done(batch)
            elif len(batch):
                rest = pd.concat([batch, rest], ignore_index=True)
        if rest is not None and len(rest):
            yield done(rest)

    def done(batch: pd.DataFrame) -> pd.DataFrame:
        anchor = batch["anchor"].to_numpy()
        group = np.cumsum(np.r_[True, anchor[1:] != anchor[:-1]]) - 1
        found = _merge(batch["key"].tolist(), batch["start"].to_numpy(), batch["body"].tolist(), group, length)
        return pd.DataFrame(found, columns=["key", "start", "end"])

    dealt = runs.repartition("anchor").sortWithinPartitions("anchor")
    return dealt.mapInPandas(merge, "key binary, start long, end long")


def _parted(runs: DataFrame, length: int) -> DataFrame:
    """The same for anchors of very many runs: a row for each string, counted by digests, so no group meets in one task."""
    each = runs.select("key", "start", "body", F.explode(F.sequence(F.lit(0), F.octet_length("body") - length)).alias("i"))
    each = each.select("key", (F.col("start") + F.col("i")).alias("start"), F.unhex(F.md5(F.substring("body", F.col("i") + 1, F.lit(length)))).alias("digest"))
    often = each.groupBy(F.col("digest").alias("d")).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("d")
    found = each.join(often, F.col("digest") == F.col("d"))
    return found.select("key", "start", (F.col("start") + length).alias("end"))


def repeats(docs: DataFrame, length: int = LENGTH, width: int = WIDTH, shard: int = SHARD, most_runs: int = MOST_RUNS) -> DataFrame:
    """(key, starts, ends): the bytes to be removed, by ``row_key``; rows without any are left out."""
    if length < width + 8:
        raise ValueError("strings must be longer than anchors")
    spark = docs.sparkSession
    small_batches(spark)
    home = shared_dir(spark)
    keyed = docs.select(row_key(docs).alias("key"), docs["text"].alias("text")).where(F.octet_length("text") >= length)
    keyed = keyed.withColumn("short", F.xxhash64("key"))
    found = stored(_anchored(keyed, length, width), f"{home}/anchors")
    each = found.select("short", F.explode(F.arrays_zip("hashes", "times")).alias("a")).select("short", F.col("a.hashes").alias("hash"), F.col("a.times").alias("n"))
    often = each.groupBy(F.col("hash").alias("h")).agg(F.sum("n").alias("n")).where("n > 1").select("h")
    often = stored(often, f"{home}/often")
    wanted = each.select("short", "hash").join(often.hint("merge"), F.col("hash") == F.col("h")).groupBy(F.col("short").alias("s")).agg(F.collect_list("hash").alias("wanted"))
    wanted = stored(wanted, f"{home}/wanted")
    # these tables grow with the corpus: they are never sent to all tasks, so the plan is one at every size
    rows = keyed.join(wanted.hint("merge"), F.col("short") == F.col("s")).select("key", "text", "wanted")
    marks = stored(_sharded(rows, length, width, shard), f"{home}/marks")

    runs = marks.select("key", "body", F.explode("runs").alias("r"))
    runs = runs.select("key", F.col("r.anchor").alias("anchor"), F.col("r.start").alias("start"), F.substring("body", F.col("r.at") + 1, F.col("r.n")).alias("body"))
    counts = marks.select(F.explode("runs.anchor").alias("a")).groupBy("a").agg(F.count(F.lit(1)).alias("n"))
    many = stored(counts.where(F.col("n") > most_runs).select("a"), f"{home}/many")
    if many.isEmpty():
        across = _merged_shards(runs, length)
    else:
        here = F.col("anchor") == F.col("a")
        across = _merged_shards(runs.join(many, here, "left_anti"), length).unionByName(_parted(runs.join(many, here, "left_semi"), length))
    inside = marks.select("key", F.explode(F.arrays_zip("starts", "ends")).alias("i")).select("key", F.col("i.starts").alias("start"), F.col("i.ends").alias("end"))
    both = inside.unionByName(across).groupBy("key").agg(F.collect_set(F.struct("start", "end")).alias("spans"))
    return stored(both.select("key", "spans.start", "spans.end").toDF("key", "starts", "ends"), f"{home}/repeats")


def deduplicated(docs: DataFrame, length: int = LENGTH, **options) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept, starts, ends), one row for each row of ``docs`` (doc_id, text).

    ``kept`` is what is left, as bytes: a cut may fall inside a character.
    ``starts`` and ``ends`` are the removed runs. Null counts as empty; texts
    shorter than ``length`` bytes lose nothing; a row that occurs twice loses
    all that is long enough, in both its places. Other columns are not read.
    """
    found = repeats(docs.select("doc_id", "text"), length, **options).withColumnRenamed("key", "k")
    rows = docs.select("doc_id", "text")
    rows = rows.select("doc_id", "text", row_key(rows).alias("key")).join(found.hint("merge"), F.col("key") == F.col("k"), "left").drop("key", "k")

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for text, starts, ends in zip(batch["text"], batch["starts"], batch["ends"], strict=True):
                raw = (text or "").encode()
                a, b = (np.empty(0, np.int64),) * 2 if starts is None else merged(np.asarray(starts), np.asarray(ends))
                edges = [0, *np.stack([a, b], 1).ravel().tolist(), len(raw)]
                kept = b"".join(raw[x:y] for x, y in zip(edges[::2], edges[1::2], strict=True))
                out.append((len(raw), int((b - a).sum()), len(a), kept, a, b))
            made = pd.DataFrame(out, columns=["n_bytes", "n_removed", "n_spans", "kept", "starts", "ends"], index=batch.index)
            yield pd.concat([batch["doc_id"], made], axis=1)

    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary, starts array<long>, ends array<long>"
    return exact_ids(rows.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "starts", "ends"), cut, schema, "doc_id")
