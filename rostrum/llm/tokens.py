"""Token ids in a content-addressed store.

Documents are encoded, and a rolling hash over each id stream cuts it into
chunks where the content says so, so equal passages give equal chunks. A chunk
is stored once, under the SHA-256 of its bytes, in a pack file; a document is a
recipe, the list of its chunks; Merkle trees over chunks, documents and runs of
documents let a reader verify whatever part it reads.

Layout below one folder of the shared store:

* ``packs/``: files of chunks end to end, ids as little-endian unsigned 16-bit
  integers (32-bit for vocabularies above 65,536);
* ``index/``: Parquet (digest, pack, off, n): where each chunk is;
* ``recipes/``: Parquet (doc_id, start, n_tokens, root, home, chunks) in
  ascending order of doc_id, ``start`` being the ids of all documents before;
* ``manifest/``: Parquet (level, node, root): the Merkle tree above documents,
  each with its doc_id, start and n_tokens.
"""

from __future__ import annotations

import functools
import hashlib
import itertools
import json
import os
import re
import string
import threading
import time
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import batches_of, exact_ids, in_order, remove, shared_dir, small_batches, stored
from .files import FrameWriter, frames, open_in, open_out, own_name

END_ID = 2
#: Ids in a chunk: at least, about, at most.
LEAST, ABOUT, MOST = 256, 1024, 8192
WINDOW = 8
#: Tokens of a run of documents, and nodes below a node, as powers of two.
RUN_BITS, NODE_BITS = 20, 10


@functools.cache
def _tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallelism
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


#: Marks after a word. An apostrophe may belong to what follows it.
MARKS = string.punctuation.replace("'", "")


class Encoder:
    """Encodes texts by the pieces between spaces, each distinct piece once.

    A byte-level tokenizer that splits before a space which follows other than
    white space gives the same ids for a text as for its pieces, one after
    another; so a piece that recurs, in any text of the worker, costs a look-up.
    With a tokenizer whose file says otherwise whole texts are encoded.
    """

    def __init__(self, path: str, most_pieces: int = 1_000_000):
        self.tokenizer, self.most = _tokenizer(path), most_pieces
        spec = json.loads(self.tokenizer.to_str())
        before = spec.get("pre_tokenizer") or {}
        self.by_pieces = not spec.get("normalizer") and (before.get("type"), before.get("add_prefix_space"), before.get("use_regex", True)) == ("ByteLevel", False, True)
        self.bytes_of = np.zeros(self.tokenizer.get_vocab_size(), np.int64)
        for token, n in self.tokenizer.get_vocab().items():
            self.bytes_of[n] = len(token)  # a character of a byte-level token is a byte
        for n, token in self.tokenizer.get_added_tokens_decoder().items():
            self.bytes_of[n] = len(token.content.encode())
        self.marks: dict[str, np.ndarray] = {}
        self.lock, self.used_at = threading.Lock(), 0.0
        self._forget()

    def _forget(self):
        self.known, self.n_known, self.ids, self.used = {}, 0, np.empty(1 << 16, np.uint32), 0
        self.start, self.size, self.edgy = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int64), np.zeros(1 << 16, bool)

    def _learn(self, pieces: list) -> None:
        """Encodes pieces that are new, which have the last numbers: those that can't touch their neighbours in long lines, the others one by one.

        A piece is a string that a space came before, or that begins with a
        line break, or a tuple of one that is encoded as it stands. Letters
        with marks at the end are those letters and the marks, for the
        tokenizer splits between them; letters not met before join the pieces.
        """
        known, new, encode = self.known, self.n_known - len(pieces), functools.partial(self.tokenizer.encode_batch_fast, add_special_tokens=False)
        plain, lines, rest, edgy, stopped = [], [], [], [], []
        for i, p in enumerate(pieces):
            if type(p) is tuple:
                rest.append(i)
                if not p[0] or p[0][-1].isspace():
                    edgy.append(new + i)
            elif p.isalpha():
                plain.append(i)
            elif p[1:] and p[0] == "\n" and not p[1].isspace() and not p[-1].isspace():
                lines.append(i)
            elif not p or p[0].isspace() or p[-1].isspace():
                rest.append(i)
                edgy.append(new + i)
            elif (word := p.rstrip(MARKS)) != p and word.isalpha():
                if (base := known.get(word)) is None:
                    known[word] = base = new + len(pieces)
                    pieces.append(word)  # which this loop comes to yet
                stopped.append((i, base, p[len(word) :]))
            else:
                plain.append(i)
        self.n_known = n = new + len(pieces)
        while n > len(self.start):
            self.start, self.size, self.edgy = (np.concatenate([x, x]) for x in (self.start, self.size, self.edgy))
        self.edgy[new:n] = False
        self.edgy[edgy] = True
        for group, k in [(g, k) for g in (plain, lines) for k in range(0, len(g), 500)]:
            part, space = group[k : k + 500], " " if group is plain else ""
            words = [pieces[i] for i in part]
            ids = np.asarray(encode([space + space.join(words)])[0].ids, np.uint32)
            ends = np.cumsum(self.bytes_of[ids])
            wanted = np.cumsum([len(w.encode()) + len(space) for w in words])
            cut = np.searchsorted(ends, wanted) + 1
            if not np.array_equal(ends[cut - 1], wanted):
                raise ValueError("the tokenizer joins pieces: it doesn't split before spaces")
            self._put(new + np.asarray(part), np.diff(cut, prepend=0), ids)
        if rest:
            found = [e.ids for e in encode([p[0] if type(p) is tuple else f" {p}" for p in (pieces[i] for i in rest)])]
            flat = np.fromiter(itertools.chain.from_iterable(found), np.uint32)
            self._put(new + np.asarray(rest), np.asarray([len(x) for x in found]), flat)
        if stopped:
            base = np.array([b for _, b, _ in stopped])
            for mark in {m for *_, m in stopped} - self.marks.keys():
                self.marks[mark] = np.asarray(encode([mark])[0].ids, np.uint32)
            last = [self.marks[m] for *_, m in stopped]
            added = np.fromiter(map(len, last), np.int64, len(last))
            sizes = self.size[base] + added
            flat = np.empty(sizes.sum(), np.uint32)
            ends = np.cumsum(sizes)
            flat[self._places(ends - sizes, self.size[base])] = self.ids[self._places(self.start[base], self.size[base])]
            flat[self._places(ends - added, added)] = np.concatenate(last)
            self._put(new + np.array([i for i, *_ in stopped]), sizes, flat)

    @staticmethod
    def _places(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """start, start + 1 and so on, ``size`` of them, for each."""
        ends = np.cumsum(sizes)
        return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - sizes), sizes)

    def _put(self, places: np.ndarray, sizes: np.ndarray, ids: np.ndarray) -> None:
        while self.used + len(ids) + 1 > len(self.ids):  # one more, for a look one past the last
            self.ids = np.concatenate([self.ids, self.ids])
        self.ids[self.used : self.used + len(ids)] = ids
        self.start[places], self.size[places] = self.used + np.cumsum(sizes) - sizes, sizes
        self.used += len(ids)

    def _look_up(self, pieces: list) -> np.ndarray:
        """The numbers of pieces; those not met before get the next ones and are learned."""
        which = np.fromiter(map(self.known.get, pieces, itertools.repeat(-1)), np.int64, len(pieces))
        new = np.flatnonzero(which < 0)
        if len(new):
            fresh = [pieces[i] for i in new.tolist()]
            which[new] = np.arange(self.n_known, self.n_known + len(fresh))
            self.known.update(zip(fresh, which[new].tolist(), strict=True))
            self.n_known += len(fresh)
            self._learn(fresh)
        return which

    def _careful(self, text: str) -> np.ndarray:
        """The same for one text in which white space meets spaces: a run of it is cut only before all of it."""
        if not text:
            return np.empty(0, np.uint32)
        cut = re.split(r"(?<=\S)(?= )", text)
        which = self._look_up([(x,) for x in cut])
        return self.ids[self._places(self.start[which], self.size[which])]

    def flat(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, one after another; how many each has)."""
        with self.lock:
            self.used_at = time.monotonic()
            if self.n_known > self.most:
                self._forget()
            return (self._flat if self.by_pieces else self._whole)(texts) if len(texts) else (np.empty(0, np.uint32), np.empty(0, np.int64))

    def forget_when_idle(self, seconds: float) -> None:
        """Frees what was learned once no text has come for some time: an idle worker holds no memory that others need."""

        def watch() -> None:
            while True:
                time.sleep(seconds)
                with self.lock:
                    if self.known and time.monotonic() - self.used_at > seconds:
                        self._forget()

        threading.Thread(target=watch, daemon=True).start()

    def _whole(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        found = [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        return np.fromiter(itertools.chain.from_iterable(found), np.uint32), np.array([len(x) for x in found], np.int64)

    def _flat(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        # a line break begins a piece too, if no white space is beside it
        cut = pc.split_pattern(pc.replace_substring(pa.array(texts, pa.large_string()), "\n", " \n"), " ")
        first, flat = np.asarray(cut.offsets)[:-1], cut.values
        coded = flat.dictionary_encode()
        found = self._look_up(coded.dictionary.to_numpy(zero_copy_only=False).tolist())
        which = found[np.asarray(coded.indices)]
        which[first] = self._look_up([(x,) for x in flat.take(pa.array(first)).to_pylist()])
        sizes = self.size[which]
        ids = self.ids[self._places(self.start[which], sizes)]
        counts = np.add.reduceat(sizes, first)
        odd = np.flatnonzero(np.logical_or.reduceat(self.edgy[which], first))
        if len(odd):
            each = np.split(ids, np.cumsum(counts)[:-1])
            for i in odd:
                each[i] = self._careful(texts[i])
                counts[i] = len(each[i])
            ids = np.concatenate(each)
        return ids, counts

    def __call__(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text."""
        ids, counts = self.flat(texts)
        return np.split(ids, np.cumsum(counts)[:-1]) if len(texts) else []


@functools.cache
def _encoder(path: str) -> Encoder:
    """One for each worker: what it has learned serves later tasks too."""
    encoder = Encoder(path)
    encoder.forget_when_idle(5.0)
    return encoder


def cut_all(ids: np.ndarray, sizes: np.ndarray, least: int = LEAST, about: int = ABOUT, most: int = MOST) -> list[list[int]]:
    """Ends of the chunks of id streams that lie one after another, each stream's in the places of all.

    A chunk ends where the hash of the last ``WINDOW`` ids of its stream falls
    in one of ``about`` classes, ``least`` ids after the last cut at the
    earliest and ``most`` at the latest.
    """
    ends = np.cumsum(sizes)
    starts = ends - sizes
    hits = np.empty(0, np.int64)
    if len(ids) > least:
        mixed = (ids.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
        mixed ^= mixed >> np.uint64(29)
        rolling = mixed[: len(ids) - WINDOW + 1].copy()
        for k in range(1, WINDOW):
            rolling *= np.uint64(0xD6E8FEB86659FD93)
            rolling += mixed[k : len(ids) - WINDOW + 1 + k]
        hits = np.flatnonzero((rolling >> np.uint64(40)) % np.uint64(about) == 0) + WINDOW
    # cuts that leave a chunk of its least size before them
    low, high = np.searchsorted(hits, starts + least), np.searchsorted(hits, ends)
    out = []
    for start, end, a, b in zip(starts.tolist(), ends.tolist(), low.tolist(), high.tolist(), strict=True):
        cuts, last = [], start
        for p in hits[a:b].tolist() if a < b else ():
            while p - last > most:
                last += most
                cuts.append(last)
            if p - last >= least:
                cuts.append(last := p)
        while end - last > most:
            last += most
            cuts.append(last)
        out.append([*cuts, end])
    return out


def cut_points(ids: np.ndarray, least: int = LEAST, about: int = ABOUT, most: int = MOST) -> list[int]:
    """Ends of the chunks of one id stream."""
    return cut_all(ids, np.array([len(ids)]), least, about, most)[0]


def merkle(digests: list[bytes]) -> bytes:
    """The root over digests: pairs are hashed together, an odd last one moves up; none give the hash of nothing."""
    level = digests or [hashlib.sha256(b"").digest()]
    while len(level) > 1:
        up = [hashlib.sha256(a + b).digest() for a, b in zip(level[::2], level[1::2], strict=False)]
        level = up + level[len(level) // 2 * 2 :]
    return level[0]


@dataclass(frozen=True)
class Store:
    """The parts of a store, as tables."""

    path: str
    index: DataFrame
    recipes: DataFrame
    manifest: DataFrame


SPOOLED = "doc_id long, row long, n_tokens long, root binary, pack string, digests array<binary>, sizes array<int>, offs array<long>"


def _spool(docs: DataFrame, path: str, tokenizer: str, end_id: int, kind: str) -> DataFrame:
    """Encodes and cuts; each task writes the chunks that are new to it to a compressed spool of its own."""

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder, name, seen = _encoder(tokenizer), own_name(f"{path}/spool/pack", ".zst"), set()
        out, row = None, 0
        for batch in batches:
            rows, last, (found, counts) = [], 0, encoder.flat(["" if t is None else t for t in batch["text"]])
            ids = np.insert(found, np.cumsum(counts), np.uint32(end_id)).astype(kind)
            data, width = memoryview(ids.tobytes()), ids.itemsize
            for doc_id, n, ends in zip(batch["doc_id"], (counts + 1).tolist(), cut_all(ids, counts + 1), strict=True):
                digests, sizes, offs = [], [], []
                for end in ends:
                    chunk, last = data[last * width : end * width], end
                    digest = hashlib.sha256(chunk).digest()
                    digests.append(digest)
                    sizes.append(len(chunk))
                    out = out or FrameWriter(name)
                    offs.append(-1 if digest in seen else out.size)
                    if digest not in seen:
                        seen.add(digest)
                        out.write(chunk)
                rows.append((doc_id, row, n, merkle(digests), name, digests, sizes, offs))
                row += 1
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in SPOOLED.split(", ")])
        if out is not None:
            out.close()

    with batches_of(docs.sparkSession, 1024):
        made = exact_ids(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), encode, SPOOLED, "doc_id")
        return stored(made, f"{path}/spooled")


def _packed(spooled: DataFrame, path: str) -> DataFrame:
    """Chooses an owner for each chunk and writes the packs of chunks that are owned: (digest, pack, off, n)."""
    each = spooled.select("pack", F.explode(F.arrays_zip("digests", "sizes", "offs")).alias("c")).where("c.offs >= 0")
    place = F.struct("pack", F.col("c.offs").alias("off"), F.col("c.sizes").alias("n"))
    owner = each.groupBy(F.col("c.digests").alias("digest")).agg(F.min(place).alias("at")).select("digest", "at.*")

    def pack(chunks: pd.DataFrame) -> pd.DataFrame:
        """One task's spool: as many chunks as one task's input gave."""
        chunks = chunks.sort_values("off", ignore_index=True)
        source = chunks["pack"][0]
        name = own_name(f"{path}/packs/{source.rpartition('/')[2].removesuffix('.zst')}", ".bin")
        with open_out(name) as out:
            spool, held, base, places = frames(source), b"", 0, []
            for off, n in zip(chunks["off"].tolist(), chunks["n"].tolist(), strict=True):
                while base + len(held) < off + n:
                    past = min(len(held), off - base)  # places ascend: what lies before is done with
                    held, base = held[past:] + next(spool), base + past
                places.append(out.tell())
                out.write(held[off - base : off - base + n])
        return chunks.assign(pack=name, off=places)[["digest", "pack", "off", "n"]]

    return stored(owner.groupBy("pack").applyInPandas(pack, "digest binary, pack string, off long, n int"), f"{path}/index")


def _leaves(recipes: DataFrame) -> DataFrame:
    """What the manifest is made over, (level, node, place, root): a digest of each document's id, place, length and root."""
    said = F.concat_ws(" ", F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), "start", "n_tokens", F.hex("root"))
    node = F.shiftright("start", RUN_BITS).alias("node")
    return recipes.select(F.lit(0).alias("level"), node, F.col("start").alias("place"), F.unhex(F.sha2(said, 256)).alias("root"))


def _above(nodes: DataFrame) -> DataFrame:
    """Nodes as what the next level is made over."""
    return nodes.select(F.col("level") + 1, F.shiftright("node", NODE_BITS), F.col("node"), F.col("root")).toDF("level", "node", "place", "root")


def _folded(rows: DataFrame) -> DataFrame:
    """(level, node, root): the root of each node over its rows, in the order of their places."""

    def root(nodes: pd.DataFrame) -> pd.DataFrame:
        nodes = nodes.sort_values("place")
        return nodes.iloc[:1][["level", "node"]].assign(root=[merkle([bytes(r) for r in nodes["root"]])])

    return rows.groupBy("level", "node").applyInPandas(root, "level int, node long, root binary")


def _manifest(recipes: DataFrame, path: str) -> DataFrame:
    """The Merkle tree over documents: level 0 has a node for each run of about a million tokens, the last level one."""
    rows, levels = _leaves(recipes), []
    while True:
        levels.append(stored(_folded(rows), f"{path}/manifest/level={len(levels)}"))
        if levels[-1].count() <= 1:
            break
        rows = _above(levels[-1])
    return functools.reduce(DataFrame.unionByName, levels)


def _hold_against_manifest(store: Store) -> None:
    """Fails where a node of the manifest isn't that of the recipes or nodes below it, or where one of the two is missing."""
    manifest = store.manifest.select("level", "node", "root")
    sizes = {r["level"]: r["count"] for r in manifest.groupBy("level").count().collect()}  # a few levels
    top = max(sizes, default=0)
    if sizes.get(top, 0) > 1:
        raise ValueError(f"the manifest has no level above {top}, or a node twice")
    made = _folded(_leaves(store.recipes).unionByName(_above(manifest.where(F.col("level") < top))))
    kept = manifest.toDF("of_level", "of_node", "of_root")
    both = made.join(kept, (F.col("level") == F.col("of_level")) & (F.col("node") == F.col("of_node")), "full")
    wrong = both.where(~F.col("root").eqNullSafe(F.col("of_root"))).select(F.coalesce("level", "of_level"), F.coalesce("node", "of_node")).head()
    if wrong:
        raise ValueError(f"the recipes don't match the manifest at level {wrong[0]}, node {wrong[1]}")


def write_store(docs: DataFrame, tokenizer: str, path: str | None = None, end_id: int = END_ID) -> Store:
    """Encodes each whole text of ``docs`` (doc_id, text), appends ``end_id``, and stores the ids.

    ``tokenizer`` is the path of a byte-level tokenizer's file; no special
    tokens are added. A null text counts as empty: ``end_id`` alone. Documents
    lie in ascending order of doc_id, nulls first; those that tie are ordered
    by length and root, so repeated rows follow one another. Other columns are
    not read. No rows give an empty store.

    Only digests and places are shuffled: chunk bytes go from the task that
    made them to its spool, and from there to its pack.
    """
    path = path or shared_dir(docs.sparkSession)
    kind = "<u2" if max(_tokenizer(tokenizer).get_vocab_size(), end_id + 1) <= 1 << 16 else "<u4"
    spooled = _spool(docs, path, tokenizer, end_id, kind)
    index = _packed(spooled, path)
    remove(docs.sparkSession, f"{path}/spool")

    parts = spooled.select("pack", "row", F.posexplode("digests").alias("i", "digest"))
    places = index.select(F.col("digest").alias("d"), F.col("pack").alias("in_pack"), "off", "n")
    parts = parts.join(places, F.col("digest") == F.col("d"))
    chunk = F.struct("i", "digest", F.col("in_pack").alias("pack"), "off", "n")
    lists = parts.groupBy(F.col("pack").alias("home"), F.col("row").alias("of")).agg(F.array_sort(F.collect_list(chunk)).alias("chunks"))
    heads = spooled.select("doc_id", "n_tokens", "root", "pack", "row")
    recipes = heads.join(lists, (F.col("home") == F.col("pack")) & (F.col("of") == F.col("row"))).drop("pack", "of")
    order = [F.col("doc_id"), F.col("n_tokens"), F.col("root"), F.col("home"), F.col("row")]
    recipes = in_order(recipes, f"{path}/ordered", order, {"start": F.col("n_tokens")}).drop("row")
    recipes = stored(recipes.repartitionByRange("start").sortWithinPartitions("start"), f"{path}/recipes")
    remove(docs.sparkSession, f"{path}/ordered")
    remove(docs.sparkSession, f"{path}/spooled")
    return Store(path, index, recipes, _manifest(recipes, path))


class _Reader:
    """Chunks by place: a home pack is read whole and kept, chunks of other packs one by one."""

    def __init__(self):
        self.name, self.data, self.files, self.kept = None, b"", {}, {}

    def turn(self, home: str | None):
        if home != self.name:
            self.name, self.data = home, b""

    def __call__(self, c) -> bytes:
        if c["pack"] == self.name:
            return self.data[c["off"] : c["off"] + c["n"]]
        if (key := bytes(c["digest"])) not in self.kept:
            if len(self.kept) >= 4096:
                self.kept.clear()
            if c["pack"] not in self.files:
                if len(self.files) >= 64:
                    self.files.popitem()[1].close()
                self.files[c["pack"]] = open_in(c["pack"])
            self.kept[key] = self.files[c["pack"]].read_at(c["n"], c["off"])
        return self.kept[key]

    def load(self):
        with open_in(self.name) as f:
            self.data = f.read()


def read_store(store: Store, ids: bool = False) -> DataFrame:
    """The documents of a store, put together from their chunks: doc_id, start, n_tokens, ids_crc32 (and ids).

    The recipes are held against the manifest first, every chunk against its
    digest and every document against its Merkle root; damage fails the job, as
    do recipes that are lost, doubled or changed. A document's bytes and number
    of ids tell the width that they are stored in, 2 or 4. ``ids_crc32`` is that
    of the ids as little-endian unsigned 32-bit integers. A task reads the packs that
    its documents come from in one go, since documents are dealt by home pack;
    those whose home task owns no chunk have none and are dealt by their place.
    """
    _hold_against_manifest(store)
    packs = store.index.select("pack").distinct().select(F.regexp_extract("pack", r"pack-\d+-\d+", 0).alias("stem"), F.col("pack").alias("main"))
    recipes = store.recipes.withColumn("stem", F.regexp_extract("home", r"pack-\d+-\d+", 0))
    recipes = recipes.join(packs, "stem", "left").drop("stem", "home")

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fetch = _Reader()
        for batch in batches:
            rows = []
            for doc_id, start, n_tokens, root, main, chunks in zip(*(batch[c] for c in ("doc_id", "start", "n_tokens", "root", "main", "chunks")), strict=True):
                if main is not None and main != fetch.name:
                    fetch.turn(main)
                    fetch.load()
                crc, found, parts = 0, [], []
                width, rest = divmod(sum(c["n"] for c in chunks), n_tokens)
                if rest or width not in (2, 4):
                    raise ValueError(f"document {doc_id} has {n_tokens} ids in chunks of another size")
                for c in chunks:
                    data = fetch(c)
                    found.append(hashlib.sha256(data).digest())
                    if found[-1] != bytes(c["digest"]):
                        raise ValueError(f"chunk {bytes(c['digest']).hex()} is damaged in {c['pack']}")
                    values = np.frombuffer(data, f"<u{width}").astype("<u4")
                    crc = zlib.crc32(values.tobytes(), crc)
                    parts.append(values)
                if merkle(found) != bytes(root):
                    raise ValueError(f"document {doc_id} doesn't match its root")
                rows.append((doc_id, start, n_tokens, crc, np.concatenate(parts).astype(np.int64) if ids else None))
            out = pd.DataFrame(rows, columns=["doc_id", "start", "n_tokens", "ids_crc32", "ids"])
            yield out if ids else out.drop(columns="ids")

    small_batches(store.recipes.sparkSession)
    dealt = recipes.repartition(F.coalesce("main", F.xxhash64("start").cast("string"))).sortWithinPartitions("main", "start")
    return exact_ids(dealt, read, "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<long>" * ids, "doc_id")


def documents_of(spark: SparkSession, path: str) -> Store:
    """A store that was written before."""
    read = spark.read.parquet
    return Store(path, read(f"{path}/index"), read(f"{path}/recipes"), read(f"{path}/manifest"))
