"""Texts as numbers of words, worked on in pieces of some megabytes by NumPy and Arrow: no row, object or lambda for a word.

``coded(file)``: a file of the shared folder for each piece. It has the distinct
lower-cased words of some texts, and numbers: which words stand one after the
other, and -1 where a sentence ends. Pairs of words are as in
``collocation.pairs``. What a task has to look up lies in tables that it reads a
block at a time, so none has to fit into a task.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from functools import cache, lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import dataset, fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import shared_dir, stored

#: Bytes of texts that are scanned at once, but for longer texts, and of numbers in a piece; rows of a batch that is handed on, and of a table that are held at once.
BLOCK, PIECE, ROWS, HELD = 1 << 20, 16 << 20, 1 << 17, 16 << 20
#: Leading bits of digests by which these are dealt out.
DEALT = 12
Words = tuple[pa.Array, np.ndarray]  # distinct words and numbers

_FIRST = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
_BLANK = np.uint8(ord(" "))
_FACTOR = np.uint64(0x9E3779B97F4A7C17)
_SEEDS = np.uint64(0x243F6A8885A308D3), np.uint64(0x13198A2E03707344)


@cache
def _letters(spark: SparkSession) -> bytes:
    """A bit for each character, set for what the JVM's expressions take for a letter."""
    known = "".join(map(chr, (*range(0xD800), *range(0xE000, 0x110000))))
    others = spark.sparkContext._jvm.java.util.regex.Pattern.compile(r"\p{L}++").matcher(known).replaceAll("")
    out = np.ones(0x110000, bool)
    out[0xD800:0xE000] = False
    out[np.frombuffer(others.encode("utf-32-le"), np.uint32)] = False
    return np.packbits(out).tobytes()


def coded(docs: DataFrame, text: str = "text") -> DataFrame:
    """(file) of texts; words are runs of letters, and null has none."""
    packed = _letters(docs.sparkSession)
    rows = docs.select(F.lower(F.col(text)).alias("text")).where(F.col("text").isNotNull())

    def made(batches):
        letters = np.unpackbits(np.frombuffer(packed, np.uint8)).astype(bool)
        held, size = [], 0
        for batch in batches:
            bounds, data = _bytes(batch["text"].cast(pa.large_string()))
            for low, high in _blocks(bounds):
                held.append(_coded(data[bounds[low] : bounds[high]], bounds[low : high + 1] - bounds[low], letters))
                size += held[-1][1].nbytes
                if size >= PIECE:
                    yield _merged(held)
                    held, size = [], 0
        yield _merged(held)

    return _written(rows, made)


def _written(rows: DataFrame, made: Callable[[Iterator[pa.RecordBatch]], Iterator[Words]]) -> DataFrame:
    """(file) of what is ``made`` of the rows; a file counts once the table that names it is written."""
    folder = shared_dir(rows.sparkSession)

    def run(batches):
        store, inner = fs.FileSystem.from_uri(f"{folder}/pieces")
        store.create_dir(inner, recursive=True)
        for words, numbers in made(batches):
            if len(numbers):
                name = uuid.uuid4().hex  # no other attempt of any task has it
                lists = [pa.LargeListArray.from_arrays(pa.array([0, len(x)], pa.int64()), x) for x in (words, pa.array(numbers))]
                batch = pa.RecordBatch.from_arrays(lists, ["words", "numbers"])
                with store.open_output_stream(f"{inner}/{name}", compression=None) as out, pa.ipc.new_file(out, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as writer:
                    writer.write_batch(batch)
                yield pa.RecordBatch.from_pydict({"file": [f"{folder}/pieces/{name}"]})

    files = stored(rows.mapInArrow(run, "file string"))
    return files.repartition(max(1, files.count()))  # a piece a task


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[Words]:
    for batch in batches:
        for path in batch["file"].to_pylist():
            store, inner = fs.FileSystem.from_uri(path)
            with store.open_input_file(inner) as f:
                row = pa.ipc.open_file(f).get_batch(0)
                yield row["words"].flatten(), row["numbers"].flatten().to_numpy()


def _merged(parts: list[Words]) -> Words:
    """One piece of several, one after the other."""
    words = pa.concat_arrays([pa.array([], pa.large_string()), *(p[0] for p in parts)])
    at, data = _bytes(words)
    words, number = _distinct(data, at[:-1], at[1:])
    number = np.split(number, np.cumsum([len(p[0]) for p in parts])[:-1])
    return words, np.concatenate([np.empty(0, np.int32), *(np.append(n, np.int32(-1))[p[1]] for n, p in zip(number, parts, strict=False))])  # -1 stays what it is


def _coded(data: np.ndarray, bounds: np.ndarray, letters: np.ndarray) -> Words:
    """The distinct words of lower-cased texts, and numbers."""
    inside = letters[:256][data] & (data < 0x80)
    if len(lead := np.flatnonzero(data >= 0xC0)):
        padded = np.append(data, np.zeros(3, np.uint8))
        b = [padded[lead + k].astype(np.int32) for k in range(4)]
        low = [x & 0x3F for x in b]
        two, three = (b[0] & 0x1F) << 6 | low[1], (b[0] & 0x0F) << 12 | low[1] << 6 | low[2]
        code = np.where(b[0] < 0xE0, two, np.where(b[0] < 0xF0, three, (b[0] & 0x07) << 18 | low[1] << 12 | low[2] << 6 | low[3]))
        lead, size = lead[hit := letters[code]], 2 + (b[0] >= 0xE0)[hit].astype(np.int8) + (b[0] >= 0xF0)[hit]
        for k in range(4):
            inside[lead[size > k] + k] = True
    ends_here = (data == ord(".")) | (data == ord("!")) | (data == ord("?"))
    before, after = np.zeros(len(inside), bool), np.zeros(len(inside), bool)
    before[1:], after[:-1] = inside[:-1], inside[1:]
    edges = bounds[(bounds > 0) & (bounds < len(data))]
    before[edges], after[edges - 1], ends_here[edges] = False, False, True
    start, end = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1
    words, ids = _distinct(data, start, end)
    sentence = np.cumsum(ends_here, dtype=np.int32)[start]
    last = np.r_[sentence[1:] != sentence[:-1], np.ones(min(1, len(start)), bool)]
    out = np.full(len(ids) + last.sum(), -1, np.int32)
    out[np.arange(len(ids)) + np.cumsum(last) - last] = ids
    return words, out


def _distinct(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """The distinct words and which of them stands where; words of up to 8 bytes are told apart by these as numbers."""
    size = end - start
    short, long = np.flatnonzero(size <= 8), np.flatnonzero(size > 8)
    codes = np.ndarray(len(data), "<u8", np.append(data, np.zeros(8, np.uint8)), 0, (1,))[start[short]] & _FIRST[size[short]]
    a = pa.array(codes).dictionary_encode()
    offsets = np.r_[0, np.cumsum(size[long])]
    b = _strings(offsets, data[np.repeat(start[long] - offsets[:-1], size[long]) + np.arange(offsets[-1])]).dictionary_encode()
    spelt = a.dictionary.to_numpy().view(np.uint8).reshape(-1, 8)
    spelt = _strings(np.r_[0, np.cumsum((spelt > 0).sum(axis=1))], spelt[spelt > 0])
    ids = np.empty(len(start), np.int32)
    ids[short], ids[long] = a.indices.to_numpy(), b.indices.to_numpy() + np.int32(len(spelt))
    return pa.concat_arrays([spelt, b.dictionary]), ids


def _bytes(strings: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Where each string begins, and the last ends, and the bytes of all."""
    at = np.frombuffer(strings.buffers()[1], np.int64)[strings.offset : strings.offset + len(strings) + 1]
    return at - at[0], np.frombuffer(strings.buffers()[2] or b"", np.uint8)[at[0] : at[-1]]


def _blocks(bounds: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of texts that have up to ``BLOCK`` bytes together, or of one text: what is scanned should fit a cache."""
    low = 0
    while low < len(bounds) - 1:
        high = max(low + 1, int(np.searchsorted(bounds, bounds[low] + BLOCK)))
        high = min(high, len(bounds) - 1)
        yield low, high
        low = high


def _strings(offsets: np.ndarray, data: np.ndarray) -> pa.Array:
    return pa.LargeStringArray.from_buffers(len(offsets) - 1, pa.py_buffer(np.ascontiguousarray(offsets, np.int64)), pa.py_buffer(data))


def digests(strings: pa.Array) -> np.ndarray:
    """Two numbers of 64 bits for each string, none of which is empty: sums of a random number for each byte at its place (tabulation)."""
    strings = strings.cast(pa.large_string())
    at = np.frombuffer(strings.buffers()[1], np.int64)[strings.offset : strings.offset + len(strings) + 1]
    out = np.empty((len(strings), 2), np.uint64)
    if len(strings):
        data = np.frombuffer(strings.buffers()[2], np.uint8)[at[0] : at[-1]]
        place = np.arange(len(data), dtype=np.uint64) - np.repeat(at[:-1] - at[0], np.diff(at)).astype(np.uint64)
        place = (place << np.uint64(8)) | data
        for k, seed in enumerate(_SEEDS):
            x = place * _FACTOR + seed  # splitmix64
            x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
            x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
            out[:, k] = np.add.reduceat(x ^ (x >> np.uint64(31)), at[:-1] - at[0])
    return out


class Piece:
    """Distinct ``words``, and ``ids``, which of them stands where.

    The pair at place k is of the words at ``i[k]`` and ``j[k]``; ``key`` says
    which of ``words`` begins it and which of ``rests`` it goes on with: a word, or
    connectors and a word.
    """

    def __init__(self, words: pa.Array, numbers: np.ndarray, connectors: tuple[str, ...] = ()):
        self.words, self.raw, self.at = words, numbers, np.flatnonzero(numbers >= 0)
        self.ids, sentence = numbers[self.at], np.cumsum(numbers < 0, dtype=np.int32)[self.at]
        joins = pc.is_in(self.words, value_set=pa.array(connectors, pa.large_string())).to_numpy(zero_copy_only=False)
        places = np.flatnonzero(~joins[self.ids])
        sentence = sentence[places]
        together = sentence[:-1] == sentence[1:]
        self.i, self.j = places[:-1][together], places[1:][together]
        rest = self.ids[self.j].astype(np.int64)
        self.rests = self.words
        if len(far := np.flatnonzero(self.j - self.i > 1)):
            size = (self.j - self.i)[far]
            offsets = np.r_[0, np.cumsum(size)]
            several = self.words.take(pa.array(self.ids[np.repeat(self.i[far] + 1 - offsets[:-1], size) + np.arange(offsets[-1])]))
            longer = pc.binary_join(pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), several.cast(pa.string())), " ").cast(pa.large_string()).dictionary_encode()
            rest[far] = len(self.words) + longer.indices.to_numpy()
            self.rests = pa.concat_arrays([self.words, longer.dictionary])
        self.key = self.ids[self.i] * np.int64(len(self.rests)) + rest

    def counts(self) -> np.ndarray:
        """How often each of ``words`` occurs."""
        return np.bincount(self.ids, minlength=len(self.words))

    def distinct(self) -> tuple[np.ndarray, np.ndarray]:
        """The distinct keys of pairs in order, and how often each occurs."""
        return np.unique(self.key, return_counts=True)

    def of_keys(self, keys: np.ndarray, lanes: int = 2) -> list[np.ndarray]:
        """Digests of pairs: one number for each or two."""
        a, rest = np.divmod(keys, max(1, len(self.rests)))
        alone = digests(self.words)
        both = np.concatenate([alone, digests(self.rests[len(self.words) :])])
        return [alone[a, k] * _FACTOR + both[rest, k] for k in range(lanes)]

    def texts(self, keys: np.ndarray) -> pa.Array:
        """Pairs as "a b" or "a between b"."""
        a, rest = np.divmod(keys, max(1, len(self.rests)))
        return pc.binary_join_element_wise(self.words.take(pa.array(a)), self.rests.take(pa.array(rest)), pa.scalar(" ", pa.large_string()))

    def numbers(self, keys: np.ndarray) -> np.ndarray:
        """One digest for each pair and then for each word."""
        return np.concatenate([self.of_keys(keys, 1)[0], digests(self.words)[:, 0]])

    def taken(self, known: np.ndarray) -> np.ndarray:
        """Which pairs of ``known`` keys are put together, if this is done from left to right, each word once."""
        hit = pc.is_in(pa.array(self.key), value_set=pa.array(known)).to_numpy(zero_copy_only=False)
        chained = np.zeros(len(hit), bool)
        chained[1:] = hit[:-1] & (self.j[:-1] == self.i[1:])
        order = np.arange(len(hit))
        first = np.maximum.accumulate(np.where(hit & ~chained, order, 0))
        return hit & ((order - first) % 2 == 0)  # of pairs that overlap every other one

    def _from_to(self, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Which words lie from a place of ``begin`` to before one of ``end``."""
        out = np.zeros(len(self.ids) + 1, np.int8)
        out[begin] += 1
        out[end] -= 1
        return np.cumsum(out[:-1], dtype=np.int8) > 0

    def _compounds(self, taken: np.ndarray, mark: str) -> tuple[pa.Array, np.ndarray, np.ndarray]:
        """Distinct pairs as words, which of them each pair is, and how often each occurs."""
        keys, which, n = np.unique(self.key[taken], return_inverse=True, return_counts=True)
        return pc.replace_substring(self.texts(keys), " ", mark), which, n

    def fused(self, known: np.ndarray, mark: str) -> Words:
        """The piece with pairs put together."""
        taken = self.taken(known)
        names, which, _ = self._compounds(taken, mark)
        numbers = self.raw.copy()
        numbers[self.at[self.i[taken]]] = len(self.words) + which
        numbers = np.delete(numbers, self.at[self._from_to(self.i[taken] + 1, self.j[taken] + 1)])
        found = pa.concat_arrays([self.words, names]).dictionary_encode()  # what is put together may be there already
        numbers = np.append(found.indices.to_numpy(), np.int32(-1))[numbers]
        used = np.zeros(len(found.dictionary) + 1, bool)
        used[numbers] = True
        return found.dictionary.filter(pa.array(used[:-1])), np.append(np.cumsum(used[:-1], dtype=np.int32) - 1, -1).astype(np.int32)[numbers]

    def fused_words(self, known: np.ndarray, mark: str) -> tuple[pa.Array, np.ndarray]:
        """The words of the piece with pairs put together, and how often each occurs; a word may come twice."""
        taken = self.taken(known)
        alone = np.bincount(self.ids[~self._from_to(self.i[taken], self.j[taken] + 1)], minlength=len(self.words))
        names, _, n = self._compounds(taken, mark)
        return pa.concat_arrays([self.words, names]), np.r_[alone, n]


def _batches(columns: dict[str, pa.Array]) -> Iterator[pa.RecordBatch]:
    yield from pa.table(columns).to_batches(max_chunksize=ROWS)


def _texts(values: pa.Array) -> pa.Array:
    return values.cast(pa.string())


def _longs(values: np.ndarray) -> pa.Array:
    return pa.array(values.view(np.int64) if values.dtype == np.uint64 else values.astype(np.int64))


def _in_order(numbers: DataFrame, path: str) -> None:
    """Writes ``numbers`` in order of the first column, taken without a sign, so that each file has a range of its own."""
    numbers, first = stored(numbers), numbers.columns[0]
    stored(numbers.orderBy(F.col(first) < 0, first), path)


class Table:
    """Columns of numbers, written by ``_in_order``, in blocks of ``most`` rows; a single block is read once."""

    def __init__(self, path: str, *columns: str, most: int = HELD):
        store, inner = fs.FileSystem.from_uri(path)
        self.columns, self.most, self.kept = list(columns), most, None
        self.source = dataset.dataset(inner, filesystem=store, format="parquet")

    def blocks(self) -> Iterator[list[np.ndarray]]:
        if self.kept is not None:
            yield self.kept
            return
        held, n, first = [], 0, True
        for batch in self.source.to_batches(columns=self.columns, batch_size=ROWS):
            if n and n + batch.num_rows > self.most:
                yield self._block(held)
                held, n, first = [], 0, False
            held.append(batch)
            n += batch.num_rows
        block = self._block(held)
        if first:
            self.kept = block
        yield block

    def _block(self, batches: list[pa.RecordBatch]) -> list[np.ndarray]:
        rows = [np.concatenate([np.empty(0, np.int64), *(b[c].to_numpy(zero_copy_only=False) for b in batches)]).view(np.uint64) for c in self.columns]
        if (rows[0][1:] < rows[0][:-1]).any():  # files came in another order than they were written
            order = np.argsort(rows[0])
            rows = [r[order] for r in rows]
        return rows

    def holds(self, values: list[np.ndarray]) -> np.ndarray:
        """Which rows of ``values`` the table has."""
        order = np.argsort((values[0] >> np.uint64(48)).astype(np.uint16), kind="stable")  # near enough to be found side by side
        values, out = [v[order] for v in values], np.zeros(len(order), bool)
        first = (values[0] >> np.uint64(48)).astype(np.uint16)
        for block in self.blocks():
            if not len(block[0]):
                continue
            ends = (block[0][[0, -1]] >> np.uint64(48)).astype(np.uint16)
            low, high = np.searchsorted(first, ends[0]), np.searchsorted(first, ends[1], side="right")
            asked = [v[low:high] for v in values]
            place, at = np.searchsorted(block[0], asked[0]), np.arange(high - low)
            while len(at):  # rows whose first numbers agree lie side by side
                at = at[place[at] < len(block[0])]
                at = at[block[0][place[at]] == asked[0][at]]
                same = np.ones(len(at), bool)
                for b, v in zip(block[1:], asked[1:], strict=True):
                    same &= b[place[at]] == v[at]
                out[order[low + at[same]]] = True
                at = at[~same]
                place[at] += 1
        return out


@lru_cache(maxsize=1)
def _table(path: str, *columns: str) -> Table:
    """A worker's next task finds the table read."""
    return Table(path, *columns)


def _counted(words: pa.Array, n: np.ndarray, having: str) -> Iterator[pa.RecordBatch]:
    wanted = pc.match_substring(words, having).to_numpy(zero_copy_only=False).astype(bool) & (n > 0)
    yield from _batches({"token": _texts(words.filter(pa.array(wanted))), "n": _longs(n[wanted])})


def words(files: DataFrame, having: str = "") -> DataFrame:
    """(token, n): words that have ``having`` in them, counted."""

    def run(batches):
        for piece in _read(batches):
            p = Piece(*piece)
            yield from _counted(p.words, p.counts(), having)

    return files.mapInArrow(run, "token string, n long").groupBy("token").agg(F.sum("n").alias("n"))


def _often(files: DataFrame, connectors: tuple[str, ...], min_count: int, path: str) -> None:
    """Writes (digest) of what may be a word or a pair that occurs ``min_count`` times or more.

    A digest's last bits make room for a count, up to ``min_count``. Each piece
    sends its numbers in order, cut by their first bits; what has the same first
    bits is added up in one go.
    """
    bits = np.uint64(int(min_count).bit_length())
    mask = (np.uint64(1) << bits) - np.uint64(1)

    def count(batches):
        for piece in _read(batches):
            p = Piece(*piece, connectors)
            keys, n = p.distinct()
            n = np.minimum(np.concatenate([n, p.counts()]), min_count).astype(np.uint64)
            x = np.sort(p.numbers(keys) & ~mask | n)
            at = np.r_[np.searchsorted(x, np.arange(1 << DEALT, dtype=np.uint64) << np.uint64(64 - DEALT)), len(x)]
            full = np.flatnonzero(np.diff(at))
            cut = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(full), [None, pa.py_buffer(np.r_[at[full], len(x)].astype(np.int64) * 8), pa.py_buffer(x)])
            yield from _batches({"part": pa.array(full.astype(np.int32)), "numbers": cut.cast(pa.binary())})

    def add_up(batches):
        def whole(held):
            x = np.sort(np.frombuffer(b"".join(held), np.uint64))
            first = np.flatnonzero(np.r_[True, x[1:] >> bits != x[:-1] >> bits])
            return x[first[np.add.reduceat(x & mask, first) >= min_count]] & ~mask

        part, held = None, []
        for batch in batches:
            for k, numbers in zip(batch["part"].to_pylist(), batch["numbers"].to_pylist(), strict=True):
                if k != part and held:
                    yield from _batches({"digest": _longs(whole(held))})
                    held = []
                part = k
                held.append(numbers)
        if held:
            yield from _batches({"digest": _longs(whole(held))})

    sent = files.mapInArrow(count, "part int, numbers binary").repartition("part").sortWithinPartitions("part")
    _in_order(sent.mapInArrow(add_up, "digest long"), path)


def word_and_pair_counts(files: DataFrame, connectors: tuple[str, ...] = (), min_count: int = 1) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(token, n) and (met, joint) of words and pairs that occur ``min_count`` times or more, and (n) of all words, in one row.

    Pairs are as in ``collocation.pair_counts``. They and words are counted
    twice: first by digests of 8 bytes, then as text, but then only those whose
    digest occurs often enough. So few are sent as text, and digests that agree by
    chance do no harm.
    """
    path = f"{shared_dir(files.sparkSession)}/often"
    _often(files, connectors, min_count, path)

    def spell(batches):
        often = _table(path, "digest")
        blank = ~((np.uint64(1) << np.uint64(int(min_count).bit_length())) - np.uint64(1))
        for piece in _read(batches):
            p = Piece(*piece, connectors)
            keys, n = p.distinct()
            hit = often.holds([p.numbers(keys) & blank])
            pair, word = hit[: len(keys)], hit[len(keys) :]
            yield from _batches({"met": _texts(p.texts(keys[pair])), "n": _longs(n[pair])})
            yield from _batches({"met": _texts(p.words.filter(pa.array(word))), "n": _longs(p.counts()[word])})
            yield from _batches({"met": pa.array([""]), "n": pa.array([len(p.ids)])})

    found = files.mapInArrow(spell, "met string, n long").groupBy("met").agg(F.sum("n").alias("n"))
    found = stored(found.where((F.col("n") >= min_count) | (F.col("met") == "")))
    pair = F.contains(F.col("met"), F.lit(" "))
    words = found.where(~pair & (F.col("met") != "")).select(F.col("met").alias("token"), "n")
    return words, found.where(pair).select("met", F.col("n").alias("joint")), found.where("met = ''").select("n")


def _numbered(phrases: DataFrame, mark: str) -> str:
    """Where digests of 16 bytes of ``phrases`` (a, between, b) are written."""
    if len(mark) != 1 or not "!" <= mark <= "~" or mark.isalpha():
        raise ValueError("the mark of coded texts is one character of ASCII, neither letter nor blank")
    path = f"{shared_dir(phrases.sparkSession)}/phrases"

    def number(batches):
        for batch in batches:
            alone, rest = (digests(pc.cast(batch[c], pa.large_string())) for c in ("a", "rest"))
            yield from _batches({c: _longs(alone[:, k] * _FACTOR + rest[:, k]) for k, c in enumerate(("x", "y"))})

    rest = F.when(F.col("between") == "", F.col("b")).otherwise(F.concat_ws(" ", "between", "b"))
    _in_order(phrases.select("a", rest.alias("rest")).mapInArrow(number, "x long, y long"), path)
    return path


def _known(batches: Iterator[pa.RecordBatch], path: str, connectors: tuple[str, ...]) -> Iterator[tuple[Piece, np.ndarray]]:
    known = _table(path, "x", "y")
    for piece in _read(batches):
        p = Piece(*piece, connectors)
        keys, _ = p.distinct()
        yield p, keys[known.holds(p.of_keys(keys))]


def fused(files: DataFrame, phrases: DataFrame, connectors: tuple[str, ...] = (), mark: str = "_") -> DataFrame:
    """The files with ``phrases`` (a, between, b) put together from left to right, each word once, with ``mark`` between the parts."""
    path = _numbered(phrases, mark)

    return _written(files, lambda batches: (p.fused(known, mark) for p, known in _known(batches, path, connectors)))


def fused_words(files: DataFrame, phrases: DataFrame, connectors: tuple[str, ...] = (), mark: str = "_", having: str = "") -> DataFrame:
    """``words`` of ``fused`` files, which are not made for it."""
    path = _numbered(phrases, mark)

    def run(batches):
        for p, known in _known(batches, path, connectors):
            yield from _counted(*p.fused_words(known, mark), having)

    return files.mapInArrow(run, "token string, n long").groupBy("token").agg(F.sum("n").alias("n"))
