"""Benchmark decontamination: MinHash containment search, partitioned by size.

Test items are short and documents may be long, so a document's own signature
says nothing about an item. Items are therefore parted by size into classes of
powers of two, and each document is read, for each class, as windows of twice
the class's size, half a window apart: what is as long as an item lies inside
some window whole, and the Jaccard similarity of the two is bounded below.
Every hash function of the signatures is a band of its own. Items and windows
that agree in one are candidates. Items of few distinct shingles, or of far
fewer than their class spans, have no such bound: so many of their rarest
shingles that a document can't do without all of them are looked up among all
shingles of the documents. A candidate counts if the item's shingles of five
words are in the document, exactly, to 80% or more.

Each document is searched where it lies; nothing is shuffled. Items go to the
tasks in blocks of a fixed number, and a larger benchmark takes more passes.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from .common import exact_ids, shared_dir, small_batches, stored
from .shingles import SIZE, WORD, shingle_hashes, slices

CONTAINMENT = 0.8
#: At similarity ``FLOOR`` 48 functions all miss once in 25,000 times. Items that may have less are looked up by shingles.
HASHES = 48
FLOOR = 0.19
#: Windows are put together from runs of so many shingles.
RUN = 8
#: Items in one block, and bytes of their texts (or those of one that is longer): what is sent to the tasks is some times that.
BLOCK, BLOCK_BYTES = 20_000, 16 << 20

_FACTORS = np.random.default_rng(20).integers(0, 1 << 63, HASHES, dtype=np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)


def word_shingles(text: str | None) -> set[tuple[str, ...]]:
    """The distinct shingles of a text as words; fewer than five words are one shingle."""
    words = re.findall(WORD, (text or "").lower())
    return {tuple(words[i : i + SIZE]) for i in range(max(1, len(words) - SIZE + 1))} if words else set()


class Index:
    """The signatures of a block of items, by size class and hash function, and rare shingles of those without a bound.

    ``least`` is the containment below which nothing needs to be found.
    """

    def __init__(self, ids: list, texts: list[str | None], least: float = CONTAINMENT):
        self.ids, self.texts = ids, texts
        h, n = shingle_hashes(texts)
        at = np.r_[0, np.cumsum(n)]
        self.shingles = [np.unique(h[a:b]) for a, b in zip(at[:-1], at[1:], strict=True)]
        lengths = np.maximum(n, RUN)  # shingles with repeats: what a window must span
        classes = np.ceil(np.log2(lengths)).astype(int)
        distinct = np.array([len(s) for s in self.shingles], np.int64)
        # what is shared may lie in several windows of 2 << c shingles: their similarities then add up to this at least
        bounded = least * distinct >= FLOOR * (distinct + (2 << classes))
        self.classes: dict[int, list[tuple]] = {}
        for c in sorted(set(classes[bounded & (n > 0)].tolist())):
            items = np.flatnonzero((classes == c) & bounded & (n > 0))
            self.classes[c] = [_table(np.array([(self.shingles[i] * f).min() for i in items], np.uint64), items) for f in _FACTORS]
        self.rare = self._rare(np.flatnonzero(~bounded & (n > 0)), least)

    def _rare(self, items: np.ndarray, least: float) -> tuple | None:
        """The shingles to look up: of an item that needs s of its d, the d - s + 1 that fewest items have."""
        if not len(items):
            return None
        each, common = np.unique(np.concatenate([self.shingles[i] for i in items]), return_counts=True)
        picked, of = [], []
        for i in items.tolist():
            own = self.shingles[i]
            most = min(len(own), len(own) - math.ceil(least * len(own)) + 1)
            picked.append(own[np.argsort(common[np.searchsorted(each, own)], kind="stable")[:most]])
            of.append(np.full(len(picked[-1]), i))
        return _table(np.concatenate(picked), np.concatenate(of))

    def candidates(self, h: np.ndarray, counts: np.ndarray) -> set[tuple[int, int]]:
        """(text, item) that agree in some window and function or in a rare shingle, of texts with the shingles ``h``."""
        found: set[tuple[int, int]] = set()
        if not len(h):
            return found
        if self.rare:
            values, items, there, mask = self.rare
            hit = np.flatnonzero(there[(h & mask).astype(np.int64)])
            left, right = np.searchsorted(values, h[hit]), np.searchsorted(values, h[hit], "right")
            hit, left, right = (x[left < right] for x in (hit, left, right))
            text = np.searchsorted(np.cumsum(counts), hit, "right")
            _, once = np.unique(text * len(values) + left, return_index=True)  # a shingle that a text repeats counts once
            for t, a, b in zip(text[once].tolist(), left[once].tolist(), right[once].tolist(), strict=True):
                found.update((t, i) for i in items[a:b].tolist())
        if not self.classes:
            return found
        # runs of RUN shingles that begin anew with each text
        runs = -(-counts // RUN)
        first = np.repeat(np.cumsum(counts) - counts, runs) + RUN * (np.arange(runs.sum()) - np.repeat(np.cumsum(runs) - runs, runs))
        owner = np.repeat(np.arange(len(counts)), runs)
        for k, f in enumerate(_FACTORS):
            least, of, size = np.minimum.reduceat(h * f, first), owner, RUN
            for c, tables in self.classes.items():
                while size < 1 << c:
                    least, of = _paired(least, of)
                    size *= 2
                values, items, there, mask = tables[k]
                windows = least.copy()
                same = of[1:] == of[:-1]
                windows[:-1][same] = np.minimum(least[:-1], least[1:])[same]
                # a window that ends with its text is also that of the last run alone
                hit = np.flatnonzero(there[(windows & mask).astype(np.int64)])
                if len(hit):
                    left, right = np.searchsorted(values, windows[hit]), np.searchsorted(values, windows[hit], "right")
                    for w in np.flatnonzero(left < right):
                        text = int(of[hit[w]])
                        found.update((text, int(i)) for i in items[left[w] : right[w]])
        return found

    def matches(self, texts: list[str | None], least: float = CONTAINMENT) -> list[tuple[int, int, int, int]]:
        """(text, item, shared, shingles of the item) of all that are contained."""
        return [(a + t, *rest) for a, b in slices(texts) for t, *rest in self._matches(texts[a:b], least)]

    def _matches(self, texts: list[str | None], least: float) -> list[tuple[int, int, int, int]]:
        h, counts = shingle_hashes(texts)
        at, out, last, own, words = np.r_[0, np.cumsum(counts)], [], -1, None, None
        for text, item in sorted(self.candidates(h, counts)):
            if text != last:
                last, own, words = text, np.unique(h[at[text] : at[text + 1]]), None
            wanted = self.shingles[item]
            place = np.minimum(np.searchsorted(own, wanted), len(own) - 1)
            if (own[place] == wanted).sum() < least * len(wanted):
                continue
            words = word_shingles(texts[text]) if words is None else words
            asked = word_shingles(self.texts[item])
            if (shared := len(asked & words)) >= least * len(asked):
                out.append((text, item, shared, len(asked)))
        return out


def _table(values: np.ndarray, items: np.ndarray) -> tuple:
    """(values in order, their items, which low bits occur, mask of those bits)."""
    mask = np.uint64((1 << min(24, max(16, len(items).bit_length() + 8))) - 1)
    order = np.argsort(values)
    there = np.zeros(int(mask) + 1, bool)
    there[(values & mask).astype(np.int64)] = True
    return values[order], items[order], there, mask


def _paired(least: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Neighbouring runs of a text put together two by two; an odd last one stays alone."""
    n = np.bincount(of, minlength=of[-1] + 1)
    place = np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n)
    start = np.flatnonzero(place % 2 == 0)
    return np.minimum.reduceat(least, start), of[start]


def _blocks(benchmark: DataFrame, block: int) -> Iterator[tuple[list, list]]:
    """(ids as text, texts) of the items in blocks of ``block`` rows and ``BLOCK_BYTES`` at most, one at a time on the driver."""
    items = benchmark.select(F.col("item_id").cast("long").cast("string").alias("item_id"), "text").where(F.col("text").isNotNull())
    sizes = items.agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("text")).alias("bytes")).first()
    parts = max(-(-sizes["n"] // block), -(-(sizes["bytes"] or 0) // BLOCK_BYTES)) * 2
    if parts <= 2:
        rows = items.collect()
        yield [r["item_id"] for r in rows], [r["text"] for r in rows]
        return
    items = stored(items.withColumn("__part", F.pmod(F.xxhash64("item_id", "text"), F.lit(parts))), f"{shared_dir(items.sparkSession)}/items")
    for part in range(parts):
        held: list[Row] = []
        for row in items.where(F.col("__part") == part).toLocalIterator():
            if held and (len(held) == block or sum(len(r["text"]) for r in held) + len(row["text"]) > BLOCK_BYTES):
                yield [r["item_id"] for r in held], [r["text"] for r in held]
                held = []
            held.append(row)
        if held:
            yield [r["item_id"] for r in held], [r["text"] for r in held]


def contained(docs: DataFrame, benchmark: DataFrame, least: float = CONTAINMENT, block: int = BLOCK) -> DataFrame:
    """(doc_id, item_id, shared, item_shingles, containment): which items which documents contain.

    One row for each pair of a row of ``docs`` (doc_id, text) and a row of
    ``benchmark`` (item_id, text), repeated rows included. Null and wordless
    texts match nothing; an item of fewer than five words matches only texts
    of the same words and no others. Other columns are not read.
    """
    spark = docs.sparkSession
    small_batches(spark)
    rows, out = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), None
    schema = "doc_id long, item_id long, shared long, item_shingles long, containment double"
    for ids, texts in _blocks(benchmark, block):
        sent = spark.sparkContext.broadcast(Index(ids, texts, least))

        def search(batches: Iterator[pd.DataFrame], sent=sent) -> Iterator[pd.DataFrame]:
            index = sent.value
            for batch in batches:
                hits, ids = index.matches(batch["text"].tolist(), least), batch["doc_id"].tolist()
                yield pd.DataFrame(
                    {
                        "doc_id": pd.Series([ids[t] for t, *_ in hits], dtype=object), "item_id": pd.Series([index.ids[i] for _, i, *_ in hits], dtype=object),
                        "shared": [s for *_, s, _ in hits], "item_shingles": [n for *_, n in hits], "containment": [s / n for *_, s, n in hits],
                    }
                )

        part = exact_ids(rows, search, schema, "doc_id", "item_id")
        out = part if out is None else out.unionByName(part)
    return out


def _free_of(sent: Broadcast, least: float) -> Callable[[Column], Column]:
    """Whether a text contains none of the items that were sent."""

    def free(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            dirty = {t for t, *_ in sent.value.matches(texts.tolist(), least)}
            yield pd.Series([k not in dirty for k in range(len(texts))], dtype=bool)

    return F.pandas_udf(free, "boolean")


def clean(docs: DataFrame, benchmark: DataFrame, least: float = CONTAINMENT, block: int = BLOCK) -> DataFrame:
    """The rows of ``docs`` that contain no item, with all their columns, whatever their names.

    Rows with null, empty or wordless texts stay, as do all if there are no
    items. Only the texts are handed to Python; equal rows stay or go together.
    """
    spark = docs.sparkSession
    small_batches(spark)
    for ids, texts in _blocks(benchmark, block):
        sent = spark.sparkContext.broadcast(Index(ids, texts, least))

        docs = docs.where(_free_of(sent, least)(F.col("text")))
    return docs
