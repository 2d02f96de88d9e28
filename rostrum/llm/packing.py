"""Packing documents into sequences of a fixed length: a configuration linear program.

What is packed are lengths, not documents: the histogram of lengths has at most
as many rows as a sequence has tokens, whatever the corpus' size. Over it
stands the linear program whose variables are configurations, the multisets of
lengths that fit one sequence. Multiplicative weights give each length its
price: again and again a knapsack by dynamic programming prices configurations,
and lengths that the dearest ones leave uncovered become dearer. Rounding goes
from long to short: a configuration of highest price with the longest length
left is taken a whole number of times, and prices fall as a length is used up.

Documents are then dealt to the slots of their length: each task has counted
its own as it encoded them, so running sums over tasks number them all, and
neither texts nor a length that many documents share come together anywhere.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import batches_of, exact_ids, shared_dir, stored
from .tokens import END_ID, _encoder

#: Tokens of a sequence.
MOST = 1024


class Knapsack:
    """The dearest configurations under prices by length (index; 0: not for sale), each length any number of times."""

    def __init__(self, price: np.ndarray):
        self.most = len(price) - 1
        self.value, self.item = np.zeros(self.most + 1), np.zeros(self.most + 1, np.int64)
        sizes = np.flatnonzero(price > 0)[::-1]  # of equal values the longest length is taken
        worth, fits = price[sizes], np.searchsorted(-sizes, -np.arange(self.most + 1))
        for room in range(1, self.most + 1):
            self.value[room] = self.value[room - 1]
            if (k := fits[room]) < len(sizes):
                each = self.value[room - sizes[k:]] + worth[k:]
                if each[best := each.argmax()] > self.value[room] + 1e-12:
                    self.value[room], self.item[room] = each[best], sizes[k + best]

    def with_length(self, length: int) -> list[int]:
        """A dearest configuration that has ``length``: that and what fills the rest."""
        out, room = [int(length)], self.most - int(length)
        while room > 0:
            if step := int(self.item[room]):
                out.append(step)
            room -= step or 1
        return out


def prices(histogram: np.ndarray, steps: int = 100, rate: float = 0.05, calls: int = 64, near: float = 0.005) -> tuple[np.ndarray, float]:
    """(prices of lengths, lower bound on sequences) for ``histogram[length]`` documents each.

    Multiplicative weights on the program's dual. In each step ``calls``
    lengths get a dearest configuration that has them, by their number and by
    how near it comes to the dearest of all; what lengths these cover above or
    below their share makes them cheaper or dearer. Prices that no
    configuration exceeds in sum are feasible, and their value over all
    documents bounds the number of sequences from below; the best are returned.
    """
    most = len(histogram) - 1
    live = np.flatnonzero(histogram)
    price = np.where(histogram > 0, np.arange(most + 1) / most, 0.0)
    best, bound = price, 0.0
    for _ in range(steps if len(live) else 0):
        sack = Knapsack(price)
        top = sack.value[most]
        price = price / top
        if (worth := float(price @ histogram)) > bound * (1 + 1e-12):
            best, bound = price, worth
        value = (price[live] * top + sack.value[most - live]) / top
        share = histogram[live] * np.exp((value - 1) / near)
        covered = np.zeros(most + 1)
        for i in np.argsort(-share, kind="stable")[:calls]:
            np.add.at(covered, sack.with_length(live[i]), share[i])
        covered *= worth / max(float(price @ covered), 1e-300)
        over = np.clip(covered[live] / histogram[live], 0, 3) - 1
        price = price.copy()
        price[live] *= np.exp(-rate * over)
    return best, bound


def _bounded(wanted: list[int], left: np.ndarray) -> Counter:
    """``wanted`` as far as there are documents for it, filled up with the longest lengths that are left and fit."""
    taken, room = Counter(), len(left) - 1
    for length in wanted:
        if taken[length] < left[length]:
            taken[length] += 1
            room -= length
    while room > 0:
        fits = np.flatnonzero(left[: room + 1])[::-1]
        length = next((int(x) for x in fits if taken[int(x)] < left[x]), 0)
        if not length:
            break
        taken[length] += 1
        room -= length
    return +taken


def rounded(histogram: np.ndarray, price: np.ndarray, fall: float = 0.03, bend: float = 0.01, calls: int = 4) -> list[tuple[tuple[tuple[int, int], ...], int]]:
    """Whole configurations that hold all documents: ((length, copies), ...) and how many sequences are like it.

    A configuration is taken until a length of it runs out, so the list is
    about as long as the histogram, however many documents there are. Between
    configurations of nearly one price those are taken that have longer
    lengths (``bend``) and lengths less used up (``fall``).
    """
    most = len(histogram) - 1
    left, plan = histogram.astype(np.int64).copy(), []
    tilt = 1 + bend * np.arange(most + 1) / most
    while left.any():
        used = left / np.maximum(histogram, 1) - 1
        sack = Knapsack(np.where(left > 0, np.maximum(price, 1e-9) * tilt * np.exp(fall * used), 0.0))
        for length in np.flatnonzero(left)[::-1][:calls]:
            if left[length]:
                taken = _bounded(sack.with_length(length), left)
                times = min(int(left[x]) // k for x, k in taken.items())
                for x, k in taken.items():
                    left[x] -= times * k
                plan.append((tuple(sorted(taken.items(), reverse=True)), times))
    return plan


RUNS = "run_length int, first_slot long, end_slot long, copies long, first_sequence long, at long"


def slots(plan: list[tuple[tuple[tuple[int, int], ...], int]]) -> tuple[list[tuple], int]:
    """(rows of ``RUNS``, number of sequences): which slots of a length lie in which sequences, and where in them."""
    rows, next_slot, sequences = [], Counter(), 0
    for taken, times in plan:
        at = 0
        for length, copies in taken:
            rows.append((length, next_slot[length], next_slot[length] + copies * times, copies, sequences, at))
            next_slot[length] += copies * times
            at += length * copies
        sequences += times
    return rows, sequences


def _encoded(docs: DataFrame, tokenizer: str, end_id: int, most: int, ids: bool) -> DataFrame:
    """(doc_id, head, crcs, task, nth, later[, ids]): the length of the first piece, the pieces' checksums, and running numbers of the task.

    ``nth`` counts the task's earlier documents of the same head, ``later`` their further pieces.
    """

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder, task = _encoder(tokenizer), TaskContext.get().partitionId()
        seen, later = [0] * (most + 1), 0
        for batch in batches:
            found, counts = encoder.flat(["" if t is None else t for t in batch["text"]])
            flat = np.insert(found, np.cumsum(counts), np.uint32(end_id)).astype("<u4")
            data, end, rows = memoryview(flat).cast("B"), 0, []
            for doc_id, n in zip(batch["doc_id"], (counts + 1).tolist(), strict=True):
                start, end = end, end + n
                head = (n - 1) % most + 1
                cuts = [start, *range(start + head, end + 1, most)]
                crcs = [zlib.crc32(data[4 * a : 4 * b]) for a, b in zip(cuts, cuts[1:], strict=False)]
                pieces = [flat[a:b].astype(np.int64) for a, b in zip(cuts, cuts[1:], strict=False)] if ids else None
                rows.append((doc_id, head, crcs, task, seen[head], later, pieces))
                seen[head] += 1
                later += len(crcs) - 1
            out = pd.DataFrame(rows, columns=["doc_id", "head", "crcs", "task", "nth", "later", "ids"])
            yield out if ids else out.drop(columns="ids")

    schema = "doc_id long, head int, crcs array<long>, task int, nth long, later long" + ", ids array<array<long>>" * ids
    return exact_ids(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), encode, schema, "doc_id")


def packed(docs: DataFrame, tokenizer: str, most: int = MOST, end_id: int = END_ID, ids: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset[, ids]): where each piece of each document lies.

    Each whole text of ``docs`` (doc_id, text) is encoded and gets ``end_id``.
    A document of more than ``most`` tokens is cut into pieces of ``most``, of
    which the first may be shorter; no other is cut. ``start`` counts the
    document's ids before the piece; ``ids_crc32`` is that of the ids as
    little-endian unsigned 32-bit integers; ``offset`` is the piece's place in
    its sequence, where pieces lie without gaps. ``ids`` adds the ids, from
    which ``sequences`` puts sequences together.

    A null text counts as empty: ``end_id`` alone. Null ids stay null. Repeated
    rows are packed each. Other columns are not read. No rows give no rows.

    One pass over the texts, which aren't shuffled. What reaches the driver is
    the histogram of lengths, ``most`` rows, and what is sent to all tasks the
    list of runs of slots, of which there are a few for each length.
    """
    spark, home = docs.sparkSession, shared_dir(docs.sparkSession)
    with batches_of(spark, 1024):
        rows = stored(_encoded(docs, tokenizer, end_id, most, ids), f"{home}/encoded")

    # documents by task and length; further pieces, all of ``most`` tokens, count as length 0
    heads = rows.groupBy("task", F.col("head").alias("class")).agg(F.count(F.lit(1)).alias("n"))
    further = rows.groupBy("task").agg(F.sum(F.size("crcs") - 1).cast("long").alias("n")).select("task", F.lit(0).alias("class"), "n")
    counts = stored(heads.unionByName(further), f"{home}/counts")
    before = Window.partitionBy("class").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)  # a row for each task
    starts = counts.select("task", "class", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))

    histogram = np.zeros(most + 1, np.int64)
    for r in counts.where("class > 0").groupBy("class").agg(F.sum("n").alias("n")).collect():
        histogram[r["class"]] = r["n"]
    runs, sequences = slots(rounded(histogram, prices(histogram)[0]))
    runs = spark.createDataFrame(runs, RUNS)

    of_head = starts.where("class > 0").select(F.col("task").alias("t"), F.col("class").alias("c"), "first")
    of_later = starts.where("class = 0").select(F.col("task").alias("lt"), F.col("first").alias("first_later"))
    out = rows.join(of_head, (F.col("task") == F.col("t")) & (F.col("head") == F.col("c"))).join(of_later, F.col("task") == F.col("lt"))
    slot = F.col("first") + F.col("nth")
    out = out.withColumn("slot", slot).join(F.broadcast(runs), (F.col("head") == F.col("run_length")) & (F.col("slot") >= F.col("first_slot")) & (F.col("slot") < F.col("end_slot")))
    in_run = F.col("slot") - F.col("first_slot")
    whole = {
        "first_id": F.col("first_sequence") + F.call_function("div", in_run, F.col("copies")),
        "first_at": F.col("at") + F.pmod(in_run, F.col("copies")) * F.col("head"),
        "later_id": F.lit(sequences).cast("long") + F.col("first_later") + F.col("later"),
    }
    pieces = F.arrays_zip("crcs", "ids") if ids else F.arrays_zip("crcs")
    out = out.withColumns(whole).select("doc_id", "head", *whole, F.posexplode(pieces).alias("piece", "of"))
    head, is_first = F.col("head").cast("long"), F.col("piece") == 0
    return out.select(
        "doc_id", "piece",
        F.when(is_first, F.lit(0).cast("long")).otherwise(head + (F.col("piece") - 1) * F.lit(most).cast("long")).alias("start"),
        F.when(is_first, head).otherwise(F.lit(most).cast("long")).alias("length"),
        F.col("of.crcs").alias("ids_crc32"),
        F.when(is_first, F.col("first_id")).otherwise(F.col("later_id") + F.col("piece") - 1).alias("sequence_id"),
        F.when(is_first, F.col("first_at")).otherwise(F.lit(0).cast("long")).alias("offset"),
        *([F.col("of.ids").alias("ids")] if ids else []),
    )


def sequences(pieces: DataFrame) -> DataFrame:
    """(sequence_id, ids, doc_ids): the sequences of ``packed(..., ids=True)``, at most ``most`` ids each."""
    one = F.struct("offset", "ids", "doc_id")
    out = pieces.groupBy("sequence_id").agg(F.array_sort(F.collect_list(one)).alias("all"))
    return out.select("sequence_id", F.flatten("all.ids").alias("ids"), F.col("all.doc_id").alias("doc_ids"))
