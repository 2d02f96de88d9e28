"""Classifier output: label distributions of windows put together for documents."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.maths import ratio

MIX, THRESHOLD = "Mix", 0.60


def scored_windows(windows: DataFrame, scorer: Callable[[list[str]], list[dict[str, float]]], text: str = "text", weight: str | None = None) -> DataFrame:
    """(doc_id, window, label, p): the distributions that an injected scorer gives, a batch of texts at a time.

    With the column ``weight`` the windows' weights go along, so that none has to be joined on.
    """
    more = [weight] if weight else []

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = scorer(batch[text].tolist())
            rest = zip(*(batch[c] for c in ("doc_id", "window", *more)), strict=True)
            rows = [(d, w, label, float(p), *m) for (d, w, *m), dist in zip(rest, found, strict=True) for label, p in dist.items()]
            yield pd.DataFrame(rows, columns=["doc_id", "window", "label", "p", *more])

    schema = "doc_id long, window int, label string, p double" + "".join(f", `{c}` {windows.schema[c].dataType.simpleString()}" for c in more)
    return windows.select("doc_id", "window", text, *more).mapInPandas(run, schema)


def combined(scores: DataFrame, weight: str = "weight") -> DataFrame:
    """(doc_id, label, p, rank): the weighted mean of window distributions (doc_id, window, label, p, weight); ties in the order of labels.

    All windows of a document must have the same labels, each once and with a
    probability, and one weight each, and their weights a positive sum; else
    the job fails and says which document is wrong.
    """
    label = F.struct("label", "p")
    windows = scores.groupBy("doc_id", "window").agg(
        F.array_sort(F.collect_list(label)).alias("held"), F.min(F.coalesce(F.col(weight).cast("double"), F.lit(float("nan")))).alias("low"), F.max(F.coalesce(F.col(weight).cast("double"), F.lit(float("nan")))).alias("high")
    )
    names = F.col("held.label")
    windows = windows.withColumns({"labels": names, "whole": (F.size(F.array_distinct(names)) == F.size(names)) & ~F.exists("held", lambda x: x["label"].isNull() | x["p"].isNull())})
    cells = windows.select("doc_id", "low", "high", "labels", "whole", F.inline("held"))
    means = cells.groupBy("doc_id", "label").agg(F.sum(F.col("p") * F.col("low")).alias("top"), F.sum("low").alias("sum"))
    checks = windows.groupBy(F.col("doc_id").alias("__doc")).agg(
        F.min(F.array_join("labels", "\t")).alias("a"), F.max(F.array_join("labels", "\t")).alias("b"), F.bool_and("whole").alias("whole"),
        F.bool_or(F.isnan("high") | (F.col("low") != F.col("high"))).alias("odd"), F.sum("low").alias("sum"),
    )
    fail = lambda why: F.raise_error(F.concat(F.lit("document "), F.col("__doc").cast("string"), F.lit(f": {why}"))).cast("boolean")
    right = F.when((F.col("a") != F.col("b")) | ~F.col("whole"), fail("its windows have unlike labels, or one twice or without a probability"))
    right = right.when(F.col("odd"), fail("a window without a weight, or with several")).when(F.col("sum") <= 0, fail("its weights have no positive sum")).otherwise(True)
    means = means.join(checks.select("__doc", right.alias("__right")), F.col("doc_id").eqNullSafe(F.col("__doc"))).where("__right")
    means = means.select("doc_id", "label", F.try_divide("top", "sum").alias("p"))
    return means.withColumn("rank", F.row_number().over(Window.partitionBy("doc_id").orderBy(F.desc("p"), "label")))


def decided(best: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Adds ``decision``: the label, or ``Mix`` below the threshold."""
    if not 0 <= threshold <= 1:
        raise ValueError("the threshold must lie in [0, 1]")
    return best.withColumn("decision", F.when(F.col("p") >= threshold, F.col("label")).otherwise(MIX))


def agreement_rates(rows: DataFrame, by: str) -> DataFrame:
    """(by, n, agree, mixed): rates of label = other_label and of ``Mix`` decisions."""
    return rows.groupBy(by).agg(
        F.count(F.lit(1)).alias("n"),
        ratio(F.count_if(F.col("label") == F.col("other_label")), F.count(F.lit(1))).alias("agree"),
        ratio(F.count_if(F.col("decision") == MIX), F.count(F.lit(1))).alias("mixed"),
    )
