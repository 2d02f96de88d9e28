"""Readability and lexical diversity of documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.arrays import let
from ..functions.maths import lix, lix_band, ratio
from ..functions.text import letters, words
from ..profile import HUNGARIAN, Profile

PLAUSIBLE = 60
WINDOW = 100


def sentence_counts(docs: DataFrame, profile: Profile = HUNGARIAN, keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """(keys..., n_words, n_long, n_sentences): from the text alone, without a shuffle. A text without an end has one sentence."""
    long = F.filter(F.col("__w"), lambda w: letters(w, profile) > profile.long_word)
    rows = docs.select(*keys, words(F.col("text")).alias("__w"), F.regexp_count(F.coalesce("text", F.lit("")), F.lit("[.!?]+")).alias("__s"))
    return rows.select(*keys, F.size("__w").cast("long").alias("n_words"), F.size(long).cast("long").alias("n_long"), F.greatest("__s", F.lit(1)).cast("long").alias("n_sentences"))


def scored(counts: DataFrame, profile: Profile = HUNGARIAN) -> DataFrame:
    """Adds lix, lix_band, rix, words_per_sentence and reliable, the last false above 60 words a sentence. No words, no scores."""
    n, long, s = F.col("n_words"), F.col("n_long"), F.col("n_sentences")
    value = F.when(n > 0, lix(n, long, s))
    return counts.withColumns(
        {
            "lix": value,
            "lix_band": lix_band(value, profile),
            "rix": F.when(n > 0, ratio(long, s)),
            "words_per_sentence": ratio(n, s),
            "reliable": (n > 0) & (n <= s * PLAUSIBLE),
        }
    )


def mattr(tokens: DataFrame, window: int = WINDOW) -> DataFrame:
    """(doc_id, n_tokens, n_types, ttr, mattr, mattr_windowed): the mean share of types over all windows, in closed form.

    A token is the first of its type in the windows that begin after its type
    was last seen and hold the token; counting these for each token and adding
    them up replaces all windows. Documents shorter than the window have their
    plain share. Documents as arrays (``tokens.listed``) are counted where they
    lie: their words are put in order with their places, so that a word stands
    beside where it was last seen.
    """
    if "sentences" in tokens.columns:
        return _shares(tokens.select("doc_id", F.inline(_opened(F.flatten("sentences"), window))), window)
    seen = Window.partitionBy("doc_id", "token").orderBy("pos")
    whole = Window.partitionBy("doc_id")
    rows = tokens.withColumns({"before": F.coalesce(F.lag("pos").over(seen), F.lit(-1)), "n": F.count(F.lit(1)).over(whole)})
    last = F.least(F.col("pos").cast("long"), F.col("n") - window)
    first = F.greatest((F.col("before") + 1).cast("long"), (F.col("pos") - window + 1).cast("long"), F.lit(0).cast("long"))
    rows = rows.withColumn("opens", F.when(F.col("n") >= window, F.greatest(last - first + 1, F.lit(0))))
    out = rows.groupBy("doc_id").agg(F.first("n").alias("n_tokens"), F.count_if(F.col("before") == -1).alias("n_types"), F.sum("opens").alias("opens"))
    return _shares(out, window)


def _opened(words: Column, window: int) -> Column:
    """Array of one (n_tokens, n_types, opens), of none for no words: ``opens`` is in how many windows a token is the first of its type."""

    def opens(placed: Column, n: Column) -> Column:
        def of(k: Column) -> Column:
            here, ahead = F.get(placed, k), F.get(placed, k - 1)
            pos, before = here["pos"], F.when(ahead["token"] == here["token"], ahead["pos"]).otherwise(-1)
            return F.greatest(F.least(pos, n - window) - F.greatest(before + 1, pos - window + 1, F.lit(0)) + 1, F.lit(0)).cast("long")

        return F.when(n >= window, F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0).cast("long"), lambda sum_, k: sum_ + of(k)))

    placed = lambda w: F.sort_array(F.transform(w, lambda x, i: F.struct(x.alias("token"), i.alias("pos"))))
    one = lambda w: F.struct(F.size(w).cast("long").alias("n_tokens"), F.size(F.array_distinct(w)).cast("long").alias("n_types"), let(placed(w), lambda p: opens(p, F.size(w))).alias("opens"))
    return F.transform(F.filter(F.array(words), lambda w: F.size(w) > 0), one)


def _shares(out: DataFrame, window: int) -> DataFrame:
    ttr = ratio(F.col("n_types"), F.col("n_tokens"))
    moving = ratio(F.col("opens"), (F.col("n_tokens") - window + 1) * window)
    wide = F.col("n_tokens") >= window
    return out.select("doc_id", "n_tokens", "n_types", ttr.alias("ttr"), F.when(wide, moving).otherwise(ttr).alias("mattr"), wide.alias("mattr_windowed"))


def weighted_by_words(rows: DataFrame, by: tuple[str, ...], value: str = "lix", weight: str = "n_words") -> DataFrame:
    """(by..., n_docs, words, weighted): the mean of ``value`` by words over reliable rows; null keys are a group."""
    ok = F.col("reliable") & F.col(value).isNotNull()
    top = F.sum(F.when(ok, F.col(value) * F.col(weight)))
    return rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n_docs"), F.sum(F.when(ok, F.col(weight))).alias("words"), F.try_divide(top, F.sum(F.when(ok, F.col(weight)).cast("double"))).alias("weighted"))
