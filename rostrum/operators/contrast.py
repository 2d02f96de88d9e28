"""Contrasts of two corpora: keyness and rank turbulence."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.maths import log_likelihood, log_ratio, rank_divergence
from ..storage import stored


def side_counts(tokens: DataFrame, side: str, a: str, b: str) -> DataFrame:
    """(token, count_a, count_b) in one pass."""
    is_a, is_b = F.col(side) == a, F.col(side) == b
    rows = tokens.where(is_a | is_b).groupBy("token")
    return rows.agg(F.count_if(is_a).alias("count_a"), F.count_if(is_b).alias("count_b"))


def keyness(counts: DataFrame, min_count: int = 5) -> DataFrame:
    """Adds g2, log_ratio and side to (token, count_a, count_b); terms need ``min_count`` in both corpora."""
    total = lambda c: counts.agg(F.sum(c)).scalar()
    rows = counts.withColumns({"total_a": total("count_a"), "total_b": total("count_b")})
    rows = rows.where((F.col("count_a") >= min_count) & (F.col("count_b") >= min_count))
    columns = [F.col(c) for c in ("count_a", "count_b", "total_a", "total_b")]
    more = F.col("count_a") * F.col("total_b") > F.col("count_b") * F.col("total_a")
    return rows.withColumns({"g2": log_likelihood(*columns), "log_ratio": log_ratio(*columns), "side": F.when(more, "a").otherwise("b")}).drop("total_a", "total_b")


def top_keyness(scored: DataFrame, n: int = 60) -> DataFrame:
    """The ``n`` terms of most evidence on each side."""
    rank = F.row_number().over(Window.partitionBy("side").orderBy(F.desc("g2"), "token"))
    return scored.withColumn("rank", rank).where(F.col("rank") <= n)


def average_ranks(counts: DataFrame, count: str, rank: str) -> DataFrame:
    """Adds the rank of ``count`` from the largest, those that tie sharing the mean of their places.

    Only the distinct counts are put in order, which are few: terms are joined
    to the places of their count.
    """
    ties = counts.groupBy(F.col(count).alias("__c")).agg(F.count(F.lit(1)).alias("__n"))
    above = F.coalesce(F.sum("__n").over(Window.orderBy(F.desc("__c")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    places = ties.select("__c", (above + (F.col("__n") + 1) / 2).alias(rank))
    return counts.join(places, F.col(count) == F.col("__c")).drop("__c")


def rank_turbulence(counts: DataFrame, alpha: float = 1 / 3) -> DataFrame:
    """(token, count_a, count_b, rank_a, rank_b, divergence) of (token, count_a, count_b), not normalised.

    A term that one corpus lacks has there the rank of all that it lacks, tied.
    The counts are written once, since both ranks and their places are of them.
    """
    counts = stored(counts)
    ranked = average_ranks(average_ranks(counts, "count_a", "rank_a"), "count_b", "rank_b")
    return ranked.withColumn("divergence", rank_divergence(F.col("rank_a"), F.col("rank_b"), alpha))


def turbulence(counts: DataFrame, alpha: float = 1 / 3) -> DataFrame:
    """``rank_turbulence`` with ``share``, each term's part of the divergence of two corpora: in [0, 1] and adding up to it.

    The divergence is divided by what it would be if no term were in both:
    each term keeps its rank in its own corpus and shares, in the other, the
    one rank of all that this lacks. Ranks that tie are taken together, so
    that sum has a row for each distinct rank.
    """
    ranked = stored(rank_turbulence(counts, alpha))
    known = lambda c: F.count_if(F.col(c) > 0)
    sizes = ranked.agg(known("count_a").alias("na"), known("count_b").alias("nb"))
    lost_a, lost_b = F.col("na") + (F.col("nb") + 1) / 2, F.col("nb") + (F.col("na") + 1) / 2  # the rank in a of what only b has, and the other way
    side = lambda s: F.struct(F.lit(s).alias("of"), F.col(f"count_{s}").alias("n"), F.col(f"rank_{s}").alias("rank"))
    each = F.explode(F.array(side("a"), side("b"))).alias("r")
    ranks = ranked.select(each).select("r.*").where("n > 0").groupBy("of", "rank").agg(F.count(F.lit(1)).alias("ties"))
    ranks = ranks.join(F.broadcast(sizes))  # one row
    apart = F.when(F.col("of") == "a", rank_divergence(F.col("rank"), lost_b, alpha)).otherwise(rank_divergence(lost_a, F.col("rank"), alpha))
    most = ranks.agg(F.sum(F.col("ties") * apart)).scalar()
    return ranked.withColumn("share", F.coalesce(F.try_divide(F.col("divergence"), most), F.lit(0.0)))


def group_counts(tokens: DataFrame, groups: list[str]) -> DataFrame:
    """(grp, token, raw) where a document is in the groups that its columns name, each once."""
    rows = tokens.withColumn("grp", F.explode(F.array_distinct(F.array_compact(F.array(*(F.col(g) for g in groups))))))
    return rows.groupBy("grp", "token").agg(F.count(F.lit(1)).alias("raw"))
