"""Roll-ups that a dashboard shows: joins, shares, ranks, percentiles, scores."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.maths import ratio
from ..storage import stored
from .ordering import running


def left_chain(base: DataFrame, others: list[DataFrame], key: str, zeros: tuple[str, ...] = ()) -> DataFrame:
    """``base`` with all others joined on ``key``; columns of ``zeros`` are 0 where there was no row."""
    out = reduce(lambda a, b: a.join(b, key, "left"), others, base)
    return out.na.fill(0, [c for c in zeros if c in out.columns])


def full_outer(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """All keys of both; null keys meet null keys."""
    right = b.withColumnRenamed(key, "__key")
    out = a.join(right, F.col(key).eqNullSafe(F.col("__key")), "full")
    kept = [c for c in a.columns if c != key] + [c for c in b.columns if c != key]
    return out.select(F.coalesce(key, "__key").alias(key), *kept)


def pivot_counts(rows: DataFrame, key: str, kind: str, kinds: list[str]) -> DataFrame:
    """(key, a count for each kind)."""
    return rows.groupBy(key).pivot(kind, kinds).count().na.fill(0)


def association(rows: DataFrame, a: str, b: str, least: int = 2) -> DataFrame:
    """(a, b, n, share_of_a, share_of_b) of pairs that occur ``least`` times, the shares being of all pairs."""
    pairs = rows.where(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(a, b).agg(F.count(F.lit(1)).alias("n"))
    # totals are combined before they are sent, so a frequent value is no hot key; pairs are joined to them
    whole = lambda k, name: pairs.groupBy(F.col(k).alias(f"__{name}")).agg(F.sum("n").alias(name))
    out = pairs.where(F.col("n") >= least).join(whole(a, "of_a"), F.col(a) == F.col("__of_a")).join(whole(b, "of_b"), F.col(b) == F.col("__of_b"))
    return out.select(a, b, "n", ratio(F.col("n"), F.col("of_a")).alias("share_of_a"), ratio(F.col("n"), F.col("of_b")).alias("share_of_b"))


def top_of_group(rows: DataFrame, by: str, order: list, n: int = 1) -> DataFrame:
    """The first ``n`` rows of each group, with their rank."""
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(by).orderBy(*order))).where(F.col("rank") <= n)


def percentiles(rows: DataFrame, value: str) -> DataFrame:
    """Adds ``percentile``: the share, in per cent, of known values not above the row's. Distinct values are put in order by ranges."""
    known = rows.where(F.col(value).isNotNull())
    ties = known.groupBy(F.col(value).alias("__v")).agg(F.count(F.lit(1)).alias("__n"))
    total = known.agg(F.count(F.lit(1))).scalar()
    places = running(ties, [F.col("__v")], {"__below": F.col("__n")}).withColumn("__total", total)
    places = places.select("__v", F.round(100 * ratio(F.col("__below") + F.col("__n"), F.col("__total"))).alias("percentile"))
    return rows.join(places, F.col(value) == F.col("__v"), "left").drop("__v")


def z_scores(rows: DataFrame, value: str, by: tuple[str, ...] = ()) -> DataFrame:
    """Adds ``z``: the value less its mean, by the sample deviation (1 if that is 0 or unknown)."""
    mean, spread = F.avg(value), F.coalesce(F.nullif(F.stddev_samp(value), F.lit(0.0)), F.lit(1.0))
    if by:
        stats = rows.groupBy(*(F.col(c).alias(f"__{c}") for c in by)).agg(mean.alias("__m"), spread.alias("__s"))
        on = reduce(lambda a, b: a & b, (F.col(c).eqNullSafe(F.col(f"__{c}")) for c in by))
        out = rows.join(stats, on).drop(*(f"__{c}" for c in by))
    else:
        out = rows.withColumns({"__m": rows.agg(mean).scalar(), "__s": rows.agg(spread).scalar()})
    return out.withColumn("z", (F.col(value) - F.col("__m")) / F.col("__s")).drop("__m", "__s")


def totals_with_all(rows: DataFrame, by: str, sums: list[str], label: str = "ALL") -> DataFrame:
    """Sums for each value of ``by`` and for all rows, by grouping sets; null values of ``by`` stay a group."""
    out = rows.groupingSets([[F.col(by)], []], F.col(by)).agg(*(F.sum(c).alias(c) for c in sums), F.grouping(F.col(by)).alias("__all"))
    return out.select(F.when(F.col("__all") == 1, F.lit(label)).otherwise(F.col(by)).alias(by), *sums)


def parties(people: DataFrame, speeches: DataFrame, by: str = "faction") -> DataFrame:
    """(by, members, speeches, words, weighted_lix): members from one table, the rest from the other."""
    heads = people.groupBy(by).agg(F.count(F.lit(1)).alias("members"))
    sums = speeches.where(F.col(by).isNotNull()).groupBy(by).agg(
        F.count(F.lit(1)).alias("speeches"), F.sum("n_words").alias("words"),
        F.try_divide(F.sum(F.when(F.col("reliable"), F.col("lix") * F.col("n_words"))), F.sum(F.when(F.col("reliable"), F.col("n_words")).cast("double"))).alias("weighted_lix"),
    )
    return sums.join(heads, by, "left")


def roles(rows: DataFrame, kind: str, mapping: dict[str, str], default: str = "debate") -> DataFrame:
    """Adds ``role`` by a dictionary of kinds, and ``is_qa``, whether it is that of an exchange."""
    table = F.create_map(*(F.lit(x) for pair in mapping.items() for x in pair))
    role = F.coalesce(table[F.col(kind)], F.lit(default))
    return rows.withColumns({"role": role, "is_qa": role != default})


def missing_from(rows: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Rows whose key is not in ``done``: what incremental work has left."""
    return rows.join(done.select(F.col(key).alias("__done")), F.col(key) == F.col("__done"), "left_anti")


def population(rows: DataFrame, key: str, metrics: list[str], eligible) -> DataFrame:
    """(metric, key, value) of eligible rows, long."""
    return rows.where(eligible).unpivot([key], metrics, "metric", "value").where(F.col("value").isNotNull())


def exchange_ids(exchanges: DataFrame, turns: str = "turns", uid: str = "uid") -> DataFrame:
    """(uid): the distinct ids in arrays of turns; turns without one are passed over."""
    return exchanges.select(F.explode(turns).alias("turn")).select(F.col(f"turn.{uid}").alias(uid)).where(F.col(uid) != "").distinct()


def named(rows: DataFrame, names: DataFrame, key: str) -> DataFrame:
    """``rows`` with the columns of ``names``, a file of one row a key; rows without one stay."""
    return rows.join(names.dropDuplicates([key]), key, "left")


def party_medians(rows: DataFrame, value: str, by: str = "faction") -> DataFrame:
    """(by, n, median): the exact median of each group's known values, however many a group has.

    Values and their counts are put in order by ranges of (group, value); the
    one or two in the middle of a group are those whose places hold it.
    """
    ties = rows.where(F.col(value).isNotNull()).groupBy(F.col(by).alias("__by"), F.col(value).alias("__v")).agg(F.count(F.lit(1)).alias("__n"))
    places = stored(running(ties, [F.col("__by"), F.col("__v")], {"__ahead": F.col("__n")}))
    whole = places.groupBy(F.col("__by").alias("__of")).agg(F.min("__ahead").alias("__start"), F.sum("__n").alias("n"))
    at = places.join(whole, F.col("__by").eqNullSafe(F.col("__of"))).withColumn("__from", F.col("__ahead") - F.col("__start"))
    holds = lambda k: (F.col("__from") <= k) & (k < F.col("__from") + F.col("__n"))
    low, high = F.floor((F.col("n") - 1) / 2), F.floor(F.col("n") / 2)
    middle = at.where(holds(low) | holds(high)).groupBy("__by", "n").agg(F.min("__v").alias("__low"), F.max("__v").alias("__high"))
    return middle.select(F.col("__by").alias(by), "n", ((F.col("__low").cast("double") + F.col("__high")) / 2).alias("median"))
