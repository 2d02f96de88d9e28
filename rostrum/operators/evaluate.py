"""Evaluation: contingency statistics, strata, keywords in context."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.arrays import let
from ..functions.maths import ratio
from ..storage import stored


def contingency(rows: DataFrame, a: str, b: str) -> DataFrame:
    """(a, b, n) of rows where both are known."""
    return rows.where(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(a, b).agg(F.count(F.lit(1)).alias("n"))


def crosstab(rows: DataFrame, a: str, b: str, values: list[str]) -> DataFrame:
    """(a, a count for each value of b, total)."""
    out = contingency(rows, a, b).groupBy(a).pivot(b, values).agg(F.sum("n")).na.fill(0)
    return out.withColumn("total", sum((F.col(f"`{v}`") for v in values), F.lit(0)))


def purity(rows: DataFrame, cluster: str, label: str) -> DataFrame:
    """(cluster, n, dominant, dominant_n, purity); labels that tie go to the first."""
    cells = contingency(rows, cluster, label)
    place = F.row_number().over(Window.partitionBy(cluster).orderBy(F.desc("n"), label))
    total = F.sum("n").over(Window.partitionBy(cluster))
    best = cells.withColumns({"__place": place, "__total": total}).where("__place = 1")
    return best.select(cluster, F.col("__total").alias("n"), F.col(label).alias("dominant"), F.col("n").alias("dominant_n"), ratio(F.col("n"), F.col("__total")).alias("purity"))


def agreement(rows: DataFrame, a: str, b: str) -> DataFrame:
    """One row (n, ari, nmi, homogeneity, completeness) for two labellings, from the sums of their contingency table.

    ``nmi`` is by the arithmetic mean of the entropies. A labelling of one
    label is wholly homogeneous.
    """
    cells = contingency(rows, a, b)
    pairs = lambda n: n * (n - 1) / 2
    row = cells.groupBy(a).agg(F.sum("n").alias("n"))
    column = cells.groupBy(b).agg(F.sum("n").alias("n"))
    nlogn = lambda n: n * F.log(n.cast("double"))
    one = cells.agg(F.sum("n").cast("double").alias("n"), F.sum(pairs(F.col("n"))).alias("both"), F.sum(nlogn(F.col("n"))).alias("h"))
    one = one.withColumns(
        {
            "row_pairs": row.agg(F.sum(pairs(F.col("n")))).scalar(), "row_h": row.agg(F.sum(nlogn(F.col("n")))).scalar(),
            "col_pairs": column.agg(F.sum(pairs(F.col("n")))).scalar(), "col_h": column.agg(F.sum(nlogn(F.col("n")))).scalar(),
        }
    )
    n = F.col("n")
    expected = F.col("row_pairs") * F.col("col_pairs") / pairs(n)
    ari = F.coalesce(F.try_divide(F.col("both") - expected, (F.col("row_pairs") + F.col("col_pairs")) / 2 - expected), F.lit(1.0))
    h_a, h_b, h_ab = (F.log(n) - F.col(c) / n for c in ("row_h", "col_h", "h"))
    mutual = h_a + h_b - h_ab
    return one.select(
        n.cast("long").alias("n"), ari.alias("ari"), F.coalesce(F.try_divide(2 * mutual, h_a + h_b), F.lit(1.0)).alias("nmi"),
        F.coalesce(F.try_divide(mutual, h_b), F.lit(1.0)).alias("homogeneity"), F.coalesce(F.try_divide(mutual, h_a), F.lit(1.0)).alias("completeness"),
    )


def shares(rows: DataFrame, label: str, group: str, a: str, b: str) -> DataFrame:
    """(label, n, share_a, share_b, difference): a label's share of two groups."""
    is_a, is_b = F.col(group) == a, F.col(group) == b
    counts = rows.where(F.col(label).isNotNull()).groupBy(label).agg(F.count(F.lit(1)).alias("n"), F.count_if(is_a).alias("n_a"), F.count_if(is_b).alias("n_b"))
    part = lambda c: ratio(F.col(c), counts.agg(F.sum(c)).scalar())
    out = counts.withColumns({"share_a": part("n_a"), "share_b": part("n_b")})
    return out.select(label, "n", "share_a", "share_b", (F.col("share_a") - F.col("share_b")).alias("difference"))


def stratified(rows: DataFrame, stratum: str, key: str, k: int = 12, seed: str = "7") -> DataFrame:
    """Of each stratum the ``k`` rows of the smallest hashes of their keys, with their rank. The same rows in every run."""
    draw = F.md5(F.concat(F.lit(seed), F.col(key).cast("string")))
    place = F.row_number().over(Window.partitionBy(stratum).orderBy(draw, key))
    return rows.withColumn("rank", place).where(F.col("rank") <= k)


def in_context(tokens: DataFrame, terms: list[str], reach: int = 7, most: int = 60) -> DataFrame:
    """(token, doc_id, pos, before, after, rank): the first ``most`` places of each term with ``reach`` tokens on either side.

    Only documents that hold a term are put in order.
    """
    hits = tokens.where(F.col("token").isin(*terms)).select("doc_id").distinct()
    rows = tokens.join(hits, "doc_id", "left_semi")
    place = Window.partitionBy("doc_id").orderBy("pos")
    around = lambda a, b: F.array_join(F.collect_list("token").over(place.rowsBetween(a, b)), " ")
    found = rows.select("token", "doc_id", "pos", around(-reach, -1).alias("before"), around(1, reach).alias("after")).where(F.col("token").isin(*terms))
    rank = F.row_number().over(Window.partitionBy("token").orderBy("doc_id", "pos"))
    return found.withColumn("rank", rank).where(F.col("rank") <= most)


def set_differences(a: DataFrame, b: DataFrame, key: str, shown: int = 20) -> DataFrame:
    """(side, n, keys): keys that one table has alone, counted whole and listed up to ``shown``."""

    def of(side: str, alone: DataFrame) -> DataFrame:
        # counted by all tasks; of the keys no task hands on more than are shown
        first = alone.orderBy(key).limit(shown).agg(F.array_sort(F.collect_list(key)))
        return alone.agg(F.count(F.lit(1)).alias("n")).where("n > 0").select(F.lit(side).alias("side"), "n", first.scalar().alias("keys"))

    x, y = a.select(key), b.select(key)
    return of("left", x.exceptAll(y)).unionByName(of("right", y.exceptAll(x)))


def overlap(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """(side, n): how many distinct keys only the left table has, only the right, and both. Null keys are left out."""
    both = a.select(F.col(key).alias("k"), F.lit(1).alias("l"), F.lit(0).alias("r")).unionByName(b.select(F.col(key).alias("k"), F.lit(0).alias("l"), F.lit(1).alias("r")))
    each = both.where(F.col("k").isNotNull()).groupBy("k").agg(F.max("l").alias("l"), F.max("r").alias("r"))
    side = F.when(F.col("l") > F.col("r"), "left").when(F.col("l") < F.col("r"), "right").otherwise("both")
    return each.groupBy(side.alias("side")).agg(F.count(F.lit(1)).alias("n"))


def extremes(rows: DataFrame, value: str, n: int, *ties: str) -> DataFrame:
    """The ``n`` rows of the largest and of the smallest ``value``, with ``end`` (top, bottom); nulls have no part."""
    known = rows.where(F.col(value).isNotNull())
    top = known.orderBy(F.desc(value), *ties).limit(n).withColumn("end", F.lit("top"))
    return top.unionByName(known.orderBy(F.asc(value), *ties).limit(n).withColumn("end", F.lit("bottom")))


def best_quotes(docs: DataFrame, terms: DataFrame, by: str, stem: int = 6, shortest: int = 40, longest: int = 400, opening: int = 240) -> DataFrame:
    """(by, doc_id, quote, hits): for each group the sentence that holds most of its terms' stems.

    ``docs`` has by, doc_id and text, ``terms`` by and token. Of sentences of a
    fit length the first with most hits wins, in the order of doc_id and of the
    text; a group without one is quoted by the opening of its first text, with
    0 hits. The stems are written first, so that Spark can send them to the
    texts; each text hands on its best sentence, or its opening, alone.
    """
    stems = stored(terms.groupBy(F.col(by).alias("__by")).agg(F.array_sort(F.collect_set(F.substring(F.lower("token"), 1, stem))).alias("stems")))
    rows = docs.where(F.col("text").isNotNull()).join(stems, F.col(by) == F.col("__by"))

    def hits(quote: Column) -> Column:
        return let(F.lower(quote), lambda low: F.size(F.filter("stems", lambda s: F.contains(low, s))))

    fit = lambda q, i: F.when(F.length(q).between(shortest, longest), F.struct((-hits(q)).alias("h"), i.alias("i"), q.alias("quote")))
    best = F.array_min(F.transform(F.split(F.trim("text"), r"(?<=[.!?])\s+"), fit))
    each = rows.select(by, "doc_id", best.alias("b"), F.substring("text", 1, opening).alias("opening"))
    # texts with a sentence of a fit length come first, by its hits; the others by doc_id alone
    found = F.struct(F.col("b").isNull().alias("none"), F.coalesce("b.h", F.lit(0)).alias("h"), "doc_id", F.coalesce("b.i", F.lit(0)).alias("i"), F.coalesce("b.quote", "opening").alias("quote"))
    return each.groupBy(by).agg(F.min(found).alias("q")).select(by, "q.doc_id", "q.quote", (-F.col("q.h")).alias("hits"))


def shortened(text, words: int, mark: str = " [...]"):
    """The first ``words`` words of a text, marked if there are more."""
    parts = F.filter(F.split(text, r"\s+"), lambda w: w != "")
    return F.when(F.size(parts) > words, F.concat(F.array_join(F.slice(parts, 1, words), " "), F.lit(mark))).otherwise(text)


def evidence(quotes: DataFrame, members: DataFrame, by: str, key: str, text: str = "text", prefix: int = 60) -> DataFrame:
    """(by, quote, key, found): for each group's quote the first member whose single-spaced text has its first ``prefix`` characters, else the first member.

    ``quotes`` has one row a group; they are written first, so that Spark knows
    their size: where they are few they are sent to the texts, which are then
    not brought together by group. Each task hands on one row a group.
    """
    asked = stored(quotes.select(F.col(by).alias("__by"), F.col("quote").alias("__quote")))
    rows = members.join(asked, F.col(by) == F.col("__by"))
    has = F.contains(F.trim(F.regexp_replace(text, r"\s+", " ")), F.substring("__quote", 1, prefix))
    out = rows.groupBy(by).agg(F.first("__quote").alias("quote"), F.min(F.when(has, F.col(key))).alias("__hit"), F.min(key).alias("__first"))
    return out.select(by, "quote", F.coalesce("__hit", "__first").alias(key), F.col("__hit").isNotNull().alias("found"))


def all_labels(a: DataFrame, b: DataFrame, label: str) -> DataFrame:
    """(label): the labels that either table has; null is none."""
    return a.select(label).unionByName(b.select(label)).where(F.col(label).isNotNull()).distinct()
