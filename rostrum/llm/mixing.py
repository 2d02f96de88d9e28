"""Mixing sources to target weights by capped water-filling.

DataFrame operations only. A source's share of the mix is its weight's share of
all words, but no source is repeated more than ``max_epochs`` times: sources
above their cap are clamped to it, what they leave is dealt out again over the
others by weight, and so on until no source is above. Each source then takes
every document ``floor(target / size)`` times and a seeded part of its
documents once more, so that its words come as near to its target as whole
documents allow.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import shared_dir, stored

#: Seeded hashes are cut into so many slices a source to find the cut-off without a sort of the source.
SLICES = 1 << 12

#: A document is large if it has more than one part in so many of its source's words.
LARGE = 200


def word_count(text: Column) -> Column:
    """Maximal runs of other than space and U+0009 to U+000D; null counts 0."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def cycling_weights(sources: DataFrame, cycle: tuple[float, ...] = (1.0, 2.0, 3.0)) -> DataFrame:
    """Weights for the one-row-a-source table ``sources``: by code point, null last, the cycle repeating."""
    n = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    picks = F.array(*(F.lit(float(w)) for w in cycle))
    return sources.withColumn("weight", F.get(picks, n % len(cycle)))


def water_fill(sources: DataFrame, budget: float, max_epochs: float = 3.0) -> DataFrame:
    """Adds ``target`` to the table (source, source_size, weight), one row a source.

    Round by round, sources whose share is above ``max_epochs`` times their
    size are clamped, and the rest of ``budget`` is shared by weight over those
    that are left; only two sums a round reach the driver. Weights that are
    null or not positive, and empty sources, get 0. If all are clamped, the
    budget can't be met and every target is its cap.
    """
    cap = F.col("source_size") * F.lit(float(max_epochs))
    live = (F.coalesce(F.col("weight"), F.lit(0.0)) > 0) & (F.col("source_size") > 0)
    level, clamped = 0.0, -1
    while True:
        # a source is clamped once the level (words for each unit of weight) reaches its cap; levels only rise
        full = live & (F.col("weight") * F.lit(level) >= cap) if clamped >= 0 else F.lit(False)
        row = sources.agg(
            F.sum(F.when(full, cap).otherwise(0.0)).alias("taken"),
            F.sum(F.when(live & ~full, F.col("weight")).otherwise(0.0)).alias("open"),
            F.sum(F.when(full, 1).otherwise(0)).alias("full"),
        ).first()
        if not row["open"] or row["full"] == clamped:
            break
        clamped, level = row["full"], max(level, (budget - row["taken"]) / row["open"])
    target = F.when(live, F.least(F.col("weight") * F.lit(level), cap)).otherwise(0.0)
    return sources.withColumn("target", target if row["open"] else F.when(live, cap).otherwise(0.0))


def _drawn(docs: DataFrame, seed: int) -> DataFrame:
    """Adds the size, the seeded draw and its slice."""
    key = F.md5(F.coalesce(F.col("text"), F.lit("")))
    draw = F.xxhash64(F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), key)
    docs = docs.withColumns({"__mix_source": F.col("source").cast("string"), "__mix_size": word_count(F.col("text")), "__mix_draw": draw})
    return docs.withColumn("__mix_slice", F.pmod(F.shiftright("__mix_draw", 20), F.lit(SLICES)))


def _cuts(drawn: DataFrame, weights, max_epochs: float, share: float, home: str) -> DataFrame:
    """One row a source: its size and target, its whole epochs, and where in the order of draws its last part ends.

    Large documents, of more than one part in ``LARGE`` of their source, are
    chosen first; the others then make up for what the large ones are off.
    """
    sources = drawn.groupBy(F.col("__mix_source").alias("source")).agg(F.sum("__mix_size").alias("source_size"))
    sources = stored(weights(sources).select("source", "source_size", "weight"), f"{home}/weights")
    total = sources.agg(F.coalesce(F.sum("source_size"), F.lit(0)).alias("n")).first()["n"]
    plan = water_fill(sources, float(total) * share, max_epochs).drop("weight").withColumnRenamed("source", "of")
    epochs = F.coalesce(F.expr("try_divide(target, source_size)"), F.lit(0.0))
    plan = plan.withColumn("whole", F.least(F.floor(epochs), F.lit(int(max_epochs))))
    plan = stored(plan.withColumn("rest", F.col("target") - F.col("whole") * F.col("source_size")), f"{home}/plan")

    known = drawn.join(plan, F.col("__mix_source").eqNullSafe(F.col("of")))
    is_large = F.col("__mix_size") * LARGE > F.col("source_size")
    order = Window.partitionBy("of").orderBy("__mix_draw", "doc_id", "__mix_size")
    large = known.where(is_large)  # fewer than LARGE rows a source
    large = large.withColumn("words", F.sum("__mix_size").over(Window.partitionBy("of")))
    large = large.withColumn("goal", F.col("rest") * F.col("words") / F.col("source_size"))
    ahead = F.coalesce(F.sum("__mix_size").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    got = F.sum(F.when(F.col("__ahead") + F.col("__mix_size") / 2 <= F.col("goal"), F.col("__mix_size")).otherwise(0))
    large = large.withColumn("__ahead", ahead).groupBy(F.col("of").alias("large_of"))
    large = large.agg(F.first("goal").alias("large_rest"), got.alias("large_taken"))
    plan = plan.join(large, F.col("large_of").eqNullSafe(F.col("of")), "left").drop("large_of")
    plan = stored(plan.withColumn("small_rest", F.col("rest") - F.coalesce("large_taken", F.lit(0))), f"{home}/rests")

    slices = known.where(~is_large).groupBy(F.col("of").alias("slice_of"), F.col("__mix_slice").alias("slice"))
    run = Window.partitionBy("slice_of").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    cut = slices.agg(F.sum("__mix_size").alias("words")).withColumn("before", F.coalesce(F.sum("words").over(run), F.lit(0)))
    cut = cut.join(plan, F.col("slice_of").eqNullSafe(F.col("of")))
    cut = cut.where((F.col("before") <= F.col("small_rest")) & (F.col("small_rest") < F.col("before") + F.col("words")))
    cut = cut.select("slice_of", F.col("slice").alias("cut_slice"), F.col("before").alias("cut_before"))
    plan = plan.join(cut, F.col("slice_of").eqNullSafe(F.col("of")), "left").drop("slice_of", "rest", "large_taken")
    return stored(plan.select(*(F.col(c).alias(f"__mix_{c}") for c in plan.columns)), f"{home}/cuts")


def _chosen(drawn: DataFrame, cuts: DataFrame, max_epochs: float) -> DataFrame:
    """Adds ``__mix_copies``. ``cuts`` has one row a source; Spark sends it to all tasks if it is small."""
    joined = drawn.join(cuts, F.col("__mix_source").eqNullSafe(F.col("__mix_of"))).drop("__mix_of")
    is_large = F.col("__mix_size") * LARGE > F.col("__mix_source_size")
    near = ~is_large & F.coalesce(F.col("__mix_slice") == F.col("__mix_cut_slice"), F.lit(False))
    # a source whose rest is none or all of its small documents has no cut
    below = F.coalesce(F.col("__mix_slice") < F.col("__mix_cut_slice"), F.col("__mix_small_rest") > 0)
    clear = joined.where(~near & ~is_large).withColumn("__mix_extra", below.cast("int"))
    # only large documents and those in the slice of the cut, one part in SLICES of a source, are put in order
    order = Window.partitionBy("__mix_source", "__mix_large").orderBy("__mix_draw", "doc_id", "__mix_size")
    ahead = F.coalesce(F.sum("__mix_size").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    edge = joined.where(near | is_large).withColumn("__mix_large", is_large).withColumn("__mix_ahead", ahead)
    # the document at the cut is taken if that brings the source nearer to its target
    middle = F.col("__mix_ahead") + F.col("__mix_size") / 2
    taken = F.when(F.col("__mix_large"), middle <= F.col("__mix_large_rest"))
    taken = taken.otherwise(F.col("__mix_cut_before") + middle <= F.col("__mix_small_rest"))
    out = clear.unionByName(edge.withColumn("__mix_extra", taken.cast("int")).drop("__mix_ahead", "__mix_large"))
    copies = F.least(F.col("__mix_whole") + F.col("__mix_extra"), F.floor(F.lit(float(max_epochs))))
    return out.withColumn("__mix_copies", copies.cast("int"))


def plan_mix(docs: DataFrame, weights=cycling_weights, max_epochs: float = 3.0, share: float = 1.0, seed: int = 17) -> DataFrame:
    """How often the mix takes each document: doc_id, source, size, source_size, target, copies.

    One row for each input row. ``docs`` has doc_id, text and source; other
    columns are not read, whatever their names. ``weights`` is a function that
    adds ``weight`` to the table of sources (source, source_size), ``share``
    the size of the mix as a part of all words.

    Null texts and texts without words have size 0 and are taken as often as
    the source's whole part says. Null sources are one source. Repeated rows
    are drawn together and taken one by one. No rows give no rows.
    """
    home = shared_dir(docs.sparkSession)
    drawn = stored(_drawn(docs.select("doc_id", "text", "source"), seed).drop("text", "source"), f"{home}/drawn")
    out = _chosen(drawn, _cuts(drawn, weights, max_epochs, share, home), max_epochs)
    names = {"source": "source", "size": "size", "source_size": "source_size", "target": "target", "copies": "copies"}
    return out.select("doc_id", *(F.col(f"__mix_{c}").alias(n) for c, n in names.items()))


def mixed(docs: DataFrame, weights=cycling_weights, max_epochs: float = 3.0, share: float = 1.0, seed: int = 17) -> DataFrame:
    """The mix itself: the rows of ``docs`` with all their columns, each as many times as ``plan_mix`` says.

    Columns may have any names: a row travels as one value beside the
    operator's own. The texts are scanned twice and never shuffled, but for
    those in the slice of a source's cut.
    """
    home = shared_dir(docs.sparkSession)
    whole = docs.select("doc_id", "text", "source", F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"))
    drawn = _drawn(whole, seed).drop("text", "source")
    narrow = stored(drawn.drop("row"), f"{home}/drawn")
    out = _chosen(drawn, _cuts(narrow, weights, max_epochs, share, home), max_epochs).where("__mix_copies > 0")
    out = out.withColumn("__mix_copy", F.explode(F.sequence(F.lit(1), F.col("__mix_copies"))))
    return out.select("row.*")
