"""Which sources of a language use words unlike the others: a plain relational audit.

Terms are exploded from the texts and counted; the groups (lang, source) are
crossed with the kept vocabulary of their language, so that a term that a group
lacks has a smoothed probability too; a self-join on language and term compares
the sources two by two; sums and ranks are what is reported. All arithmetic is
on integers, in billionths, so results are the same on every run and plan.
"""

from __future__ import annotations

from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import shared_dir, stored

#: What stands between terms: ASCII but for its letters. A term is a longest run of anything else.
BETWEEN = r"[\x00-\x40\x5B-\x60\x7B-\x7F]+"
#: Probabilities are counted in parts of one of so many.
UNIT = 1_000_000_000
#: A language's vocabulary is dealt to so many slices where it meets the groups, so that a large language is no hot key.
SLICES = 256


def term_counts(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, docs): occurrences, and rows that have the term at all.

    The words of a text are put in order where it lies, each beside the one
    before, and a row has a term as often as that differs; so one shuffle, of
    what each task has already added up, gives both numbers, and no lambda runs
    for a word. Terms are found by splitting at what they don't hold, which is
    linear in a text, as extracting each is not.
    """
    text = F.col("text")
    low = F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, ascii_uppercase, ascii_lowercase))
    words = docs.select("lang", "source", F.sort_array(F.split(low, BETWEEN)).alias("words"))  # one at least, be it empty
    beside = F.arrays_zip(F.col("words").alias("term"), F.concat(F.array(F.lit("")), "words").alias("before"))
    rows = words.select("lang", "source", F.inline(beside)).where("term <> ''")
    return rows.groupBy("lang", "source", "term").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("term") != F.col("before")).alias("docs"))


def share(n: Column, total: Column, kept: Column) -> Column:
    """1 + floor(UNIT * (n + 1) / (total + kept)), exact for any counts."""
    return F.lit(1).cast("long") + F.call_function("div", (n + 1).cast("decimal(19,0)") * F.lit(UNIT).cast("decimal(10,0)"), (total + kept).cast("decimal(20,0)"))


def excess(p: Column, q: Column) -> Column:
    """floor((p - q)^2 / q), for shares of at most UNIT + 1."""
    return F.call_function("div", (p - q) * (p - q), q)


def _salted(kept: DataFrame, groups: DataFrame) -> DataFrame:
    """Each kept term with each group of its language. Spark sends the groups to all tasks if they are small."""
    left = kept.withColumn("slice", F.pmod(F.xxhash64("term_no"), F.lit(SLICES)).cast("int"))
    right = groups.withColumn("slice", F.explode(F.sequence(F.lit(0), F.lit(SLICES - 1))))
    return left.join(right, ["lang", "slice"]).drop("slice")


def audited(docs: DataFrame, least_docs: int = 3, most_terms: int = 200) -> DataFrame:
    """(lang, source, part, item, value, rank) over the columns text, lang and source of ``docs``.

    Part ``pair`` has the other sources of a source's language, farthest first:
    the sum of ``excess`` of its shares over theirs, over all kept terms. Part
    ``term`` has the ``most_terms`` terms that the source uses most beyond its
    language. A language keeps the terms that ``least_docs`` of its rows have.

    Nulls count as empty strings, which are a language and a source of their
    own. Repeated rows count each. A group without terms is still compared; in a
    language without kept terms all values are 0. Values that tie are ranked by
    item, in the order of UTF-8 bytes. Other columns are not read, whatever
    their names. No rows give no rows.
    """
    home = shared_dir(docs.sparkSession)
    docs = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")))
    counts = stored(term_counts(docs), f"{home}/counts")
    kept = counts.groupBy("lang", "term").agg(F.sum("n").alias("lang_n"), F.sum("docs").alias("docs")).where(F.col("docs") >= least_docs)
    # numbers stand for terms and groups from here on: what is crossed and joined to itself has short keys
    kept = stored(kept.drop("docs").withColumn("term_no", F.monotonically_increasing_id()), f"{home}/kept")
    langs = kept.groupBy("lang").agg(F.sum("lang_n").alias("lang_total"), F.count(F.lit(1)).alias("vocabulary"))
    groups = docs.select("lang", "source").distinct().join(langs, "lang", "left").na.fill(0, ["lang_total", "vocabulary"])
    groups = stored(groups.withColumn("group_no", F.monotonically_increasing_id()), f"{home}/groups")
    found = counts.select("lang", "source", "term", "n").join(kept, ["lang", "term"])
    found = stored(found.join(groups, ["lang", "source"]), f"{home}/found")
    totals = stored(found.groupBy(F.col("group_no").alias("of")).agg(F.sum("n").alias("total")), f"{home}/totals")
    sized = groups.join(totals, F.col("group_no") == F.col("of"), "left").drop("of").na.fill(0, ["total"])

    # part pair: dense shares, then two sources of a language meet in each term
    cells = _salted(kept.select("lang", "term_no"), sized.select("lang", "group_no", "total", "vocabulary"))
    cells = cells.join(found.select("term_no", "group_no", "n"), ["term_no", "group_no"], "left")
    p = share(F.coalesce("n", F.lit(0).cast("long")), F.col("total"), F.col("vocabulary"))
    dense = stored(cells.select("term_no", "group_no", p.alias("p")), f"{home}/dense")
    a, b = dense, dense.select("term_no", F.col("group_no").alias("other_no"), F.col("p").alias("q"))
    met = a.join(b, "term_no").where(F.col("group_no") < F.col("other_no"))
    sums = met.groupBy("group_no", "other_no").agg(F.sum(excess(F.col("p"), F.col("q"))).alias("there"), F.sum(excess(F.col("q"), F.col("p"))).alias("back"))
    way = lambda *names: F.struct(*(F.col(c).alias(n) for c, n in zip(names, ("a_no", "b_no", "value"), strict=True)))
    sums = sums.select(F.inline(F.array(way("group_no", "other_no", "there"), way("other_no", "group_no", "back"))))
    others = groups.select("lang", F.col("source").alias("item"), F.col("group_no").alias("item_no"))
    pairs = groups.select("lang", "source", "group_no").join(others, "lang").where(F.col("source") != F.col("item"))
    pairs = pairs.join(sums, (F.col("group_no") == F.col("a_no")) & (F.col("item_no") == F.col("b_no")), "left")
    pairs = pairs.withColumn("value", F.coalesce("value", F.lit(0).cast("long")))

    # part term: a source against its language
    known = found.join(totals, F.col("group_no") == F.col("of"))
    known = known.withColumns({"p": share(F.col("n"), F.col("total"), F.col("vocabulary")), "q": share(F.col("lang_n"), F.col("lang_total"), F.col("vocabulary"))})
    terms = known.where("p > q").select("lang", "source", F.col("term").alias("item"), excess(F.col("p"), F.col("q")).alias("value"))

    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    part = lambda rows, name: rows.select("lang", "source", F.lit(name).alias("part"), "item", "value", rank.alias("rank"))
    # each task passes on its own first ones only, so a source with many terms is no hot window
    return part(pairs, "pair").unionByName(part(terms, "term").where(F.col("rank") <= most_terms))
