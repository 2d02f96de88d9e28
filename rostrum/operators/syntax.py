"""Dependency distances: mean dependency distance and mean hierarchical distance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.arrays import let
from .tokens import is_punctuation

SHORTEST, LONGEST = 3, 120


def closed_up(tokens: DataFrame, longest: int = LONGEST) -> DataFrame:
    """A row for each sentence: doc_id, sent_id, length, heads and mended.

    ``dep_id`` and ``head`` count from 1 in the sentence, head 0 is the root's;
    a null head means that there is no parse and fails. Punctuation is left
    out and the rest numbered anew; ``heads`` are the new numbers in order. A
    head outside the sentence, or a punctuation mark, makes the token a root;
    ``mended`` counts these. Sentences above ``longest`` have no heads.

    Rows are tokens, or sentences with ``parsed``, an array of (dep_id, head,
    and xpostag where there is one), which are closed up without a shuffle.
    """
    known = lambda head: F.coalesce(head, F.raise_error(F.lit("a token has no parse")).cast("int"))
    if "parsed" in tokens.columns:
        tagged = "xpostag" in tokens.schema["parsed"].dataType.elementType.names
        kept = F.filter("parsed", lambda x: ~is_punctuation(x["xpostag"])) if tagged else F.col("parsed")
        rows = tokens.select("doc_id", "sent_id", F.array_sort(F.transform(kept, lambda x: F.struct(x["dep_id"].alias("dep_id"), known(x["head"]).alias("head")))).alias("__t"))
        rows = rows.where(F.size("__t") > 0) if tagged else rows
    else:
        checked = tokens.withColumn("head", known(F.col("head")))
        kept = checked.where(~is_punctuation(F.col("xpostag"))) if "xpostag" in tokens.columns else checked
        rows = kept.groupBy("doc_id", "sent_id").agg(F.array_sort(F.collect_list(F.struct("dep_id", "head"))).alias("__t"))
    heads = let(F.transform("__t", lambda x: x["dep_id"]), lambda ids: F.transform("__t", lambda x: F.array_position(ids, x["head"]).cast("int")))
    rows = rows.withColumn("heads", F.when(F.size("__t") <= longest, heads))
    mended = F.size(F.filter(F.arrays_zip("heads", "__t"), lambda x: (x["heads"] == 0) & (x["__t"]["head"] != 0)))
    return rows.select("doc_id", "sent_id", F.size("__t").alias("length"), "heads", F.when(F.col("heads").isNotNull(), mended).otherwise(0).alias("mended"))


def depths(heads: Column, longest: int = LONGEST) -> Column:
    """For each token the steps to its root (0 for it), null in a circle.

    Each round doubles how far a token has climbed, so a sentence costs its
    length times the logarithm of the longest path.
    """
    start = F.struct(heads.alias("to"), F.transform(heads, lambda h: F.when(h > 0, 1).otherwise(0)).alias("n"))

    def step(acc, _):
        further = F.transform(acc["to"], lambda h: F.when(h > 0, F.get(acc["to"], h - 1)).otherwise(0))
        more = F.zip_with(acc["n"], acc["to"], lambda n, h: n + F.when(h > 0, F.get(acc["n"], h - 1)).otherwise(0))
        return F.struct(further.alias("to"), more.alias("n"))

    rounds = F.sequence(F.lit(1), F.lit(max(1, longest - 1).bit_length()))
    return F.aggregate(rounds, start, step, lambda acc: F.zip_with(acc["n"], acc["to"], lambda n, h: F.when(h == 0, n)))


def distances(sentences: DataFrame, shortest: int = SHORTEST, longest: int = LONGEST) -> DataFrame:
    """(doc_id, n_sentences, n_tokens, too_short, too_long, mdd, mhd) of ``closed_up`` sentences.

    Both are means over sentences of the means over their tokens but the root:
    of the distance to the head, and of the depth. Documents without a
    sentence of a fit length have nulls. A sentence is one row, so documents
    are summed up in one aggregation.
    """
    fit = F.col("length").between(shortest, longest)
    rows = sentences.withColumn("__depths", F.when(fit, depths(F.col("heads"), longest)))
    gaps = F.transform("heads", lambda h, i: F.when(h > 0, F.abs(h - i - 1)))
    below = F.zip_with("heads", "__depths", lambda h, d: F.when(h > 0, d))
    total = lambda xs: F.aggregate(F.array_compact(xs), F.lit(0), lambda a, x: a + x)
    mean = lambda xs: F.try_divide(total(xs).cast("double"), F.size(F.array_compact(xs)).cast("double"))
    rows = rows.withColumns({"__mdd": F.when(fit, mean(gaps)), "__mhd": F.when(fit, mean(below))})
    return rows.groupBy("doc_id").agg(
        F.count_if(fit).alias("n_sentences"), F.coalesce(F.sum(F.when(fit, F.col("length").cast("long"))), F.lit(0)).alias("n_tokens"),
        F.count_if(F.col("length") < shortest).alias("too_short"), F.count_if(F.col("length") > longest).alias("too_long"),
        F.avg("__mdd").alias("mdd"), F.avg("__mhd").alias("mhd"),
    )


def weighted(rows: DataFrame, by: str) -> DataFrame:
    """(by, n_docs, n_tokens, mdd, mhd): means by tokens of documents that have them."""
    ok = rows.where(F.col("mdd").isNotNull())
    mean = lambda c: F.try_divide(F.sum(F.col(c) * F.col("n_tokens")), F.sum(F.col("n_tokens").cast("double"))).alias(c)
    return ok.groupBy(by).agg(F.count(F.lit(1)).alias("n_docs"), F.sum("n_tokens").alias("n_tokens"), mean("mdd"), mean("mhd"))


