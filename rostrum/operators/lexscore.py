"""Lexicon scores: negation scope, hits, sentiment, emotion, salience, loanwords."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.arrays import let
from ..functions.maths import rate, ratio
from ..profile import HUNGARIAN, Profile

MIN_EMOTION_HITS, MIN_MENTIONS = 5, 3


def lexicon(spark: SparkSession, entries: dict[str, tuple[str, ...] | list[str]]) -> DataFrame:
    """(category, entry, n_words) of a small lexicon given as a dictionary."""
    rows = [(c, e.strip().lower(), len(e.split())) for c, es in entries.items() for e in es]
    return spark.createDataFrame(rows, "category string, entry string, n_words int").distinct()


def clauses(tokens: DataFrame) -> DataFrame:
    """(doc_id, sent_id, clause, pos, token) of tokens with ``boundary``: clauses are numbered between boundaries, which are left out."""
    run = Window.partitionBy("doc_id", "sent_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    return tokens.withColumn("clause", F.sum(F.col("boundary").cast("int")).over(run)).where("NOT boundary").drop("boundary")


def negated(tokens: DataFrame, profile: Profile = HUNGARIAN) -> DataFrame:
    """Adds ``marks``: by how many cues a token of (doc_id, sent_id, clause, pos, token) is negated.

    A forward cue negates what follows in its clause, up to the next cue,
    which is itself not negated and begins anew; a backward cue negates what
    precedes it in its clause, other cues included.
    """
    clause = Window.partitionBy("doc_id", "sent_id", "clause").orderBy("pos")
    forward = F.col("token").isin(*profile.negation_forward)
    backward = F.col("token").isin(*profile.negation_backward) if profile.negation_backward else F.lit(False)
    earlier = F.coalesce(F.max(forward.cast("int")).over(clause.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    later = F.coalesce(F.sum(backward.cast("int")).over(clause.rowsBetween(1, Window.unboundedFollowing)), F.lit(0))
    return tokens.withColumn("marks", (F.when(forward, 0).otherwise(earlier) + later).cast("int"))


def single_hits(tokens: DataFrame, words: DataFrame) -> DataFrame:
    """Tokens joined to the categories of the one-word entries of a lexicon. The lexicon is a list made by hand; Spark sends it to all tasks."""
    single = words.where("n_words = 1").select("category", F.col("entry").alias("__entry"))
    return tokens.join(single, F.col("token") == F.col("__entry")).drop("__entry")


def all_hits(tokens: Column, entries: list[str] | tuple[str, ...]) -> Column:
    """How many entries occur in an array of tokens: longer ones first, from left to right, each token used once."""
    ordered = sorted({tuple(e.lower().split()) for e in entries if e.strip()}, key=lambda e: (-len(e), e))
    single = [e[0] for e in ordered if len(e) == 1]
    of = lambda words: F.size(F.filter(words, lambda w: w.isin(*single))) if single else F.lit(0)
    if len(single) == len(ordered):
        return of(tokens)
    sizes = sorted({len(e) for e in ordered if len(e) > 1}, reverse=True)
    def from_(text: Column, k: int) -> Column:
        if k == len(sizes):
            return of(F.split(text, " +"))
        words = "|".join("  ".join(rf"\Q{w}\E" for w in e) for e in ordered if len(e) == sizes[k])
        return F.regexp_count(text, F.lit(f" (?:{words}) ")) + let(F.regexp_replace(text, f" (?:{words}) ", "  "), lambda rest: from_(rest, k + 1))

    return let(F.concat(F.lit(" "), F.array_join(tokens, "  "), F.lit(" ")), lambda text: from_(text, 0))


def text_hits(text: Column, entries: list[str] | tuple[str, ...]) -> Column:
    """``all_hits`` over lower-cased text as it stands: words are runs of letters, and no entry goes beyond its sentence.

    One expression looks for entries of several words and of one together,
    the longer first. Where entries have more lengths than that, the longest
    are taken out before shorter ones are counted.
    """
    ordered = sorted({tuple(e.lower().split()) for e in entries if e.strip()}, key=lambda e: (-len(e), e))
    sizes = sorted({len(e) for e in ordered if len(e) > 1}, reverse=True)
    of = lambda some: r"(?<!\p{L})(?:" + "|".join(r"[^\p{L}.!?]+".join(rf"\Q{w}\E" for w in e) for e in some) + r")(?!\p{L})"
    total = F.lit(0)
    for size in sizes[:-1]:
        pattern = of([e for e in ordered if len(e) == size])
        total, text = total + F.regexp_count(text, F.lit(pattern)), F.regexp_replace(text, pattern, ".")
    rest = [e for e in ordered if len(e) in (1, *sizes[-1:])]
    return total + F.regexp_count(text, F.lit(of(rest))) if rest else total


def word_count(text: Column) -> Column:
    """How many runs of letters."""
    return (F.size(F.split(text, r"\p{L}+")) - 1).cast("long")


def sided(sentence: Column, profile: Profile = HUNGARIAN) -> Column:
    """(plain, turned, n) of a lower-cased sentence as text: its words that no cue negates, those that one does, and how many words it has.

    Clauses end at commas, colons and semicolons. A forward cue negates what
    follows in its clause, itself and other cues excepted; a backward cue what
    precedes it. Words that are negated twice are in neither array.
    """

    forward = lambda w: w.isin(*profile.negation_forward)
    backward = lambda w: w.isin(*profile.negation_backward)

    def marked(words: Column) -> Column:
        first = F.array_position(F.transform(words, forward), True)
        last = F.filter(F.transform(words, lambda w, i: F.when(backward(w), i)), lambda i: i.isNotNull()) if profile.negation_backward else F.array().cast("array<int>")
        after = lambda p, q: lambda w, i: F.struct(w.alias("w"), (F.when((p > 0) & (i >= p) & ~forward(w), 1).otherwise(0) + F.size(F.filter(q, lambda k: k > i))).alias("m"))
        return let(first, lambda p: let(last, lambda q: F.transform(words, after(p, q))))

    clause = lambda c: let(F.regexp_extract_all(c, F.lit(r"\p{L}+"), F.lit(0)), marked)
    of = lambda all_, m: F.transform(F.filter(all_, lambda x: x["m"] == m), lambda x: x["w"])
    return let(F.flatten(F.transform(F.split(sentence, "[,;:]+"), clause)), lambda a: F.struct(of(a, 0).alias("plain"), of(a, 1).alias("turned"), F.size(a).alias("n")))


def document_sentiment(docs: DataFrame, positive: tuple[str, ...], negative: tuple[str, ...], profile: Profile = HUNGARIAN, balanced: bool = False, text: str = "text") -> DataFrame:
    """(doc_id, n_tokens, positive, negative, score, polarity) of documents with words, entries of several words included.

    As ``sentiment``, but each document is scored where it lies: nothing is
    shuffled.
    """
    weight = len(set(positive)) / len(set(negative)) if balanced and negative else 1.0
    cue = r"(?<!\p{L})(?:" + "|".join(rf"\Q{w}\E" for w in (*profile.negation_forward, *profile.negation_backward)) + r")(?!\p{L})"
    counted = lambda n, p, m: F.struct(*(x.cast("long").alias(c) for c, x in (("n", n), ("p", p), ("m", m))))

    def of(s: Column) -> Column:
        # in order only where a cue is
        plain = let(F.array_remove(F.split(s, r"\P{L}+"), ""), lambda w: counted(F.size(w), all_hits(w, positive), all_hits(w, negative)))
        p, m = (lambda x: all_hits(x["plain"], positive) + all_hits(x["turned"], negative)), (lambda x: all_hits(x["plain"], negative) + all_hits(x["turned"], positive))
        return F.when(F.rlike(s, F.lit(cue)), let(sided(s, profile), lambda x: counted(x["n"], p(x), m(x)))).otherwise(plain)

    rows = docs.where(F.rlike(text, F.lit(r"\p{L}"))).select("doc_id", F.filter(F.transform(F.split(F.lower(F.col(text)), r"[.!?]+"), of), lambda s: s["n"] > 0).alias("s"))
    add = lambda value, zero: F.aggregate("s", zero, lambda acc, s: acc + value(s))
    zero = F.lit(0).cast("long")
    out = rows.select(
        "doc_id", add(lambda s: s["n"], zero).alias("n_tokens"), add(lambda s: s["p"], zero).alias("positive"), add(lambda s: s["m"], zero).alias("negative"),
        (add(lambda s: (s["p"] - s["m"] * F.lit(weight)) / s["n"], F.lit(0.0)) / F.size("s")).alias("score"),
    )
    p, m = F.col("positive"), F.col("negative")
    return out.withColumn("polarity", F.coalesce(ratio(p - m, p + m), F.lit(0.0)))


def sentiment(tokens: DataFrame, positive: tuple[str, ...], negative: tuple[str, ...], balanced: bool = False) -> DataFrame:
    """(doc_id, n_tokens, positive, negative, score, polarity) of tokens with ``marks``.

    A negated hit counts for the other side; tokens that are negated twice
    match nothing but count as tokens. ``score`` is the mean over sentences of
    (positive - w negative) / tokens, with w = 1 or, if ``balanced``, the ratio
    of the lists' sizes; ``polarity`` is that of the hits alone, 0 if none.
    """
    weight = len(set(positive)) / len(set(negative)) if balanced and negative else 1.0
    plain, turned = F.col("marks") == 0, F.col("marks") == 1
    good, bad = F.col("token").isin(*positive), F.col("token").isin(*negative)
    up, down = (plain & good) | (turned & bad), (plain & bad) | (turned & good)
    sentences = tokens.groupBy("doc_id", "sent_id").agg(F.count(F.lit(1)).alias("n"), F.count_if(up).alias("p"), F.count_if(down).alias("m"))
    share = (F.col("p") - F.col("m") * F.lit(weight)) / F.col("n")
    out = sentences.groupBy("doc_id").agg(F.sum("n").alias("n_tokens"), F.sum("p").alias("positive"), F.sum("m").alias("negative"), F.avg(share).alias("score"))
    p, m = F.col("positive"), F.col("negative")
    return out.withColumn("polarity", F.coalesce(ratio(p - m, p + m), F.lit(0.0)))


def emotions(docs: DataFrame, entries: dict[str, tuple[str, ...]], min_hits: int = MIN_EMOTION_HITS) -> DataFrame:
    """(doc_id, n_tokens, a count and a rate for each category, hits, dominant, sparse) of documents (doc_id, text) with words.

    Each text is counted where it lies, entries of several words included;
    documents without hits are kept. Rates are a word's. Ties go to the first
    name.
    """
    names = list(entries)
    low = docs.where(F.rlike("text", F.lit(r"\p{L}"))).select("doc_id", F.lower("text").alias("low"))
    rows = low.select("doc_id", word_count(F.col("low")).alias("n_tokens"), *(text_hits(F.col("low"), entries[c]).cast("long").alias(c) for c in names))
    total, best = sum((F.col(c) for c in names), F.lit(0)), F.greatest(*names)
    dominant = F.coalesce(*(F.when((F.col(c) == best) & (best > 0), F.lit(c)) for c in sorted(names)))
    rates = {f"{c}_rate": F.round(ratio(F.col(c), F.col("n_tokens")), 6) for c in names}
    return rows.withColumns({**rates, "hits": total, "dominant": dominant, "sparse": total < min_hits})


def salience(docs: DataFrame, poles: dict[str, tuple[str, ...]], min_mentions: int = MIN_MENTIONS) -> DataFrame:
    """(doc_id, virtue, affirming, accusing, n_tokens, per_1000, stance, sparse) of virtues that documents (doc_id, text) mention.

    ``poles`` maps ``virtue/pole`` to entries of one or several words. ``stance``
    is the share of affirming mentions. Nothing is shuffled.
    """
    virtues = list(dict.fromkeys(p.split("/")[0] for p in poles))
    low = docs.select("doc_id", F.lower("text").alias("low"))
    hits = lambda p: text_hits(F.col("low"), poles.get(p, ())).cast("long").alias(f"__{p}")
    wide = low.select("doc_id", word_count(F.col("low")).alias("n_tokens"), *(hits(f"{v}/{p}") for v in virtues for p in ("affirming", "accusing")))
    each = F.array(*(F.struct(F.lit(v).alias("virtue"), *(F.col(f"`__{v}/{p}`").alias(p) for p in ("affirming", "accusing"))) for v in virtues))
    counts = wide.select("doc_id", F.explode(each).alias("v"), "n_tokens")
    return with_stance(counts.select("doc_id", "v.*", "n_tokens").where("affirming + accusing > 0"), min_mentions)


def affect_by_speaker(scores: DataFrame, by: str, counts: list[str]) -> DataFrame:
    """(by, documents, n_tokens, counts and their rates): sums first and then the ratio, null without words."""
    sums = scores.groupBy(by).agg(F.count(F.lit(1)).alias("documents"), F.sum("n_tokens").alias("n_tokens"), *(F.sum(c).alias(c) for c in counts))
    return sums.withColumns({f"{c}_rate": F.round(ratio(F.col(c), F.col("n_tokens")), 6) for c in counts})


def with_stance(counts: DataFrame, min_mentions: int = MIN_MENTIONS) -> DataFrame:
    both = F.col("affirming") + F.col("accusing")
    return counts.withColumns({"per_1000": rate(both, F.col("n_tokens"), 1000.0), "stance": ratio(F.col("affirming"), both), "sparse": both < min_mentions})


def loanwords(tokens: DataFrame, entries: DataFrame) -> DataFrame:
    """(doc_id, counted, matched, excluded, loan_ratio) of tokens with ``proper``: proper nouns are left out; null if all are."""
    words = entries.select(F.col("entry").alias("__entry")).distinct()
    rows = tokens.join(words, F.col("token") == F.col("__entry"), "left")
    kept = ~F.col("proper")
    out = rows.groupBy("doc_id").agg(F.count_if(kept).alias("counted"), F.count_if(kept & F.col("__entry").isNotNull()).alias("matched"), F.count_if("proper").alias("excluded"))
    return out.withColumn("loan_ratio", ratio(F.col("matched"), F.col("counted")))


def without_entries(words: DataFrame, removed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(lexicon without the one-word entries of ``removed``, audit of (entry, found))."""
    gone = removed.select(F.col("entry").alias("__gone"))
    kept = words.join(gone, (F.col("entry") == F.col("__gone")) & (F.col("n_words") == 1), "left_anti")
    present = words.where("n_words = 1").select(F.col("entry").alias("__have")).distinct()
    audit = removed.join(present, F.col("entry") == F.col("__have"), "left").select("entry", F.col("__have").isNotNull().alias("found"))
    return kept, audit
