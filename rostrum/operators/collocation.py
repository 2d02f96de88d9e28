"""Collocations: adjacent pairs, their scores, and phrases fused from them."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.arrays import let
from ..functions.maths import npmi
from ..functions.text import WORD
from ..storage import stored
from . import coded


def sentence_pairs(words: Column, connectors: tuple[str, ...] = ()) -> Column:
    """Array of (a, b, between) of one sentence's words: each that is no connector with the next that is none."""
    places = F.filter(F.transform(words, lambda w, i: F.when(~w.isin(*connectors), i)), lambda i: i.isNotNull())
    if not connectors:
        after = lambda w: F.arrays_zip(F.slice(w, F.lit(1), F.size(w) - 1).alias("a"), F.slice(w, F.lit(2), F.size(w)).alias("b"))
        return let(words, lambda w: F.when(F.size(w) > 1, F.transform(after(w), lambda p: F.struct(p["a"].alias("a"), p["b"].alias("b"), F.lit("").alias("between")))))
    made = lambda w, i, j: F.struct(F.get(w, i).alias("a"), F.get(w, j).alias("b"), F.array_join(F.slice(w, i + 2, j - i - 1), " ").alias("between"))
    ends = lambda at: F.arrays_zip(F.slice(at, F.lit(1), F.size(at) - 1).alias("i"), F.slice(at, F.lit(2), F.size(at)).alias("j"))
    return let(places, lambda at: F.when(F.size(at) > 1, F.transform(ends(at), lambda p: made(words, p["i"], p["j"]))))


def pairs(tokens: DataFrame, connectors: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, sent_id, a, b, between): each word with the next of its sentence; connectors may stand between but not at the ends.

    Documents as arrays (``tokens.listed``, or its ``by_sentence``) are paired where they lie; nothing is shuffled.
    """
    if "sentences" in tokens.columns or "tokens" in tokens.columns:
        rows = tokens.select("doc_id", F.posexplode("sentences").alias("sent_id", "tokens")) if "sentences" in tokens.columns else tokens
        return rows.select("doc_id", "sent_id", F.inline(sentence_pairs(F.col("tokens"), connectors)))
    place = Window.partitionBy("doc_id", "sent_id").orderBy("pos")
    rows = tokens
    if connectors:
        # a run of connectors is kept with the word after it
        run = F.sum(F.when(~F.col("token").isin(*connectors), 1).otherwise(0)).over(place.rowsBetween(Window.unboundedPreceding, -1))
        rows = tokens.withColumn("__run", F.coalesce(run, F.lit(0)))
        inner = rows.where(F.col("token").isin(*connectors)).groupBy("doc_id", "sent_id", "__run")
        inner = inner.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "token"))), lambda x: x["token"]), " ").alias("__between"))
        rows = rows.where(~F.col("token").isin(*connectors)).join(inner, ["doc_id", "sent_id", "__run"], "left")
    else:
        rows = rows.withColumn("__between", F.lit(None).cast("string"))
    after = rows.select("doc_id", "sent_id", F.col("token").alias("a"), F.lead("token").over(place).alias("b"), F.coalesce(F.lead("__between").over(place), F.lit("")).alias("between"))
    return after.where(F.col("b").isNotNull())


def text_pairs(text: Column, apart: int = 1, beside: str = r"[^\p{L}.!?]") -> Column:
    """Array of (a, b): each word of lower-cased text with the one ``apart`` words on, with nothing but ``beside`` between words.

    Two expressions with a look-ahead, for the one word and the other: as many
    matches, in one order. Nothing is shuffled, and no lambda runs for a word.
    """
    gap = rf"{beside}++\p{{L}}++" * (apart - 1) + rf"{beside}++"
    found = F.lit(rf"(\p{{L}}++)(?={gap}(\p{{L}}++))")
    return F.arrays_zip(F.regexp_extract_all(text, found, F.lit(1)).alias("a"), F.regexp_extract_all(text, found, F.lit(2)).alias("b"))


def pairs_in_texts(docs: DataFrame, connectors: tuple[str, ...] = ()) -> DataFrame:
    """(met) of (text): "a b" or "a between b" for each of ``pairs`` in the words of lower-cased texts, straight from these.

    A word, or the end of a sentence, is found together with the connectors
    before it, and each lies beside the next. Nothing is shuffled, no lambda
    runs, and only what may begin with a connector is taken apart.
    """
    known = [c for c in connectors if c.isalpha()]  # no other can be a word
    before = rf"(?:(?:{'|'.join(known)})(?!\p{{L}})[^\p{{L}}.!?]*+)*+" if known else ""
    found = F.regexp_extract_all(F.concat(F.lower("text"), F.lit(".")), F.lit(rf"{before}(?:\p{{L}}++|[.!?])"), F.lit(0))
    found = docs.select(found.alias("found"))
    rows = found.select(F.inline(F.arrays_zip(F.col("found").alias("x"), F.slice("found", F.lit(2), F.size("found")).alias("y"))))
    ends = lambda c: F.endswith(c, F.lit(".")) | F.endswith(c, F.lit("!")) | F.endswith(c, F.lit("?"))
    rows = rows.where(~ends(F.col("x")) & ~ends(F.col("y")))
    a, rest = F.col("x"), F.col("y")
    if known:
        begins = lambda c: reduce(or_, (F.startswith(c, F.lit(k)) for k in known))
        a = F.when(begins(a), F.regexp_extract(a, r"\p{L}++$", 0)).otherwise(a)
        rest = F.when(begins(rest), F.regexp_replace(rest, r"\P{L}++", " ")).otherwise(rest)
    return rows.select(F.concat(a, F.lit(" "), rest).alias("met"))


def pair_counts(docs: DataFrame, connectors: tuple[str, ...] = (), min_count: int = 1) -> DataFrame:
    """(a, between, b, joint) of (text): pairs that occur ``min_count`` times or more, counted as one string each."""
    return taken_apart(pairs_in_texts(docs, connectors).groupBy("met").agg(F.count(F.lit(1)).alias("joint")).where(F.col("joint") >= min_count))


def taken_apart(counts: DataFrame) -> DataFrame:
    """(a, between, b, joint) of (met, joint)."""
    a, b = F.substring_index("met", " ", 1), F.substring_index("met", " ", -1)
    between = F.substring("met", F.length(a) + 2, F.length("met") - F.length(a) - F.length(b) - 2)
    return counts.select(a.alias("a"), between.alias("between"), b.alias("b"), "joint")


def pair_scores(tokens: DataFrame, connectors: tuple[str, ...] = (), min_count: int = 5, threshold: float | None = None, scoring: str = "npmi") -> DataFrame:
    """(a, between, b, joint, count_a, count_b, n_tokens, score) of pairs that occur ``min_count`` times or more.

    ``npmi`` or ``default``: (joint - min_count) / count_a / count_b times the
    number of types. With a threshold only pairs above it are kept. Documents
    as arrays (``tokens.listed``), as (doc_id, text), or as numbers
    (``coded.coded``) are paired where they lie, and one shuffle counts the
    pairs. Words are counted once and written.
    """
    if scoring not in ("npmi", "default"):
        raise ValueError("scoring is npmi or default")
    if "file" in tokens.columns:
        single, met, total = coded.word_and_pair_counts(tokens, connectors, min_count)
        joint, every = taken_apart(met), coded.words(tokens)
    elif "text" in tokens.columns:
        joint = pair_counts(tokens, connectors, min_count)
        tokens = tokens.select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit(WORD), F.lit(0))).alias("token"))
    else:
        joint = pairs(tokens, connectors).groupBy("a", "between", "b").agg(F.count(F.lit(1)).alias("joint")).where(F.col("joint") >= min_count)
        if "sentences" in tokens.columns or "tokens" in tokens.columns:
            tokens = tokens.select(F.explode(F.flatten("sentences") if "sentences" in tokens.columns else "tokens").alias("token"))
    if "file" not in tokens.columns:
        single = every = stored(tokens.groupBy("token").agg(F.count(F.lit(1)).alias("n")))
        total = single.agg(F.sum("n"))
    left = single.select(F.col("token").alias("a"), F.col("n").alias("count_a"))
    right = single.select(F.col("token").alias("b"), F.col("n").alias("count_b"))
    out = joint.join(left, "a").join(right, "b").withColumn("n_tokens", total.scalar())
    if scoring == "npmi":
        score: Column = npmi(F.col("joint"), [F.col("count_a"), F.col("count_b")], F.col("n_tokens"))
    else:
        types = every.agg(F.count(F.lit(1))).scalar()
        score = (F.col("joint") - min_count) / F.col("count_a") / F.col("count_b") * types
    out = out.select("a", "between", "b", "joint", "count_a", "count_b", "n_tokens", score.alias("score"))
    return out if threshold is None else out.where(F.col("score") > threshold)


def fused(sentences: DataFrame, phrases: DataFrame, connectors: tuple[str, ...] = (), mark: str = "_") -> DataFrame:
    """(doc_id, sent_id, tokens): phrases put together from left to right, each token once.

    ``sentences`` has tokens as an array, ``phrases`` (a, between, b). The
    phrases that a sentence could hold are joined to it, so none has to hold
    them all. Phrases are written first: where Spark knows them to be few it
    sends them to the sentences, else pairs are dealt out by digests of 8
    bytes. Digests that agree by chance do no harm, since phrases are compared
    as text. Texts as numbers (``coded.coded``) are fused by ``coded.fused``.
    """
    if "file" in sentences.columns:
        return coded.fused(sentences, phrases, connectors, mark)
    digest = F.xxhash64("a", "between", "b")
    listed = stored(phrases.select(digest.alias("__digest"), F.concat_ws("\t", "a", "between", "b").alias("__phrase")))
    of = F.transform(sentence_pairs(F.col("tokens"), connectors), lambda p: F.xxhash64(p["a"], p["between"], p["b"]))
    two = sentences.select("doc_id", "sent_id", F.explode(F.array_distinct(of)).alias("__of"))
    met = two.join(listed, F.col("__of") == F.col("__digest"))
    known = met.groupBy("doc_id", "sent_id").agg(F.collect_set("__phrase").alias("__known"))
    rows = sentences.join(known, ["doc_id", "sent_id"], "left").withColumn("__known", F.coalesce("__known", F.array().cast("array<string>")))
    conn = F.array(*(F.lit(c) for c in connectors)) if connectors else F.array().cast("array<string>")
    none = F.array().cast("array<string>")
    start = F.struct(none.alias("out"), F.lit(None).cast("string").alias("head"), none.alias("inner"))

    def step(acc, t):
        is_connector = F.array_contains(conn, t)
        phrase = acc["head"].isNotNull() & F.array_contains(F.col("__known"), F.concat_ws("\t", acc["head"], F.array_join(acc["inner"], " "), t))
        flushed = F.concat(acc["out"], F.when(acc["head"].isNull(), none).otherwise(F.array(acc["head"])), acc["inner"])
        whole = F.array_join(F.concat(F.array(acc["head"]), acc["inner"], F.array(t)), mark)
        on = F.struct(acc["out"].alias("out"), acc["head"].alias("head"), F.concat(acc["inner"], F.array(t)).alias("inner"))
        made = F.struct(F.concat(acc["out"], F.array(whole)).alias("out"), F.lit(None).cast("string").alias("head"), none.alias("inner"))
        fresh = F.struct(flushed.alias("out"), t.alias("head"), none.alias("inner"))
        alone = F.struct(F.concat(flushed, F.array(t)).alias("out"), F.lit(None).cast("string").alias("head"), none.alias("inner"))
        return F.when(is_connector & acc["head"].isNotNull(), on).when(is_connector, alone).when(phrase, made).otherwise(fresh)

    def finish(acc):
        return F.concat(acc["out"], F.when(acc["head"].isNull(), none).otherwise(F.array(acc["head"])), acc["inner"])

    return rows.select("doc_id", "sent_id", F.aggregate("tokens", start, step, finish).alias("tokens"))


def component_npmi(ngrams: DataFrame, unfused: DataFrame, n_tokens: int, mark: str = "#") -> DataFrame:
    """Adds ``npmi`` to n-grams (token, raw) from the counts (token, raw) of their parts; null if a part has none."""
    parts = ngrams.select("token", "raw", F.explode(F.split("token", rf"\Q{mark}\E")).alias("part"))
    counts = unfused.select(F.col("token").alias("of"), F.col("raw").alias("n"))
    parts = parts.join(counts, F.col("part") == F.col("of"), "left").groupBy("token", "raw")
    sums = parts.agg(F.count(F.lit(1)).alias("k"), F.count("n").alias("found"), F.sum(F.log(F.col("n") / F.lit(float(n_tokens)))).alias("alone"))
    both = F.log(F.col("raw") / F.lit(float(n_tokens)))
    value = F.when((F.col("found") == F.col("k")) & (F.col("k") > 1), F.try_divide(both - F.col("alone"), -(F.col("k") - 1) * both))
    return sums.select("token", "raw", value.alias("npmi"))
