"""Toxicity: gradient-boosted trees over dense features, with isotonic calibration.

Features are densities that regular expressions give in the JVM: words of a
lexicon, the same behind obfuscation, second persons near them, capitals,
punctuation, stretched and disguised words. The lexicon has a fixed part and a
part learned from labelled rows: beginnings of words that are far more frequent
in toxic texts, in whatever language. Boosted trees are fitted on the labelled
rows but for a part on which an isotonic regression is fitted, which turns
their output into a probability. Scores depend on the text alone.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import IsotonicRegression, IsotonicRegressionModel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import shared_dir, stored

#: Insults and contempt, then threats and hostility.
INSULTS = (
    "idiot", "idiots", "moron", "morons", "scum", "loser", "losers", "clown", "clowns", "stupid", "trash", "worthless",
    "pathetic", "disgusting", "dumb", "fool", "fools", "jerk", "filth", "vermin", "garbage", "imbecile", "cretin",
    "ugly", "creep", "bastard", "idiota", "imbécile", "dummkopf", "abschaum", "connard", "estúpido", "basura",
)
THREATS = ("hate", "kill", "die", "hurt", "destroy", "despise", "threat", "attack", "murder", "beat", "hasse", "déteste", "odio")
SECOND = (
    "you", "your", "yours", "yourself", "youre", "u", "ur", "du", "dich", "dir", "dein", "deine", "ihr", "euch",
    "tu", "toi", "te", "vous", "votre", "ton", "ta", "tes", "usted", "ustedes", "ti", "tú", "vosotros",
)

#: A row is held out if its hash is 0; it calibrates if 1, and trains otherwise.
FOLDS = 5
FEATURES = (
    "log_words", "insult_density", "learned_density", "learned", "threat_density", "second_density", "near_density", "obfuscated_density",
    "capital_density", "shout_density", "mark_density", "burst_density", "disguise_density", "stretch_density", "spread_density",
)


def fold_of(doc_id: Column) -> Column:
    """CRC-32 of the id as text, modulo 5; a null id counts as an empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % FOLDS


def _any(words) -> str:
    return "(?:" + "|".join(sorted(words, key=lambda w: (-len(w), w))) + ")"


def _words(pattern: str) -> str:
    """``pattern`` where no letter or digit is next to it."""
    return rf"(?<![\p{{L}}\p{{N}}]){pattern}(?![\p{{L}}\p{{N}}])"


def with_features(docs: DataFrame, learned: tuple[str, ...] = (), text: str = "text") -> DataFrame:
    """Adds ``toxic_features``: array<double> in the order of ``FEATURES``.

    ``learned`` are beginnings of lower-cased words; one that ends in ``$`` is
    a whole word.

    Each text is lower-cased once and cut into words once; expressions that
    cost much run only where cheaper ones have found something. Densities are
    per 100 words. Null, empty and wordless texts have zeros.
    """
    raw, low, words = F.coalesce(F.col(text), F.lit("")), F.col("__low"), F.col("__words")
    docs = docs.withColumn("__low", F.lower(raw))
    docs = docs.withColumn("__words", F.split("__low", r"[^\p{L}\p{N}]+"))
    n = lambda where, pattern: F.regexp_count(where, F.lit(pattern)).cast("double")
    of = lambda listed: F.size(F.filter(words, lambda w: w.isin(*listed))).cast("double")
    second = _any(SECOND)
    stems = [re.escape(w[:-1]) if w.endswith("$") else re.escape(w) + r"[\p{L}\p{N}]*+" for w in learned]
    insults, learnt = _any(INSULTS), _any(stems) if stems else "(?!)"
    bad = f"(?:{insults}|{learnt})"
    gap = r"(?:[^\p{L}\p{N}]+[\p{L}\p{N}]+){0,4}[^\p{L}\p{N}]+"
    ends = (F.get(words, 0) == "").cast("int") + ((F.size(words) > 1) & (F.element_at(words, -1) == "")).cast("int")
    counts = {
        "words": (F.size(words) - ends).cast("double"),
        "insults": of(INSULTS),
        "learned": n(low, _words(learnt)),
        "threats": of(THREATS),
        "second": of(SECOND),
        "capitals": n(raw, r"\p{Lu}+"),
        "shouts": n(raw, r"\p{Lu}{3,}"),
        "marks": n(raw, r"[!?]"),
        "disguises": n(low, r"\p{L}[0-9@$*!|]{1,3}\p{L}"),
        "stretches": n(low, r"(\p{L})\1{3,}"),
        "spreads": n(low, r"(?<![\p{L}\p{N}])\p{L}[ .*_-]\p{L}[ .*_-]\p{L}[ .*_-]\p{L}(?![\p{L}\p{N}])"),
    }
    docs = docs.withColumn("__n", F.struct(*(c.alias(k) for k, c in counts.items())))
    some = lambda when, count: F.when(when, count).otherwise(0.0)
    hit, far = F.col("__n.insults") + F.col("__n.learned") > 0, f"(?![\\p{{L}}\\p{{N}}])"
    both = n(low, _words(f"{bad}(?={gap}{second}{far})")) + n(low, _words(f"{second}(?={gap}{bad}{far})"))
    plain = F.translate("__low", "013457@$", "oieastas")
    rare = {
        "near": some(hit & (F.col("__n.second") > 0), both),
        "plain": some(F.col("__n.disguises") > 0, n(plain, _words(insults))),
        "bursts": some(F.col("__n.marks") > 1, n(raw, r"[!?]{2,}")),
    }
    docs = docs.withColumn("__r", F.struct(*(c.alias(k) for k, c in rare.items())))
    c = {k: F.col(f"__n.{k}") for k in counts} | {k: F.col(f"__r.{k}") for k in rare}
    per = lambda x: F.coalesce(F.try_divide(x * 100.0, c["words"]), F.lit(0.0))
    values = (
        F.log1p(c["words"]), per(c["insults"]), per(c["learned"]), c["insults"] + c["learned"], per(c["threats"]), per(c["second"]), per(c["near"]),
        per(F.greatest(c["plain"] - c["insults"], F.lit(0.0))), per(c["capitals"]), per(c["shouts"]), per(c["marks"]),
        per(c["bursts"]), per(c["disguises"]), per(c["stretches"]), per(c["spreads"]),
    )
    return docs.withColumn("toxic_features", F.array(*values)).drop("__low", "__words", "__n", "__r")


@dataclass(frozen=True)
class Model:
    """``trees`` is None where the labels tell nothing apart: all scores are then ``share``. Without ``calibration`` they are the trees' own."""

    learned: tuple[str, ...]
    trees: GBTClassificationModel | None
    calibration: IsotonicRegressionModel | None
    share: float = 0.0


def learn_lexicon(rows: DataFrame, most: int = 96, evidence: float = 20.0, odds: float = 40.0) -> tuple[str, ...]:
    """Beginnings of words, of 3 to 8 letters or whole, that set toxic texts apart.

    ``rows`` has text and __label, and is as large as the sample of labelled
    rows. What is counted is the distinct words before an entry, not its
    texts, so copies and near copies of a text add nothing. An entry needs a
    likelihood ratio of ``evidence`` and ``odds`` times the rate of other
    texts. Of entries that begin alike the shortest stays; at most ``most``,
    those of most evidence.
    """
    words = F.regexp_extract_all(F.lower("text"), F.lit(r"\p{L}+"), F.lit(0))
    rows = rows.where(F.col("text").isNotNull()).select(F.col("__label").alias("y"), words.alias("w"))
    pairs = F.zip_with(F.concat(F.array(F.lit("")), "w"), F.concat("w", F.array(F.lit(""))), lambda a, b: F.struct(a.alias("before"), b.alias("word")))
    pairs = rows.select("y", F.explode(pairs).alias("p")).select("y", "p.before", "p.word").where(F.length("word") >= 3)
    # a pair of words that some clean text has counts as clean
    pairs = pairs.groupBy("before", "word").agg(F.min("y").alias("y"))
    word = F.col("word")
    entries = F.array_compact(F.array(*(F.when(F.length(word) > k, F.substring(word, 1, k)) for k in range(3, 9)), F.concat(word, F.lit("$"))))
    each = pairs.select("y", "before", F.explode(entries).alias("entry")).groupBy("entry", "before").agg(F.min("y").alias("y"))
    found = each.groupBy("entry").agg(F.sum("y").alias("t"), F.sum(1 - F.col("y")).alias("c"))
    sums = pairs.agg(F.sum("y").alias("t"), F.count(F.lit(1)).alias("n")).first()
    toxic, clean = float(sums["t"] or 0), float((sums["n"] or 0) - (sums["t"] or 0))
    if not toxic or not clean:
        return ()
    share = toxic / (toxic + clean)
    n, t, c = F.col("t") + F.col("c"), F.col("t"), F.col("c")
    part = lambda x, p: F.when(x > 0, x * F.log(x / (n * F.lit(p)))).otherwise(0.0)
    found = found.withColumn("g2", 2 * (part(t, share) + part(c, 1 - share)))
    rate = (t / toxic) / ((c + 0.5) / clean)
    found = found.where((F.col("g2") >= evidence) & (rate >= odds))
    best = [r["entry"] for r in found.orderBy(F.desc("g2"), "entry").limit(most * 8).collect()]  # at most so many
    short: list[str] = []
    for entry in sorted(best, key=lambda e: (len(e), e)):
        if not any(entry.startswith(s) for s in short):
            short.append(entry)
    return tuple(sorted(sorted(short, key=best.index)[:most]))


def _vector(rows: DataFrame) -> DataFrame:
    """``toxic_features`` as the vector that the trees read."""
    wide = rows.select("*", *(F.get("toxic_features", i).alias(f"__x{i}") for i in range(len(FEATURES))))
    names = [f"__x{i}" for i in range(len(FEATURES))]
    return VectorAssembler(inputCols=names, outputCol="__vector").transform(wide).drop(*names)


def train(docs: DataFrame, labels: DataFrame, most_rows: int = 20_000, lexicon_rows: int = 6_000, trees: int = 24, depth: int = 4, seed: int = 5) -> Model:
    """Learns the lexicon, the trees and the calibration.

    ``docs`` has doc_id and text, ``labels`` doc_id and toxic (0 or 1; other
    labels are passed over, and a document with several labels counts as toxic
    if one says so). Held-out rows are never read. At most ``most_rows``
    labelled rows, those of the smallest hashes of their ids, are used, however
    large the tables; a quarter of them calibrates, the others teach
    the trees, and ``lexicon_rows`` of these the lexicon.

    Without rows of both labels to teach the trees, the model gives every text
    the share of toxic rows among all that may be learned from, 0 if there are
    none. Without rows that calibrate, scores are those of the trees.
    """
    known = labels.where(F.col("toxic").isNotNull() & (fold_of(F.col("doc_id")) != 0))
    known = known.where(F.col("toxic").isin(0, 1)).groupBy(F.col("doc_id").alias("__id")).agg(F.max("toxic").cast("double").alias("__label"))
    known = known.orderBy(F.xxhash64("__id"), "__id").limit(most_rows)
    home = shared_dir(docs.sparkSession)
    known = stored(known, f"{home}/known")  # its size is bounded by most_rows, so it may go to all tasks
    rows = docs.select("doc_id", "text").join(F.broadcast(known), F.col("doc_id") == F.col("__id")).drop("__id")
    rows = stored(rows, f"{home}/labelled")
    fold = fold_of(F.col("doc_id"))
    teach = F.col("__label").isin(0.0, 1.0) & (fold != 1)
    kinds = rows.agg(F.count_distinct(F.when(teach, F.col("__label"))).alias("n"), F.avg(F.least(F.greatest("__label", F.lit(0.0)), F.lit(1.0))).alias("share")).first()
    if kinds["n"] < 2:
        return Model((), None, None, float(kinds["share"] or 0.0))
    # the rows of the smallest hashes, by the largest of these: texts are not brought together
    first = known.where(fold_of(F.col("__id")) != 1).select(F.xxhash64("__id").alias("h")).orderBy("h").limit(lexicon_rows).agg(F.max("h")).first()[0]
    learned = learn_lexicon(rows.where((fold != 1) & (F.xxhash64("doc_id") <= F.lit(first))).select("text", "__label"))
    rows = stored(with_features(rows, learned).drop("text"), f"{home}/features")
    rows = _vector(rows)
    # the order of the rows, and so the bins and the trees, is that of their ids
    fit = rows.where(fold != 1).coalesce(1).sortWithinPartitions("doc_id", "__label")
    booster = GBTClassifier(featuresCol="__vector", labelCol="__label", maxIter=trees, maxDepth=depth, stepSize=0.2, seed=seed, maxBins=32)
    model = booster.fit(fit)
    held = model.transform(rows.where(fold == 1)).select("__label", vector_to_array("probability")[1].alias("__raw"))
    calibration = None if held.isEmpty() else IsotonicRegression(featuresCol="__raw", labelCol="__label").fit(held)
    return Model(learned, model, calibration)


def judged(docs: DataFrame, model: Model, threshold: float = 0.5, text: str = "text") -> DataFrame:
    """Adds ``score``, a probability, and ``predicted``, 1 if it is ``threshold`` or more.

    Each row is judged by its text alone, in one pass without a shuffle, so
    repeated rows agree. Columns of the new names are replaced, all others kept,
    whatever their names. Null counts as empty; empty texts have scores too.
    """
    kept = [c for c in docs.columns if c not in ("score", "predicted")]
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in kept)).alias("__row"), F.col(text).alias("__text"))
    told = lambda rows, score: rows.select("__row.*", score.alias("score"), (score >= threshold).cast("int").alias("predicted"))
    if model.trees is None:
        return told(rows, F.lit(model.share))
    rows = _vector(with_features(rows, model.learned, "__text"))
    names = {"predictionCol": "__label", "probabilityCol": "__odds", "rawPredictionCol": "__margin"}
    rows = model.trees.copy({getattr(model.trees, k): v for k, v in names.items()}).transform(rows)
    rows = rows.withColumn("__raw", vector_to_array("__odds")[1])
    if model.calibration is None:
        return told(rows, F.col("__raw"))
    rows = model.calibration.copy({model.calibration.predictionCol: "__score"}).transform(rows)
    return told(rows, F.least(F.greatest(F.col("__score"), F.lit(0.0)), F.lit(1.0)))
