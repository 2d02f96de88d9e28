"""URL filters: a rule list, and logistic regression on hashed character n-grams.

DataFrame and ML operations of the JVM only. Rules name hosts with all their
subdomains and a prefix of the path; the longest that fits decides. Where none
does, a logistic regression decides that was trained on a small labelled table
of URLs, over the hashed character n-grams of host and path.
"""

from __future__ import annotations

from functools import reduce

from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import HashingTF
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
HOST_AND_PATH = r"(?s)^.*?://([^/?#]*)([^?#]*)"

#: (pattern, verdict): host and path prefix.
RULES = (("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow"))

#: The small labelled table: fixed words of names, fronts, endings and paths, which ``labelled_urls`` puts together.
BLOCKED_NAMES = (
    ("discount", "instant", "hot", "xxx", "lucky", "mega", "easy", "cracked", "bonus", "nude", "vip", "millionaire", "wholesale", "freebie", "spammy", "winning", "cash", "sexy", "budget", "promo"),
    ("viagra", "cialis", "pills", "pharma", "slots", "poker", "jackpot", "casino", "bets", "betting", "win", "payday", "loans", "replica", "escorts", "adult", "cams", "keygen", "warez", "followers", "backlinks", "spam", "ads", "popunder", "clickbank", "spins", "prizes"),
)
ALLOWED_NAMES = (
    ("city", "national", "open", "royal", "public", "modern", "northern", "river", "central", "family", "county", "student", "oldtown", "young", "winter", "better", "ancient", "maritime", "village", "addison"),
    ("library", "museum", "archive", "school", "journal", "garden", "hospital", "orchestra", "observatory", "bakery", "college", "weather", "parliament", "cinema", "chess", "railway", "recipes", "hiking", "education", "farmers", "athletics", "alphabet", "windmill", "brigade", "casework", "window", "spectrum"),
)
TAILS = ("", "-now", "247", "hub", "-zone", "online", "-group")
#: What made-up names are built of: a name nobody has seen is no reason to block.
ONSETS = ("b", "br", "c", "ch", "d", "dr", "f", "g", "gr", "h", "k", "l", "m", "n", "p", "pr", "qu", "r", "s", "sh", "st", "t", "th", "tr", "v", "w", "z")
VOWELS = ("a", "e", "i", "o", "u", "ea", "ee", "ie", "io", "ou")
CODAS = ("", "", "n", "r", "s", "t", "l", "nd", "nt", "st", "ng", "ck", "ble", "sh", "tion")
MADE_UP = 2400
BLOCKED_WEIGHT = 4.0
#: Scores from which a URL is blocked: names of unseen words lie near 0 unless some of their grams speak for a block.
THRESHOLD = 0.1
FRONTS = ("", "www.", "m.", "blog.", "shop.", "en.")
ENDINGS = (".com", ".org", ".info", ".example.com", ".example.org", ".co.uk", ".de", ".fr")
PATHS = ("", "/", "/en/120", "/fr/45.html", "/de/981/", "/es/7", "/index.html", "/2021/03/")
BLOCKED_PATHS = ("/buy-now", "/free-bonus", "/download/setup.exe", "/promo/win")
ALLOWED_PATHS = ("/about", "/news/archive", "/articles/12", "/opening-hours")


def labelled_urls(spark: SparkSession) -> DataFrame:
    """(name, a, word, host, path, label): label 1 is to be blocked.

    Its size is fixed: names of a first word, a last and a tail that both labels have, and ``MADE_UP`` names of
    syllables that mean nothing, which are allowed; each with three of the
    fronts, endings and paths by turns, the same for both labels, but for
    every third path of names that mean something. ``a`` and ``word`` are a name's first and last word,
    by which the table may be parted so that what is held out is of words unseen.
    """
    pick = lambda words, at: F.element_at(F.array(*map(F.lit, words)), (F.pmod(at, F.lit(len(words))) + 1).cast("int"))
    parts = []
    for label, (first, last), own in ((1.0, BLOCKED_NAMES, BLOCKED_PATHS), (0.0, ALLOWED_NAMES, ALLOWED_PATHS)):
        made = spark.range(len(first) * len(last) * 3).withColumn("name", F.expr("id DIV 3"))
        name, turn = F.col("name"), F.col("name") * 7 + F.col("id")
        words = made.select(pick(first, F.expr(f"name DIV {len(last)}")).alias("a"), pick(last, name).alias("word"), pick(TAILS, name).alias("tail"), F.col("id") % 3 == 2, pick(FRONTS, turn), pick(ENDINGS, turn + F.expr("name DIV 5")), pick(PATHS, turn + F.expr("id DIV 11")), pick(own, turn))
        words = words.toDF("a", "word", "tail", "own", "front", "ending", "path", "own_path").withColumn("name", F.concat("a", F.lit("-"), "word", "tail"))
        parts.append(words.select("name", "a", "word", F.concat("front", "name", "ending").alias("host"), F.when(F.col("own"), F.col("own_path")).otherwise(F.col("path")).alias("path"), F.lit(label).alias("label")))
    made = spark.range(MADE_UP * 3).withColumn("name", F.expr("id DIV 3"))
    of = lambda words, k: pick(words, F.xxhash64(F.col("name"), F.lit(k)))
    syllable = lambda k: F.concat(of(ONSETS, 3 * k), of(VOWELS, 3 * k + 1), of(CODAS, 3 * k + 2))
    turn = F.xxhash64("id", F.lit("turn"))
    words = made.select(syllable(0).alias("a"), F.concat(syllable(1), F.when(F.col("name") % 2 == 0, syllable(2)).otherwise("")).alias("word"), pick(FRONTS, turn), pick(ENDINGS, F.shiftright(turn, 8)), pick(PATHS, F.shiftright(turn, 16)))
    words = words.toDF("a", "word", "front", "ending", "path").withColumn("name", F.concat("a", "word"))
    parts.append(words.select("name", "a", "word", F.concat("front", "name", "ending").alias("host"), "path", F.lit(0.0).alias("label")))
    parts.append(spark.range(1).select(F.lit("").alias("name"), F.lit("").alias("a"), F.lit("").alias("word"), F.lit("").alias("host"), F.lit("").alias("path"), F.lit(0.0).alias("label")))
    return reduce(DataFrame.unionByName, parts)


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty without ``://`` and for null."""
    return F.translate(F.coalesce(F.regexp_extract(url, HOST_AND_PATH, 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end; empty without ``://`` and for null."""
    return F.coalesce(F.regexp_extract(url, HOST_AND_PATH, 2), F.lit(""))


def fitting_rule(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits, and its verdict; both null if none does.

    Rules are tried from the longest; among equally long ones the later in code
    point order wins. The list is part of the plan: keep it to some hundreds.
    """
    pick = verdict = F.lit(None).cast("string")
    for pattern, then in sorted(set(rules), key=lambda r: (len(r[0]), r[0])):
        rule_host, _, rest = pattern.partition("/")
        fits = ((host == rule_host) | host.endswith(f".{rule_host}")) & path.startswith(f"/{rest}")
        pick, verdict = F.when(fits, F.lit(pattern)).otherwise(pick), F.when(fits, F.lit(then)).otherwise(verdict)
    return pick, verdict


def grams(host: Column, path: Column, sizes: tuple[int, ...] = (3, 4, 5)) -> Column:
    """The character n-grams of ``^host$`` and of ``path$``, each marked with where it is from.

    A look-ahead takes them in one pass, however long the text.
    """

    def of(mark: str, text: Column, n: int) -> Column:
        found = F.regexp_extract_all(text, F.lit(f"(?s)(?=(.{{{n}}}))"), F.lit(1))
        return F.transform(found, lambda g: F.concat(F.lit(mark), g))

    ends = (("h", F.concat(F.lit("^"), host, F.lit("$"))), ("p", F.concat(path, F.lit("$"))))
    return F.concat(*(of(mark, text, n) for mark, text in ends for n in sizes))


def _vectors(urls: DataFrame, buckets: int) -> DataFrame:
    urls = urls.withColumn("__url_grams", grams(F.col("__url_host"), F.col("__url_path")))
    return HashingTF(numFeatures=buckets, binary=True, inputCol="__url_grams", outputCol="__url_vector").transform(urls)


def train(labelled: DataFrame, buckets: int = 1 << 16, strength: float = 2e-4) -> LogisticRegressionModel:
    """The model of a small labelled table (host, path, label); URLs to be blocked, which are fewer, weigh ``BLOCKED_WEIGHT`` each."""
    weight = F.when(F.col("label") == 1, F.lit(BLOCKED_WEIGHT)).otherwise(1.0).alias("__url_weight")
    rows = labelled.select(F.col("host").alias("__url_host"), F.col("path").alias("__url_path"), F.col("label").cast("double").alias("__url_label"), weight)
    fit = LogisticRegression(featuresCol="__url_vector", labelCol="__url_label", weightCol="__url_weight", regParam=strength, maxIter=100, standardization=False)
    return fit.fit(_vectors(rows.coalesce(1), buckets))


def judged(pages: DataFrame, model: LogisticRegressionModel, rules=RULES, url: str = "url", threshold: float = THRESHOLD) -> DataFrame:
    """Adds host, path, rule, verdict and score (the model's probability of a block).

    All columns are kept, whatever their names; one named like a new column is replaced. Null URLs
    and those without ``://`` have empty host and path, no rule, and the
    model's verdict on that. Each row is judged alone, so repeated rows agree.
    """
    kept = [c for c in pages.columns if c not in ("host", "path", "rule", "verdict", "score")]
    rows = pages.select(F.struct(*(F.col(f"`{c}`") for c in kept)).alias("__url_row"), host_of(F.col(url)).alias("__url_host"), path_of(F.col(url)).alias("__url_path"))
    names = {"featuresCol": "__url_vector", "predictionCol": "__url_predicted", "probabilityCol": "__url_odds", "rawPredictionCol": ""}
    scored = model.copy({getattr(model, k): v for k, v in names.items()}).transform(_vectors(rows, model.numFeatures))
    rule, verdict = fitting_rule(F.col("__url_host"), F.col("__url_path"), rules)
    score = vector_to_array("__url_odds")[1]
    return scored.select(
        "__url_row.*", F.col("__url_host").alias("host"), F.col("__url_path").alias("path"), rule.alias("rule"),
        F.coalesce(verdict, F.when(score >= threshold, "block").otherwise("allow")).alias("verdict"), score.alias("score"),
    )


def rules_sql(host: str, path: str, rules=RULES) -> str:
    """The rule that fits as SQL, for checks against another engine."""
    tests = [f"WHEN ({host} = '{h}' OR ends_with({host}, '.{h}')) AND starts_with({path}, '/{rest}') THEN '{p}'" for p, _ in sorted(set(rules), key=lambda r: (len(r[0]), r[0]), reverse=True) for h, _, rest in [p.partition("/")]]
    return reduce(lambda a, b: f"{a} {b}", tests, "CASE") + " END"
