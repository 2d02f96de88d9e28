import random
import re
from collections import Counter, defaultdict

from rostrum.llm import divergence

SCHEMA = "doc_id long, text string, lang string, source string"


def brute(rows, least_docs=3, most_terms=200):
    """The audit in plain Python; Python's integers are exact."""
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    counts, docs, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for _, text, lang, source in rows:
        lang, source = lang or "", source or ""
        words = [w.translate(lower) for w in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text or "")]
        groups[lang].add(source)
        counts[lang, source].update(words)
        docs[lang].update(set(words))
    out = []
    for lang, sources in groups.items():
        kept = [t for t, n in docs[lang].items() if n >= least_docs]
        whole = Counter()
        for s in sources:
            whole.update(counts[lang, s])
        shares = {}
        for s, c in [*((s, counts[lang, s]) for s in sources), (None, whole)]:
            n = sum(c[t] for t in kept)
            shares[s] = {t: 1 + 10**9 * (c[t] + 1) // (n + len(kept)) for t in kept}
        f = lambda p, q: (p - q) * (p - q) // q
        for s in sources:
            pair = [(-sum(f(shares[s][t], shares[o][t]) for t in kept), o.encode(), o) for o in sources if o != s]
            term = [(-f(shares[s][t], shares[None][t]), t.encode(), t) for t in kept if counts[lang, s][t] and shares[s][t] > shares[None][t]]
            for part, found in (("pair", sorted(pair)), ("term", sorted(term)[:most_terms])):
                out += [(lang, s, part, item, -value, k + 1) for k, (value, _, item) in enumerate(found)]
    return sorted(out)


def made(n=300):
    rng = random.Random(5)
    words = ["the", "The", "THE", "née", "NÉE", "straße", "İst", "a1b", "x_y", "🙂", "日本", "é", *(f"w{chr(97 + i)}" for i in range(26))]
    rows = [(i, " ".join(rng.choice(words) for _ in range(rng.randint(0, 40))), rng.choice(["en", "en", "fr"]), rng.choice(["a", "a", "a", "b", "ß", "Z"])) for i in range(n)]
    rows += [(None, None, None, None), (1, "", "en", "no words"), (2, "1 2 3", "fr", None), (3, "alone alone alone", "xx", "a"), (4, None, "xx", "b")]
    rows += [(5, "copy of a text", "en", "copies")] * 4 + [(6, "long " * 20000 + "tail", "en", "a")]
    return rows


def test_equals_brute_force(spark, clash):
    rows = made()
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    want = brute(rows)
    assert sorted(map(tuple, divergence.audited(df).collect())) == want
    assert sorted(map(tuple, divergence.audited(clash(df).drop("slice")).collect())) == want


def test_terms_are_counted_without_a_lambda(spark):
    rows = [(1, "The the THE a", "en", "x"), (2, "É é the", "en", "x"), (3, "A b", "en", "y"), (4, "", "en", "y"), (5, " the. ", "fr", "x")]
    counts = divergence.term_counts(spark.createDataFrame(rows, SCHEMA))
    assert "lambda" not in counts._jdf.queryExecution().analyzed().toString()
    want = [("en", "x", "a", 1, 1), ("en", "x", "the", 4, 2), ("en", "x", "É", 1, 1), ("en", "x", "é", 1, 1), ("en", "y", "a", 1, 1), ("en", "y", "b", 1, 1), ("fr", "x", "the", 1, 1)]
    assert sorted(map(tuple, counts.collect())) == sorted(want)


def test_a_language_without_kept_terms_has_zeros(spark):
    rows = [(1, "alone", "xx", "a"), (2, "other", "xx", "b"), (3, "", "xx", "c")]
    got = divergence.audited(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted(map(tuple, got)) == brute(rows)
    assert {r["value"] for r in got} == {0} and len(got) == 6


def test_limits_and_ties(spark):
    rows = [(i, " ".join(f"t{chr(97 + k)}" for k in range(i % 7 + 1)), "en", "ab"[i % 2]) for i in range(40)]
    df = spark.createDataFrame(rows, SCHEMA)
    assert sorted(map(tuple, divergence.audited(df, 2, 3).collect())) == brute(rows, 2, 3)


def test_nothing_gives_nothing(spark):
    assert divergence.audited(spark.createDataFrame([], SCHEMA)).collect() == []


def test_shares_are_exact_for_huge_counts(spark):
    from pyspark.sql import functions as F

    rows = [(10**15 - 1, 3 * 10**15, 7), (10**12, 10**12, 1), (0, 10**17, 10**9)]
    got = spark.createDataFrame(rows, "n long, t long, v long").select(divergence.share(F.col("n"), F.col("t"), F.col("v")).alias("p")).collect()
    assert [r["p"] for r in got] == [1 + 10**9 * (n + 1) // (t + v) for n, t, v in rows]
