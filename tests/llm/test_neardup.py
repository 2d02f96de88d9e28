"""Near-duplicate classes against comparing all pairs, and signatures against their theory."""

import random
import re
from collections import Counter

import numpy as np
import pytest
from cases import prose

from rostrum.llm import bagminhash, neardup, shingles


def bag(text):
    words = re.findall(shingles.WORD, (text or "").lower())
    return Counter(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else Counter()


def similarity(a, b):
    low = sum((a & b).values())
    return low / (sum(a.values()) + sum(b.values()) - low) if a and b else 0.0


def brute(rows):
    """{(doc_id, text): smallest id of its class}."""
    texts = sorted({t or "" for _, t in rows})
    bags = [bag(t) for t in texts]
    parent = list(range(len(texts)))

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for i in range(len(texts)):
        for j in range(i):
            if find(i) != find(j) and similarity(bags[i], bags[j]) >= 0.8:
                parent[find(i)] = find(j)
    least: dict = {}
    for d, t in rows:
        c = find(texts.index(t or ""))
        if d is not None:
            least[c] = min(least.get(c, d), d)
    return sorted((str(d), str(least.get(find(texts.index(t or ""))))) for d, t in rows)


@pytest.fixture(scope="module")
def families(spark):
    """Families whose members are near the source but not near each other, chains, and texts that repeat a line."""
    rng = random.Random(2)
    rows = []
    for _ in range(12):
        source = prose(rng, 120).split(" ")
        for _ in range(rng.randint(1, 14)):
            copy = list(source)
            for _ in range(rng.randint(0, 4)):
                copy[rng.randrange(len(copy))] = f"new{rng.randint(0, 9999)}"
            rows.append(" ".join(copy))
        if rng.random() < 0.5:
            rows.append(" ".join(source))
    chain = prose(rng, 100).split(" ")
    for _ in range(8):
        chain = [*chain[3:], *prose(rng, 3).split(" ")]
        rows.append(" ".join(chain))
    line = prose(rng, 7)
    rows += [". ".join([line] * n) for n in (3, 20, 22, 60, 200)]
    rng.shuffle(rows)
    return [(i, t) for i, t in enumerate(rows)]


@pytest.mark.parametrize("options", [{}, {"queries": 1, "stream": 2}])
def test_classes_match_all_pairs(spark, docs, families, clash, options):
    given = [(r["doc_id"], r["text"]) for r in docs.collect()] + [(d + 1000, t) for d, t in families]
    df = spark.createDataFrame(given, "doc_id long, text string").repartition(5)
    out = neardup.near_duplicates(clash(df), **options).collect()
    assert sorted((str(r["doc_id"]), str(r["class_id"])) for r in out) == brute(given)
    sizes = Counter(r["class_id"] for r in out)
    assert all(r["n_docs"] == sizes[r["class_id"]] for r in out if r["class_id"] is not None)


def test_one_of_each(spark, docs, families, clash):
    given = [(r["doc_id"], r["text"]) for r in docs.collect()] + [(d + 1000, t) for d, t in families]
    df = clash(spark.createDataFrame(given, "doc_id long, text string"))
    out = neardup.one_of_each(df)
    assert out.columns == df.columns
    kept = sorted(str(r["doc_id"]) for r in out.collect())
    assert kept == sorted({c for _, c in brute(given)})


def altered(n, words=150):
    """Near copies of one text: words changed, put in and left out at random, so that many are no longer near it."""
    rng = random.Random(5)
    source = prose(rng, words).split(" ")
    rows = []
    for i in range(n):
        copy = list(source)
        for _ in range(rng.randint(0, 8)):
            k, how = rng.randrange(len(copy)), rng.random()
            copy[k : k + (how < 0.85)] = prose(rng, 1 + (how > 0.85)).split(" ")[: int(how > 0.15) + (how > 0.85)]
        rows.append((i, " ".join(copy)))
    return rows


def test_a_family_of_near_copies_matches_all_pairs(spark):
    given = altered(220, 60)
    df = spark.createDataFrame(given, "doc_id long, text string").repartition(3)
    for options in ({}, {"queries": 3, "stream": 7}):
        out = neardup.near_duplicates(df, **options).collect()
        assert sorted((str(r["doc_id"]), str(r["class_id"])) for r in out) == brute(given)


def with_passage(n):
    """``altered`` copies, every other one of a source of which one passage was changed."""
    rows, rng = altered(n), random.Random(6)
    passage, words = prose(rng, 20), altered(1)[0][1].split(" ")
    return [(i, t.replace(" ".join(words[60:63]), passage, 1) if i % 2 else t) for i, t in rows]


@pytest.mark.parametrize("family", [altered, with_passage])
def test_rows_grow_with_a_family_and_not_with_its_square(spark, monkeypatch, family):
    real, settled, rows = neardup.stored, neardup._settled, {}

    def counted(df, path, *rest):
        out, name = real(df, path, *rest), path.rsplit("/", 1)[1]
        if name in ("pairs", "left", "apart", "met", "more"):
            rows[name] = out.count()
        return out

    def entered(df, *rest):
        df = df.cache()
        rows["settled"] = rows.get("settled", 0) + df.count()
        return settled(df, *rest)

    monkeypatch.setattr(neardup, "stored", counted)
    monkeypatch.setattr(neardup, "_settled", entered)
    sums = []
    for n in (500, 2000):
        rows.clear()
        neardup.near_duplicates(spark.createDataFrame(family(n), "doc_id long, text string").repartition(4)).count()
        sums.append(dict(rows))
    for name, n in sums[1].items():
        assert n < 5 * max(sums[0][name], 500), sums  # 4 in proportion, 16 with the square


def test_columns_of_helper_names_stay(spark):
    df = spark.createDataFrame([(1, "a b c d e f", "x", "y", "z"), (2, "a b c d e f", "u", "v", "w")], "doc_id long, text string, __key string, __id string, __pick string")
    assert [tuple(r) for r in neardup.one_of_each(df).collect()] == [(1, "a b c d e f", "x", "y", "z")]


def test_signatures_estimate_weighted_similarity():
    rng = np.random.default_rng(1)
    for most in (1, 3, 60):
        e = rng.integers(0, 1 << 63, 300).astype(np.uint64)
        a = rng.integers(0, most + 1, 300)
        b = np.where(rng.random(300) < 0.8, a, rng.integers(0, most + 1, 300))
        s = bagminhash.signatures(np.r_[e[a > 0], e[b > 0]], np.r_[a[a > 0], b[b > 0]], np.array([(a > 0).sum(), (b > 0).sum()]), 8192)
        want = np.minimum(a, b).sum() / np.maximum(a, b).sum()
        assert abs((s[0] == s[1]).mean() - want) < 4 * np.sqrt(want * (1 - want) / 8192)


def test_signatures_do_not_depend_on_the_batch():
    texts = ["alpha beta gamma delta epsilon zeta " * 3, "", "one two", "alpha beta gamma delta epsilon zeta eta"]
    whole = bagminhash.signatures(*shingles.bags(texts), 32)
    for i, t in enumerate(texts):
        assert (bagminhash.signatures(*shingles.bags([t]), 32)[0] == whole[i]).all()
    assert (whole[1] == np.uint64(0xFFFFFFFFFFFFFFFF)).all()


def test_bags_match_words(texts):
    h, w, n = shingles.bags(texts)
    at = 0
    for text, k in zip(texts, n.tolist(), strict=True):
        assert sorted(w[at : at + k].tolist()) == sorted(bag(text).values())
        at += k
    assert len(h) == at


def test_components_of_a_long_chain(spark):
    from rostrum.llm.common import shared_dir

    edges = [(bytes([k]), bytes([k + 1])) for k in range(40) if k != 20]
    nodes = spark.createDataFrame([(bytes([k]),) for k in range(42)], "key binary")
    out = neardup.components(nodes, spark.createDataFrame(edges, "a binary, b binary"), shared_dir(spark))
    got = {r["key"][0]: r["label"][0] for r in out.collect()}
    assert got == {k: 0 if k <= 20 else 21 if k <= 40 else 41 for k in range(42)}


def test_no_rows(no_docs):
    assert neardup.near_duplicates(no_docs).count() == 0
    assert neardup.one_of_each(no_docs).count() == 0


def test_batch_size_of_the_session_stays(spark, docs):
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, "5000")
    try:
        neardup.near_duplicates(docs.select("doc_id", "text")).count()
        assert spark.conf.get(key) == "5000"
    finally:
        spark.conf.set(key, before)
