"""The topic model, its keeping, keywords by embedding, class terms, guarded distributions and turbulence against plain Python."""

import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from rostrum.operators import classify, contrast, keywords, topicmodel, topics
from rostrum.sources import arrays
from rostrum.sources.annotator import hashing_encoder


@pytest.fixture(scope="module")
def points():
    rng = np.random.default_rng(4)
    centres = np.eye(6)[:3] * 4
    made = [(i, (centres[i % 3] + rng.normal(0, 0.3, 6)).tolist()) for i in range(120)]
    return made + [(200, [0.1, -3.0, 0.2, 5.0, -4.0, 1.0]), (201, [0.0] * 6), (202, [3.9, 0.1, 0.0, 2.6, 0.0, 0.1])]


@pytest.fixture(scope="module")
def vectors(spark, points):
    return spark.createDataFrame(points, "vec_id long, embedding array<double>").repartition(3)


def unit(x):
    return np.asarray(x) / max(np.linalg.norm(x), 1e-300)


@pytest.fixture(scope="module")
def model(spark, vectors):
    words = spark.createDataFrame([(i, f"t{i % 3}{w}") for i in range(120) for w in "abc"], "vec_id long, token string")
    return topicmodel.fit(vectors, lambda found: topics.class_terms(words.join(found, "vec_id"), "topic", 3), 3)


def test_outliers_and_their_topics(model, vectors, points):
    found = {r["vec_id"]: r for r in topicmodel.assigned(vectors, model.centres).collect()}
    centres = {r["topic"]: (np.array(r["vector"]), r["radius"]) for r in model.centres.collect()}
    for i, x in points:
        gap, topic = min((np.linalg.norm(unit(x) - c), t) for t, (c, _) in centres.items())
        assert abs(found[i]["distance"] - gap) < 1e-9 and found[i]["topic"] == (topic if gap <= centres[topic][1] else -1)
    assert found[200]["topic"] == -1 and len({found[i]["nearest"] for i in range(3)}) == 3


def test_reassignment(vectors, points):
    raw = {i: -1 if i >= 200 or i % 17 == 0 else i % 3 for i, _ in points}
    spark = vectors.sparkSession
    labels = spark.createDataFrame(list(raw.items()), "vec_id long, topic int")
    own = {t: unit(np.mean([x for i, x in points if raw[i] == t], axis=0)) for t in range(3)}
    for least in (0.0, 0.8):
        got = {r["vec_id"]: (r["topic"], r["reduced"]) for r in topicmodel.reassigned(labels, vectors, least).collect()}
        for i, x in points:
            like, topic = max((unit(x) @ own[t], -t) for t in range(3))
            assert got[i] == (raw[i], raw[i] if raw[i] != -1 else -topic if like >= least else -1)


def test_probabilities(vectors, points, model):
    centres = sorted((r["topic"], unit(r["vector"])) for r in model.centres.collect())
    got = defaultdict(dict)
    for r in topicmodel.probabilities(vectors, model.centres.select("topic", topics.unit(F.col("vector")).alias("vector")), 5.0).collect():
        got[r["vec_id"]][r["topic"]] = r["p"]
    for i, x in points:
        e = np.exp(5 * np.array([unit(x) @ c for _, c in centres]))
        assert [got[i][t] for t, _ in centres] == pytest.approx((e / e.sum()).tolist(), abs=1e-12)


def test_diverse_terms(spark):
    words = ["parliament", "parliaments", "parliamentary", "budget", "budgets", "health", "school", "tax", "taxes", "road"]
    rows = [(t, w, 1.0 / (k + 1), k + 1) for t in (0, 1) for k, w in enumerate(words if t else words[::-1])]
    df = spark.createDataFrame(rows, "topic int, token string, weight double, rank int")
    for diversity in (0.0, 0.5, 1.0):
        got = defaultdict(list)
        for r in topicmodel.diverse_terms(df, lambda: hashing_encoder(32), diversity, 5).orderBy("topic", "rank").collect():
            got[r["topic"]].append(r["token"])
        for t in (0, 1):
            names = [w for x, w, _, _ in rows if x == t]
            v = np.array([unit(x) for x in hashing_encoder(32)(names)])
            own, chosen = unit(v.mean(axis=0)), []
            while len(chosen) < 5:  # by the definition, over all that are left
                score = [(-np.inf if i in chosen else v[i] @ own if not chosen else (1 - diversity) * (v[i] @ own) - diversity * max(v[i] @ v[j] for j in chosen)) for i in range(len(names))]
                chosen.append(int(np.argmax(score)))
            assert got[t] == [names[i] for i in chosen]
    with pytest.raises(ValueError):
        topicmodel.diverse_terms(df, lambda: hashing_encoder(32), 1.5)


def test_a_model_is_kept_and_checked(spark, model, tmp_path):
    path = f"file://{tmp_path}/model"
    told = topicmodel.save(model, path)
    back = topicmodel.load(spark, path)
    assert back.fingerprint() == told and sorted(map(tuple, back.centres.collect())) == sorted(map(tuple, model.centres.collect()))
    names = {t: f"name {t}" for t in topicmodel.topic_terms(model.terms)}
    assert {r["topic"]: r["name"] for r in topicmodel.named(back, names, told).collect()} == names
    with pytest.raises(topicmodel.ModelMismatch, match="another topic"):
        topicmodel.named(back, names, "0" * 16)
    with pytest.raises(topicmodel.ModelMismatch, match="lacks"):
        topicmodel.named(back, names | {99: "x"}, told)
    back.terms.withColumn("token", F.concat("token", F.lit("!"))).coalesce(1).write.mode("overwrite").parquet(f"{path}/terms2")
    spark.read.parquet(f"{path}/terms2").write.mode("overwrite").parquet(f"{path}/terms")
    with pytest.raises(topicmodel.ModelMismatch, match="terms of fingerprint"):
        topicmodel.load(spark, path)
    spark.read.parquet(f"{path}/centres").where("topic > 0").write.mode("overwrite").parquet(f"{path}/centres2")
    spark.read.parquet(f"{path}/centres2").write.mode("overwrite").parquet(f"{path}/centres")
    with pytest.raises(topicmodel.ModelMismatch, match="has topics"):
        topicmodel.load(spark, path)


def test_arrays_round_trip(spark, tmp_path):
    made = np.random.default_rng(1).normal(size=(1000, 7)).astype("<f4")
    np.save(f"{tmp_path}/one.npy", made)
    got = sorted((r["row"], r["vector"]) for r in arrays.vectors(spark, f"file://{tmp_path}/one.npy", 64).collect())
    assert np.array_equal(np.array([v for _, v in got], "<f4"), made) and [k for k, _ in got] == list(range(1000))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(made)], "i long, vector array<double>").repartition(5)
    arrays.save_vectors(df, f"file://{tmp_path}/parts", order="i")
    back = sorted((r["row"], r["vector"]) for r in arrays.vectors(spark, f"file://{tmp_path}/parts", 100).collect())
    assert np.array_equal(np.array([v for _, v in back], "<f4"), made)
    np.save(f"{tmp_path}/cube.npy", np.zeros((2, 2, 2)))
    with pytest.raises(Exception, match="rows of numbers"):
        arrays.vectors(spark, f"file://{tmp_path}/cube.npy").collect()
    uneven = spark.createDataFrame([(0, [1.0]), (1, [1.0, 2.0])], "i long, vector array<double>").coalesce(1)
    with pytest.raises(Exception, match="one length"):
        arrays.save_vectors(uneven, f"file://{tmp_path}/bad")


def test_embedded_keywords(spark):
    texts = {1: ["tax budget tax reform", "health care"], 2: ["a b"], 3: [], 4: ["word"], 5: ["the tax of the land"]}
    df = spark.createDataFrame([(i, [s.split() for s in ss]) for i, ss in texts.items()], "doc_id long, sentences array<array<string>>")
    got = defaultdict(list)
    for r in keywords.embedded(df, lambda: hashing_encoder(32), 4, stopwords=("the", "of"), most_phrases=3).orderBy("doc_id", "rank").collect():
        got[r["doc_id"]].append((r["phrase"], r["score"]))
    encode = hashing_encoder(32)
    for i, ss in texts.items():
        words = " ".join(ss).split()
        kept = [w for w in words if len(w) > 1 and w not in ("the", "of")]
        phrases = {*kept, *(" ".join(p) for p in zip(kept, kept[1:], strict=False))}
        whole = unit(encode([" ".join(words)])[0])
        want = sorted((-round(float(unit(encode([p])[0]) @ whole), 4), p) for p in phrases)[:4]
        assert got[i] == [(p, pytest.approx(-s, abs=1e-4)) for s, p in want]


def test_topic_class_terms(spark):
    rng = random.Random(2)
    rows = [(rng.choice("xy"), rng.choice(["q", "d", None]), rng.choice("abcdefg")) for _ in range(400)] + [("x", "q", "only")] * 3
    df = spark.createDataFrame(rows, "topic string, role string, token string")
    n, topic_n, f = Counter(rows), Counter((t, w) for t, _, w in rows), Counter(w for *_, w in rows)
    size = Counter(t for t, *_ in rows)
    mean = sum(size.values()) / len(size)
    idf = {w: math.log(1 + mean / f[w]) for w in f}
    for tuned in (True, False):
        got = {(r["topic"], r["role"], r["rank"]): (r["token"], r["weight"]) for r in topics.topic_class_terms(df, "topic", "role", 4, tuned).collect()}
        for t, c in {(t, c) for t, c, _ in rows}:
            words = [w for w in f if topic_n[t, w]]
            total = sum(n[t, c, w] for w in words)
            there = {w: n[t, c, w] / total * idf[w] for w in words}
            raw = {w: topic_n[t, w] / size[t] * idf[w] for w in words}
            weight = {w: (there[w] / sum(there.values()) + raw[w] / sum(raw.values())) / 2 if tuned else there[w] for w in words}
            for k, w in enumerate(sorted(words, key=lambda w: (-round(weight[w], 12), w))[:4]):
                assert got[t, c, k + 1] == (w, pytest.approx(weight[w], abs=1e-12))


def scores(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, window int, label string, p double, weight double")


def test_distributions_are_guarded(spark):
    good = [(1, 0, "H", 0.9, 10.0), (1, 0, "L", 0.1, 10.0), (1, 1, "H", 0.3, 250.0), (1, 1, "L", 0.7, 250.0), (2, 0, "X", 1.0, 5.0)]
    got = {(r["doc_id"], r["label"]): r["p"] for r in classify.combined(scores(spark, good)).collect()}
    assert got == {(1, "H"): pytest.approx(84 / 260), (1, "L"): pytest.approx(176 / 260), (2, "X"): 1.0}
    bad = {
        "unlike labels": [(1, 2, "H", 0.5, 1.0)], "one twice": [(2, 0, "X", 0.5, 5.0)], "without a probability": [(3, 0, "X", None, 5.0)],
        "without a weight": [(3, 0, "X", 0.5, None)], "with several": [(3, 0, "X", 0.5, 1.0), (3, 0, "Y", 0.5, 2.0)], "positive sum": [(3, 0, "X", 1.0, 0.0)],
    }
    for why, rows in bad.items():
        with pytest.raises(Exception, match=f"document {rows[0][0]}: .*{why}"):
            classify.combined(scores(spark, good + rows)).collect()


def test_turbulence_lies_between_none_and_all(spark):
    def shares(a, b):
        df = spark.createDataFrame([(w, a.get(w, 0), b.get(w, 0)) for w in {*a, *b}], "token string, count_a long, count_b long")
        return {r["token"]: r["share"] for r in contrast.turbulence(df).collect()}

    a, b = Counter("aaaabbbccd"), Counter("eeeeffgghij")
    assert sum(shares(a, b).values()) == pytest.approx(1)
    assert sum(shares(a, a).values()) == 0
    mixed = shares(Counter("aaaabbbccdxyz"), Counter("aabbbbcceeeh"))
    assert 0 < sum(mixed.values()) < 1 and all(0 <= s <= 1 for s in mixed.values())
