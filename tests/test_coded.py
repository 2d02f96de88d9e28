"""Texts as numbers of words: the same words, pairs, scores and phrases as by arrays of words, without a lambda or a shuffle of texts."""

import random
import sys
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from rostrum.operators import coded, collocation, tokens
from rostrum.plans import catalogue
from rostrum.storage import shared_dir, stored

CONNECTORS = ("of", "the", "és", "not-a-word", "averylongconnector")


@pytest.fixture(scope="module")
def docs(spark):
    """Texts with null, empty and wordless ones, words of 1 to 20 bytes, runs of marks, and letters of 1 to 4 bytes."""
    rng = random.Random(5)
    words = ["of", "the", "és", "averylongconnector", "a", "B", "ÉG", "exactly8", "ninechars", "költségvetési", "hiány", "𐐀𐐁", "漢字", "x²y", "l'eau", "über", "İz", "ΣΑΣ", "é", "don_t", "7"]
    made = [None, "", ".", "  ", "?!.", "the", "the of the", "a", "a.b", " a  b ", "a..b!c"]
    made += ["".join(rng.choice(words) + rng.choice([" ", " ", " ", " ", ", ", ". ", "! ", "\n", " - ", "?"]) for _ in range(rng.randrange(60))) for _ in range(150)]
    return spark.createDataFrame(list(enumerate(made)), "doc_id long, text string").repartition(3, "doc_id")


@pytest.fixture(scope="module")
def rows(docs):
    return coded.coded(docs)


def same(a, b):
    return sorted(map(str, a.collect())) == sorted(map(str, b.select(a.columns).collect())) and a.count() > 0


def sentences(rows):
    """How often each sentence that has words occurs."""
    out = Counter()
    for words, ids in coded._read([pa.RecordBatch.from_pydict({"file": [r["file"] for r in rows.collect()]})]):
        words = words.to_pylist()
        assert ids[-1] == -1 and set(ids) == {-1, *range(len(words))} and len(set(words)) == len(words)
        out.update(tuple(words[k] for k in s) for s in np.split(ids, np.flatnonzero(ids < 0)) for s in [s[s >= 0]] if len(s))
    return out


def listed(docs):
    return Counter(tuple(s) for r in tokens.listed(docs.where("text IS NOT NULL")).collect() for s in r["sentences"] if s)


def counted(sentences):
    out = Counter()
    for s, n in sentences.items():
        for w in s:
            out[w] += n
    return out


def test_words_are_those_of_the_text(docs, rows):
    assert sentences(rows) == listed(docs)
    assert {r["token"]: r["n"] for r in coded.words(rows).collect()} == counted(listed(docs))


def test_letters_are_those_of_the_jvm(spark):
    """Every character between two letters."""
    known = [chr(c) for c in (*range(0xD800), *range(0xE000, 0x110000))]
    texts = ["".join(f"a{c}b" for c in known[k : k + 1500]) for k in range(0, len(known), 1500)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert sentences(coded.coded(df)) == listed(df)


@pytest.mark.parametrize(("connectors", "min_count", "scoring"), [((), 1, "default"), ((), 9, "npmi"), (CONNECTORS, 1, "npmi"), (CONNECTORS, 2, "default")])
def test_scores_of_numbers(docs, rows, connectors, min_count, scoring):
    want = collocation.pair_scores(tokens.listed(docs), connectors, min_count, scoring=scoring)
    got = collocation.pair_scores(rows, connectors, min_count, scoring=scoring)
    assert same(got.drop("score"), want.drop("score"))
    scores = {(r["a"], r["between"], r["b"]): r["score"] for r in want.collect()}
    assert {(r["a"], r["between"], r["b"]): r["score"] for r in got.collect()} == pytest.approx(scores, nan_ok=True)


@pytest.mark.parametrize("connectors", [(), CONNECTORS])
def test_fused_numbers(docs, rows, connectors):
    phrases = stored(collocation.pair_scores(tokens.listed(docs), connectors, 3, 0.0).where("a < b"))
    want = collocation.fused(tokens.by_sentence(tokens.listed(docs)), phrases, connectors, "#")
    out = collocation.fused(rows, phrases, connectors, "#")
    assert out._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1 and out.columns == ["file"]  # neither texts nor pairs are dealt out
    got = sentences(out)
    assert got == Counter(tuple(r["tokens"]) for r in want.collect())
    assert any("#" in w for s in got for w in s)
    fused = out  # and once more, over words that have the mark
    again = stored(collocation.pair_scores(fused, connectors, 2, 0.0))
    counts = counted(sentences(collocation.fused(fused, again, connectors, "#")))
    assert {r["token"]: r["n"] for r in coded.fused_words(fused, again, connectors, "#").collect()} == counts
    assert {r["token"]: r["n"] for r in coded.fused_words(fused, again, connectors, "#", "#").collect()} == {w: n for w, n in counts.items() if "#" in w}
    assert any(w.count("#") > 1 for w in counts)


def test_marks_that_could_not_be_told_apart(rows, spark):
    phrases = spark.createDataFrame([("a", "", "b")], "a string, between string, b string")
    for mark in ("", " ", "\n", "x", "##", "é"):
        with pytest.raises(ValueError):
            collocation.fused(rows, phrases, (), mark)


def test_the_query_takes_no_sentence_apart_by_lambdas(spark, sf_dir, monkeypatch):
    def refuse(*_):
        raise AssertionError("pairs by lambdas")

    want = Counter()
    rows = tokens.by_sentence(tokens.listed(spark.read.parquet(f"{sf_dir}/documents.parquet")))
    for _ in range(2):
        rows = stored(collocation.fused(rows, collocation.pair_scores(rows, catalogue.CONNECTORS, 8, 0.05), catalogue.CONNECTORS, "#"))
    for r in rows.select(F.explode("tokens").alias("t")).where("t LIKE '%#%'").collect():
        want[r["t"]] += 1
    monkeypatch.setattr(collocation, "sentence_pairs", refuse)
    got = {r["token"]: (r["raw"], r["order"]) for r in catalogue.phrase_fusion(spark, sf_dir).collect()}
    assert got == {t: (n, t.count("#") + 1) for t, n in want.items()} and got


def test_what_is_looked_up_is_read_by_blocks(spark):
    """Numbers above and below 2^63, first numbers that agree, and blocks that end between these."""
    rng = random.Random(1)
    pairs = {(rng.choice([0, 1, 5, 2**63 - 1, 2**63, 2**64 - 1]) if rng.random() < 0.5 else rng.randrange(2**64), rng.randrange(9)) for _ in range(4000)}
    signed = [tuple(x - 2**64 if x >= 2**63 else x for x in p) for p in pairs]
    path = f"{shared_dir(spark)}/numbers"
    coded._in_order(spark.createDataFrame(signed, "x long, y long").repartition(3), path)
    asked = [*pairs, *((x, y + 9) for x, y in pairs)]
    values = [np.array([p[k] for p in asked], np.uint64) for k in range(2)]
    for most in (1, 1 << 20):
        table = coded.Table(path, "x", "y", most=most)
        for _ in range(2):
            assert table.holds(values).tolist() == [True] * len(pairs) + [False] * len(pairs)
    assert not coded.Table(path, "x").holds([np.array([2, 3], np.uint64)]).any()


def test_blocks_make_one_piece(monkeypatch):
    texts = pa.array(["a b", "c", "", "d a.b", "b c"] * 20, pa.large_string())
    letters = np.zeros(0x110000, bool)
    letters[list(b"abcd")] = True

    def piece(size):
        monkeypatch.setattr(coded, "BLOCK", size)
        bounds, data = coded._bytes(texts)
        made = [coded._coded(data[bounds[x] : bounds[y]], bounds[x : y + 1] - bounds[x], letters) for x, y in coded._blocks(bounds)]
        return len(made), coded.Piece(*coded._merged(made), ("c",))

    (one, whole), (several, cut) = piece(1 << 20), piece(7)
    assert one == 1 < several
    assert whole.words.take(pa.array(whole.ids)).equals(cut.words.take(pa.array(cut.ids)))
    assert whole.texts(whole.key).to_pylist() == cut.texts(cut.key).to_pylist() == ["a b", "d a"] * 20


@pytest.mark.skipif(sys.byteorder != "little", reason="words are read as numbers")
def test_digests_differ():
    strings = pa.array([f"{a}{b}" for a in "abcdef" for b in ("", "a", "b", " a", "a ", "á")] + ["x" * k for k in range(1, 600)], pa.large_string())
    assert len(np.unique(coded.digests(strings)[:, 0])) == len(np.unique(coded.digests(strings)[:, 1])) == len(strings)
    assert (coded.digests(strings.slice(7, 9)) == coded.digests(strings)[7:16]).all()
