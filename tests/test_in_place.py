"""Work that stays inside a document is done where its text lies: the same rows as by tokens, without a shuffle."""

import random
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from rostrum.operators import bundle, classify, collocation, evaluate, events, frequency, keywords, readability, syntax, tokens, topics
from rostrum.sources import annotator, readers


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def shuffles(df):
    return plan(df).count("Exchange hashpartitioning") + plan(df).count("Exchange rangepartitioning")


@pytest.fixture(scope="module")
def docs(spark):
    """Documents as arrays: of no words, of one, with empty sentences, and of many words."""
    rng = random.Random(3)
    made = {1: [], 2: [[]], 3: [["one"]], 4: [["a"] * 7, [], ["a", "b"]]} | {d: [[rng.choice("a bb ccc dddd eeeee ő žž".split()) for _ in range(rng.randrange(12))] for _ in range(rng.randrange(9))] for d in range(5, 30)}
    return made, spark.createDataFrame(list(made.items()), "doc_id long, sentences array<array<string>>").coalesce(3)


@pytest.fixture(scope="module")
def long(spark, docs):
    rows = [(d, s, p, t) for d, ss in docs[0].items() for p, (s, t) in enumerate((s, t) for s, ts in enumerate(ss) for t in ts)]
    return spark.createDataFrame(rows, "doc_id long, sent_id int, pos int, token string")


def same(a, b):
    return sorted(map(str, a.collect())) == sorted(map(str, b.select(a.columns).collect())) and a.count() > 0


def test_percentiles_are_rounded_as_shares(spark):
    got = {r["v"]: r["percentile"] for r in bundle.percentiles(spark.createDataFrame([(float(k),) for k in range(1, 201)], "v double"), "v").collect()}
    assert got[57.0] == 28.0  # 100 * (57 / 200) is a little less than 28.5
    assert all(abs(p - v / 2) <= 0.5 for v, p in got.items())


def test_annotated_tables_are_cut_where_they_lie(spark):
    payloads = {1: "form\tid\na\t1\r\n  \n\nb\t_\nc\n\n", 2: "id\tform\n\n1\tx\nshort\n\n\nlate\n2\ty", 3: "form", 4: "", 5: None}
    out = readers.annotated_tsv(spark.createDataFrame(list(payloads.items()), "doc_id long, payload string"))
    got = sorted(tuple(r) for r in out.select("doc_id", "sent_id", "pos", "form").collect())
    assert got == [(1, 0, 0, "a"), (1, 1, 1, "b"), (1, 1, 2, "c"), (2, 0, 0, "x"), (2, 1, 1, "y")]
    assert shuffles(out) == 0


@pytest.mark.parametrize("window", [2, 4])
def test_cooccurrences_of_arrays(docs, long, window):
    want, got = Counter(), keywords.cooccurrences(docs[1], window)
    for d, ss in docs[0].items():
        words = [w for s in ss for w in s]
        want.update((d, *sorted((words[i], words[j]))) for i in range(len(words)) for j in range(i + 1, min(i + window, len(words))) if words[i] != words[j])
    assert {tuple(r)[:3]: r["weight"] for r in got.collect()} == want
    assert same(got, keywords.cooccurrences(long, window))
    assert shuffles(got.groupBy("doc_id").count()) == 1


def test_cooccurrences_of_parts_of_a_batch(docs):
    import pyarrow as pa

    batch = pa.RecordBatch.from_arrays([pa.array(list(docs[0])), pa.array([[w for s in ss for w in s] for ss in docs[0].values()], pa.list_(pa.string()))], ["doc_id", "words"])
    rows = lambda most: sorted(r for b in keywords._counter(4, most)(iter([batch])) for r in zip(*b.to_pydict().values(), strict=True))
    assert rows(1) == rows(25) == rows(1 << 18)


def test_leading_words(docs):
    got = keywords.leading(docs[1], 2, 2)
    counts = {d: Counter(w for s in ss for w in s if len(w) >= 2) for d, ss in docs[0].items()}
    assert {r["doc_id"]: r["keywords"] for r in got.collect()} == {d: ";".join(sorted(c, key=lambda w: (-c[w], w))[:2]) for d, c in counts.items()}
    assert shuffles(got) == 0


@pytest.mark.parametrize("size", [1, 3, 80])
def test_windows_of_arrays(docs, long, size):
    got = topics.windows(docs[1], size)
    assert same(got, topics.windows(long, size))
    assert shuffles(got) == 0


def test_weights_go_along_with_scores(docs):
    rows = topics.windows(docs[1], 3).select("doc_id", "window", F.array_join("tokens", " ").alias("text"), F.size("tokens").alias("weight"))
    scores = classify.scored_windows(rows, lambda texts: [{"x": 0.25, "y": 0.75} for _ in texts], weight="weight")
    assert shuffles(scores) == 0
    assert {tuple(r) for r in scores.select("doc_id", "window", "weight").distinct().collect()} == {tuple(r) for r in rows.select("doc_id", "window", "weight").collect()}


def test_few_quotes_are_sent_to_the_texts(spark):
    members = spark.range(500).select((F.col("id") % 2).alias("g"), "id", F.concat(F.lit("text "), "id").alias("text"))
    out = evaluate.evidence(members.groupBy("g").agg(F.max("text").alias("quote")), members, "g", "id")
    assert "SortMergeJoin" not in plan(out) and shuffles(out) == 1
    assert sorted(tuple(r) for r in out.collect()) == [(0, "text 98", 98, True), (1, "text 99", 99, True)]


def test_best_quotes_without_bringing_texts_together(spark):
    long = "x" * 30
    rows = [("a", 3, f"Tax {long} tax. Budget and tax {long}! End."), ("a", 2, f"Tax alone {long} here. Budget, tax {long}."), ("a", 1, None), ("b", 9, "Short."), ("b", 8, "Shorter"), ("c", 1, f"No {long} term.")]
    docs = spark.createDataFrame(rows, "g string, doc_id long, text string")
    terms = spark.createDataFrame([("a", "taxes"), ("a", "tax"), ("a", "budget"), ("b", "x"), ("d", "y")], "g string, token string").distinct()
    out = evaluate.best_quotes(docs, terms, "g")
    assert "SortMergeJoin" not in plan(out) and shuffles(out) == 1
    assert sorted(tuple(r) for r in out.collect()) == [("a", 2, f"Budget, tax {long}.", 2), ("b", 8, "Shorter", 0)]


def test_parsed_sentences_are_closed_up_where_they_lie(spark):
    rng = random.Random(5)
    made = [(d, s, [(i + 1, rng.randrange(n + 2), rng.choice(["[/N]", "[Punct]"])) for i in range(n)]) for d in range(4) for s, n in enumerate([0, 1, 2, 5, 9])]
    arrays = spark.createDataFrame(made, "doc_id long, sent_id int, parsed array<struct<dep_id int, head int, xpostag string>>")
    got, want = syntax.closed_up(arrays), syntax.closed_up(arrays.select("doc_id", "sent_id", F.inline("parsed")))
    assert same(got, want) and shuffles(got) == 0 and shuffles(syntax.distances(got)) == 1
    with pytest.raises(Exception, match="no parse"):
        syntax.closed_up(spark.createDataFrame([(1, 0, [(1, None)])], "doc_id long, sent_id int, parsed array<struct<dep_id int, head int>>")).collect()


@pytest.mark.parametrize("window", [1, 4, 100])
def test_mattr_of_arrays(docs, long, window):
    got = readability.mattr(docs[1], window)
    assert same(got, readability.mattr(long, window))
    assert shuffles(got) == 0


def test_stop_words_of_arrays(docs, long):
    rows = docs[1].select("doc_id")
    got = frequency.document_stopwords(docs[1], rows, 0.5, 2)
    assert shuffles(got) < shuffles(frequency.document_stopwords(long, rows, 0.5, 2))
    assert same(got, frequency.document_stopwords(long, rows, 0.5, 2))


def test_words_and_types(docs):
    each = tokens.words_and_types(docs[1])
    got = {r["doc_id"]: (r["n"], r["k"]) for r in each.groupBy("doc_id").agg(F.count_if(~F.col("once")).alias("n"), F.count_if("once").alias("k")).collect()}
    flat = {d: [w for s in ss for w in s] for d, ss in docs[0].items()}
    assert got == {d: (len(w), len(set(w))) for d, w in flat.items() if w}
    assert shuffles(each) == 0


def test_texts_of_topics_are_read_once(docs):
    rows = docs[1].select((F.col("doc_id") % 2).alias("topic"), (F.col("doc_id") % 3).alias("role"), "sentences")
    out = topics.topic_class_terms(rows, "topic", "role")
    assert "Generate" not in plan(out)
    assert same(out, topics.topic_class_terms(rows.select("topic", "role", F.explode(F.flatten("sentences")).alias("token")), "topic", "role"))


@pytest.fixture(scope="module")
def prose(spark):
    """Texts of connectors, words that begin with them, marks, breaks, accents, and long runs of one."""
    rng = random.Random(8)
    parts = ["of", "Of", "the", "THE", "de", "der", "des", "often", "y", "yes", "x", "Wort", "été", "日本", "İst", "a1b", "l'eau", ".", "!?", "...", ",", ";", " - ", "\n", "\t", "(", "²"]
    texts = ["".join(rng.choice(parts) + rng.choice([" ", " ", " ", "", ". "]) for _ in range(rng.randrange(40))) for _ in range(300)]
    texts += [None, "", ".", "of", "x of", "x of.", "x of, ", "x the of. y", "of x", "a, of;the\nb", "the " * 50_000 + "x", "x " + "the " * 50_000, "x " * 20_000]
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)


CONNECTORS = ("of", "the", "de", "der", "y", "not-a-word")


@pytest.mark.parametrize("connectors", [(), CONNECTORS])
def test_pairs_of_texts(prose, connectors):
    counts = collocation.pair_counts(prose, connectors)
    assert "lambda" not in counts._jdf.queryExecution().analyzed().toString()
    assert plan(counts).count("Exchange") == 1 + plan(prose).count("Exchange")
    want = collocation.pairs(tokens.listed(prose), connectors).groupBy("a", "between", "b").agg(F.count(F.lit(1)).alias("joint"))
    assert same(counts, want)
    assert same(collocation.pair_counts(prose, connectors, 3), want.where("joint >= 3"))


@pytest.mark.parametrize("connectors", [(), CONNECTORS])
def test_scores_of_texts(prose, connectors):
    scores = collocation.pair_scores(prose, connectors, 2)
    assert plan(scores).count("regexp_extract_all") == plan(collocation.pair_counts(prose, connectors, 2)).count("regexp_extract_all")  # words are counted once and written
    assert same(scores, collocation.pair_scores(tokens.listed(prose), connectors, 2))


def test_phrases_of_arrays(docs, long):
    sentences = tokens.by_sentence(docs[1])
    assert same(collocation.pair_scores(sentences, ("a",), 2), collocation.pair_scores(long, ("a",), 2))
    assert shuffles(collocation.pairs(sentences, ("a",))) == 0
    phrases = collocation.pair_scores(sentences, ("a",), 2, -1.0)
    out = collocation.fused(sentences, phrases, ("a",))
    assert "Window" not in plan(out) and "LeftSemi" not in plan(out)
    known = {(r["a"], r["between"], r["b"]) for r in phrases.collect()}

    def brute(words):
        done, head, inner = [], None, []
        for w in words:
            if w == "a" and head is not None:
                inner.append(w)
            elif w != "a" and head is not None and (head, " ".join(inner), w) in known:
                done, head, inner = [*done, "_".join([head, *inner, w])], None, []
            else:
                done = [*done, *([head] if head is not None else []), *inner, *([w] if w == "a" else [])]
                head, inner = None if w == "a" else w, []
        return [*done, *([head] if head is not None else []), *inner]

    assert {(r["doc_id"], r["sent_id"]): r["tokens"] for r in out.collect()} == {(d, s): brute(ws) for d, ss in docs[0].items() for s, ws in enumerate(ss) if ws}


def test_encoder_hashes_each_trigram_once(monkeypatch):
    texts = ["abcabcabc", "", "ab", "žluťoučký 𝔘𝔫𝔦", "abc"] * 20
    want = [[0.0] * 16 for _ in texts]
    for row, text in zip(want, texts, strict=True):
        for i in range(len(text) - 2):
            row[zlib.crc32(text[i : i + 3].encode()) % 16] += 1
    calls, crc32 = [], zlib.crc32
    monkeypatch.setattr(zlib, "crc32", lambda b: calls.append(b) or crc32(b))
    assert annotator.hashing_encoder(16)(texts).tolist() == want
    assert len(calls) == len({t[i : i + 3] for t in texts for i in range(len(t) - 2)})
    assert annotator.hashing_encoder(16)(["", "x"]).tolist() == [[0.0] * 16] * 2


def test_remarks_are_classified_once(spark):
    texts = ["Igen. (Nagy taps a Fidesz soraiban.) Nem. (Taps.)", "Nincs (14.20) semmi.", None, "(Taps.) (Taps.)"]
    rows = spark.range(40).select("id", (39 + F.col("id") % 5).cast("int").alias("cycle"), F.element_at(F.array(*map(F.lit, texts)), (F.col("id") % 4 + 1).cast("int")).alias("text"))
    out = events.floor_events(rows.where("cycle < 43"))
    assert out.columns[:5] == ["id", "cycle", "span", "event_no", "segment"]
    got = Counter((r["span"], r["kind"], r["audience"], r["weight"]) for r in out.collect())
    assert got == {("Nagy taps a Fidesz soraiban.", "applause", "government", 1.5): 8, ("Taps.", "applause", "unspecified", 1.0): 24}
    assert "BroadcastHashJoin" in plan(out)
