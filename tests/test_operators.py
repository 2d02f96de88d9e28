"""Operators on small tables with known answers."""

import pytest
from tables import rows
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from rostrum.operators import bundle, classify, collocation, contrast, evaluate, events, frequency, keywords, lexscore, network, readability, syntax, tokens, topics
from rostrum.profile import HUNGARIAN


def token_rows(spark, docs):
    """{doc: [[token, ...], ...]}, a list for each sentence."""
    out = [(d, s, p, t) for d, ss in docs.items() for p, (s, t) in enumerate((s, t) for s, ts in enumerate(ss) for t in ts)]
    return spark.createDataFrame(out, "doc_id long, sent_id int, pos int, token string")


def test_tokenized(spark):
    docs = spark.createDataFrame([(1, "Az adó. Nő! Ő"), (2, None), (3, "...")], "doc_id long, text string")
    assert rows(tokens.tokenized(docs)) == [(1, 0, 0, "az"), (1, 0, 1, "adó"), (1, 1, 2, "nő"), (1, 2, 3, "ő")]


def test_tags(spark):
    df = spark.createDataFrame([("[/N][Nom]",), ("[/N|Pro][Nom]",), ("[Punct]",), ("x",), ("[/Adv]",)], "t string")
    out = df.select("t", tokens.main_category(F.col("t")), tokens.is_content(F.col("t")), tokens.is_punctuation(F.col("t")))
    assert {r[0]: tuple(r)[1:] for r in out.collect()} == {"[/N][Nom]": ("N", True, False), "[/N|Pro][Nom]": ("N", False, False), "[Punct]": (None, False, True), "x": (None, False, False), "[/Adv]": ("Adv", True, False)}


def test_repair_counts_only_changes(spark):
    df = spark.createDataFrame([("Jobbik", "jó", "[/Adj]"), ("Jobbik", "Jobbik", "[/N][Nom]"), ("ház", "ház", "[/N]")], "form string, lemma string, xpostag string")
    out = tokens.repaired(df, HUNGARIAN)
    assert rows(out.select("form", "lemma", "repaired")) == [("Jobbik", "Jobbik", False), ("Jobbik", "Jobbik", True), ("ház", "ház", False)]


def test_frequency_frame(spark):
    toks = token_rows(spark, {1: [["taps", "taps", "csenget"]], 2: [["taps"]]})
    docs = spark.createDataFrame([(1,), (2,)], "doc_id long")
    out = {r["token"]: r for r in frequency.frequency_frame(toks, docs).collect()}
    assert (out["taps"]["raw"], out["taps"]["per_million"], out["taps"]["doc_proportion"]) == (3, 750000.0, 1.0)
    assert (out["csenget"]["raw"], out["csenget"]["per_million"], out["csenget"]["doc_proportion"]) == (1, 250000.0, 0.5)


def test_repeats_and_line_stats(spark):
    lines = spark.createDataFrame([(1, i, t) for i, t in enumerate(["T", "T", "D", "T"])], "cycle int, line_no int, text string")
    flagged = frequency.with_repeats(lines, "cycle", ["line_no"], "text")
    assert [r["text"] for r in flagged.where("NOT is_repeat").orderBy("line_no").collect()] == ["T", "D", "T"]
    assert frequency.line_stats(flagged, "cycle", "text").first()["repeat_fraction"] == 0.25


def test_document_stopwords(spark):
    toks = token_rows(spark, {1: [["kormány", "adó"]], 2: [["kormány", "út"]]})
    docs = spark.createDataFrame([(1,), (2,)], "doc_id long")
    assert [r["token"] for r in frequency.document_stopwords(toks, docs, 0.9, 1).collect()] == ["kormány"]
    with pytest.raises(ValueError, match="below"):
        frequency.document_stopwords(toks, docs, 1, 2)


def test_register_vocabulary(spark):
    counts = spark.createDataFrame([("a", 9), ("b", 5), ("c", 2), ("d", 1)], "token string, raw long")
    assert rows(frequency.register_vocabulary(counts, 50)) == [("a",), ("b",)]
    assert frequency.register_vocabulary(counts, 0).count() == 0


@settings(max_examples=8, deadline=None)
@given(st.lists(st.sampled_from("abcd"), min_size=1, max_size=30), st.integers(2, 6))
def test_mattr_is_the_mean_over_windows(spark, words, window):
    out = readability.mattr(token_rows(spark, {1: [words]}), window).first()
    if len(words) >= window:
        spans = [words[i : i + window] for i in range(len(words) - window + 1)]
        assert out["mattr"] == pytest.approx(sum(len(set(s)) / window for s in spans) / len(spans))
    else:
        assert out["mattr"] == len(set(words)) / len(words)


@pytest.mark.parametrize(("words", "ok"), [(60, True), (61, False)])
def test_reliability(spark, words, ok):
    counts = spark.createDataFrame([(1, words, 0, 1)], "doc_id long, n_words long, n_long long, n_sentences long")
    assert readability.scored(counts).first()["reliable"] is ok


def brute_marks(words, forward, backward):
    marks = [0] * len(words)
    for i, w in enumerate(words):
        if w in forward:
            for j in range(i + 1, len(words)):
                if words[j] in forward:
                    break
                marks[j] += 1
        if w in backward:
            for j in range(i):
                marks[j] += 1
    return marks


@settings(max_examples=8, deadline=None)
@given(st.lists(st.sampled_from(["nem", "nélkül", "jó", "baj"]), min_size=1, max_size=12))
def test_negation(spark, words):
    df = token_rows(spark, {1: [words]}).withColumn("clause", F.lit(0))
    got = [r["marks"] for r in lexscore.negated(df).orderBy("pos").collect()]
    assert got == brute_marks(words, HUNGARIAN.negation_forward, HUNGARIAN.negation_backward)


def test_sentiment_turns_negated_hits(spark):
    df = lexscore.negated(token_rows(spark, {1: [["nem", "probléma"]]}).withColumn("clause", F.lit(0)))
    out = lexscore.sentiment(df, ("jó",), ("probléma",)).first()
    assert (out["positive"], out["negative"], out["polarity"]) == (1, 0, 1.0)


def test_longest_hits_first(spark):
    df = spark.createDataFrame([(["jó", "hír", "öröm", "jó"],)], "t array<string>")
    assert df.select(lexscore.all_hits(F.col("t"), ["jó hír", "öröm", "hír"])).first()[0] == 2


def test_stance_and_loanwords(spark):
    counts = spark.createDataFrame([(1, 3, 1, 8), (2, 0, 0, 5)], "doc_id long, affirming long, accusing long, n_tokens long")
    assert [r["stance"] for r in lexscore.with_stance(counts).orderBy("doc_id").collect()] == [0.75, None]
    toks = spark.createDataFrame([(1, "a", False), (1, "b", False), (1, "c", False), (2, "a", True)], "doc_id long, token string, proper boolean")
    out = lexscore.loanwords(toks, lexscore.lexicon(spark, {"loan": ("a",)})).orderBy("doc_id").collect()
    assert out[0]["loan_ratio"] == pytest.approx(1 / 3)
    assert (out[1]["loan_ratio"], out[1]["excluded"]) == (None, 1)


def test_phrases_with_connectors(spark):
    sentences = spark.createDataFrame([(1, 0, ["taps", "a", "kormánypárt", "a", "sorban"])], "doc_id long, sent_id int, tokens array<string>")
    phrases = spark.createDataFrame([("taps", "a", "kormánypárt")], "a string, between string, b string")
    out = collocation.fused(sentences, phrases, ("a",), "#").first()["tokens"]
    assert out == ["taps#a#kormánypárt", "a", "sorban"]
    plain = spark.createDataFrame([("költségvetési", "", "hiány")], "a string, between string, b string")
    two = spark.createDataFrame([(1, 0, ["nagy", "költségvetési", "hiány"])], "doc_id long, sent_id int, tokens array<string>")
    assert collocation.fused(two, plain).first()["tokens"] == ["nagy", "költségvetési_hiány"]


def test_component_npmi_of_unknown_parts(spark):
    grams = spark.createDataFrame([("a#b", 10), ("a#z", 3)], "token string, raw long")
    counts = spark.createDataFrame([("a", 20), ("b", 25)], "token string, raw long")
    out = {r["token"]: r["npmi"] for r in collocation.component_npmi(grams, counts, 100).collect()}
    assert out["a#b"] == pytest.approx(0.30103, abs=1e-5)
    assert out["a#z"] is None


def test_average_ranks(spark):
    counts = spark.createDataFrame([("a", 5), ("b", 3), ("c", 3), ("d", 0)], "token string, n long")
    assert {r["token"]: r["r"] for r in contrast.average_ranks(counts, "n", "r").collect()} == {"a": 1.0, "b": 2.5, "c": 2.5, "d": 4.0}


LINE = "Hosszan tartó taps a kormánypártok soraiban. - Taps a Jobbik soraiban. - Vadai Ágnes: Nem hallom!"


def test_compound_line(spark):
    df = spark.createDataFrame([(LINE,)], "text string")
    out = events.classified(events.split_lines(df)).orderBy("event_no").collect()
    assert [r["kind"] for r in out] == ["applause", "applause", "interjection"]
    assert (out[0]["intensity"], out[0]["weight"], out[0]["audiences"]) == ("long", 2.0, ["government"])
    assert (out[1]["audiences"], out[1]["parties"]) == (["party"], ["Jobbik"])
    assert (out[2]["interjector"], out[2]["quote"], out[2]["audiences"]) == ("Vadai Ágnes", "Nem hallom!", [])


@pytest.mark.parametrize(
    ("line", "parts"),
    [("Taps. Dr. Vadai Ágnes közbeszól.", ["Taps.", "Dr. Vadai Ágnes közbeszól."]), ("Taps. Z. Kárpát Dániel szól.", ["Taps.", "Z. Kárpát Dániel szól."]), ("Zaj", ["Zaj"]), ("", [])],
)
def test_segments(spark, line, parts):
    df = spark.createDataFrame([(line,)], "text string")
    assert df.select(events.segments(F.col("text"))).first()[0] == parts


@pytest.mark.parametrize(
    ("segment", "kind", "audience"),
    [("Taps.", "applause", ["unspecified"]), ("Közbeszólás az ellenzék soraiból: Hazudik!", "heckling", ["opposition"]), ("Nincs jelentkező.", "other", []), ("Sípolás és zaj", "whistling", ["unspecified"]), ("Szünet: 14.19", "other", [])],
)
def test_kinds(spark, segment, kind, audience):
    out = events.classified(spark.createDataFrame([(segment,)], "segment string")).first()
    assert (out["kind"], out["audiences"]) == (kind, audience)


def test_addressee(spark):
    out = events.classified(spark.createDataFrame([("Nagy Pál Kiss Olgához: Üljön le!",)], "segment string")).first()
    assert (out["interjector"], out["addressee"]) == ("Nagy Pál", "Kiss Olga")


def test_sides(spark):
    df = spark.createDataFrame([("Fidesz", 42), ("Fidesz", 43)], "p string, c int")
    assert [r[0] for r in df.select(events.side_of(F.col("p"), F.col("c"))).collect()] == ["government", "opposition"]
    with pytest.raises(Exception, match="unknown cycle"):
        spark.createDataFrame([("X", 1)], "p string, c int").select(events.side_of(F.col("p"), F.col("c"))).collect()


def test_name_resolution(spark):
    people = spark.createDataFrame([("Vadai Ágnes", 1, "DK", 0), ("Kiss Nagy Pál", 2, "X", 1), ("Kiss Nagy Péter", 3, "Y", 2), ("vadai agnes", 9, "Z", 3)], "name string, person_id long, faction string, seq int")
    mentions = spark.createDataFrame([("Dr. Vadai Ágnes",), ("Pál Kiss",), ("Kiss Nagy",), ("Kiss",), ("Senki Sem",)], "mention string")
    out = {r["mention"]: (r["person_id"], r["how"]) for r in network.resolved(mentions, network.registry(people)).collect()}
    assert out == {"Dr. Vadai Ágnes": (1, "exact"), "Pál Kiss": (2, "tokens"), "Kiss Nagy": (None, None), "Kiss": (None, None), "Senki Sem": (None, None)}


def test_graph(spark):
    edges = spark.createDataFrame([("a", "b"), ("a", "b"), ("a", "c"), ("b", "a"), ("c", "c")], "src string, dst string")
    graph = network.collapsed(edges)
    assert rows(graph) == [("a", "b", 2), ("a", "c", 1), ("b", "a", 1)]
    assert rows(network.degrees(graph)) == [("a", 3, 2, 1, 1), ("b", 1, 1, 2, 1), ("c", 0, 0, 1, 1)]
    nodes = spark.createDataFrame([("a", "X"), ("b", "X"), ("c", None)], "id string, side string")
    assert rows(network.rolled_up(graph, nodes, "side")[0]) == [("X", "X", 3), ("X", "unknown", 1)]
    assert rows(network.crossing(graph, nodes).select("src", "dst", "crossing")) == [("a", "b", "within"), ("a", "c", "unknown"), ("b", "a", "within")]


def test_cooccurrence_and_textrank(spark):
    toks = token_rows(spark, {1: [["adó", "emelés", "adó", "költségvetés", "emelés"]], 2: [["x"]]})
    pairs = keywords.cooccurrences(toks, 2)
    assert rows(pairs.where("doc_id = 1 AND a = 'adó' AND b = 'emelés'")) == [(1, "adó", "emelés", 2)]
    top = keywords.textrank(toks)
    assert rows(top.where("doc_id = 2").select("token", "score")) == [("x", 1.0)]
    assert top.where("doc_id = 1").count() == 3
    with pytest.raises(ValueError, match="window"):
        keywords.cooccurrences(toks, 1)


def test_windows(spark):
    out = topics.windows(token_rows(spark, {1: [["a", "b", "c", "d", "e"]]}), 2)
    assert rows(out.select("window", F.size("tokens"))) == [(0, 2), (1, 2), (2, 1)]
    with pytest.raises(ValueError, match="size"):
        topics.windows(out, 0)


def test_weighted_distribution_turns(spark):
    scores = spark.createDataFrame([(1, 0, "Health", 0.9, 10), (1, 0, "Labor", 0.1, 10), (1, 1, "Health", 0.2, 250), (1, 1, "Labor", 0.8, 250)], "doc_id long, window int, label string, p double, weight long")
    best = classify.combined(scores).where("rank = 1")
    assert best.first()["label"] == "Labor"
    edge = spark.createDataFrame([("A", 0.60), ("B", 0.59)], "label string, p double")
    assert [r["decision"] for r in classify.decided(edge).collect()] == ["A", "Mix"]
    with pytest.raises(ValueError, match="threshold"):
        classify.decided(edge, 2)


def test_dependency_distance(spark):
    rows_ = [(1, 0, 1, 2, "[/Det]"), (1, 0, 2, 3, "[/N]"), (1, 0, 3, 0, "[/V]"), (1, 0, 4, 3, "[Punct]")]
    df = spark.createDataFrame(rows_, "doc_id long, sent_id int, dep_id int, head int, xpostag string")
    out = syntax.distances(syntax.closed_up(df)).first()
    assert (out["n_tokens"], out["mdd"], out["mhd"]) == (3, 1.0, 1.5)
    short = syntax.distances(syntax.closed_up(df.where("dep_id = 3"))).first()
    assert (short["mdd"], short["too_short"]) == (None, 1)


def test_null_keys_meet(spark):
    a = spark.createDataFrame([(1, 10), (None, 20)], "k long, x long")
    b = spark.createDataFrame([(None, 5), (2, 6)], "k long, y long")
    assert rows(bundle.full_outer(a, b, "k")) == [(None, 20, 5), (1, 10, None), (2, None, 6)]


def test_agreement_of_equal_labellings(spark):
    df = spark.createDataFrame([(i, i % 3, i % 3) for i in range(30)], "i int, a int, b int")
    out = evaluate.agreement(df, "a", "b").first()
    assert (out["ari"], pytest.approx(out["nmi"])) == (1.0, 1.0)


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, sent_id int, pos int, token string")
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert tokens.tokenized(docs).count() == 0
    assert frequency.frequency_frame(none, docs).count() == 0
    assert readability.mattr(none).count() == 0
    assert collocation.pair_scores(none).count() == 0


def test_hits_in_text_are_those_in_arrays(spark):
    entries = ["of the sea", "the sea", "sea", "of the", "la mer"]
    texts = ["Of the sea, the sea. Sea!", "of the. sea", "la, mer la mer", "", "seas of thesea", "the  sea of the sea of"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    low = F.lower("t")
    lists = F.transform(F.split(low, r"[.!?]+"), lambda s: F.regexp_extract_all(s, F.lit(r"\p{L}+"), F.lit(0)))
    got = df.select(lexscore.text_hits(low, entries).alias("a"), F.aggregate(lists, F.lit(0), lambda n, x: n + lexscore.all_hits(x, entries)).alias("b")).collect()
    assert [r["a"] for r in got] == [r["b"] for r in got] == [3, 2, 2, 0, 0, 2]


def test_core_leaves_out_mixed_and_unclustered(spark):
    rows = spark.createDataFrame([(0, "A"), (-1, "A"), (2, "Mix"), (3, None), (None, "B")], "topic int, label string")
    assert [tuple(r) for r in topics.core(rows).collect()] == [(0, "A")]


def test_overview_without_time_or_reliable_rows(spark):
    rows = spark.createDataFrame([(1, None, 5, 30.0, False, None, 2), (2, 120.0, 7, 40.0, True, "question", 1)], "t int, duration_s double, n_words int, lix double, reliable boolean, role string, claps int")
    out = {r["t"]: r for r in topics.overview(rows, "t", reliable_means=("lix",), reactions=("claps",)).collect()}
    assert (out[1]["minutes"], out[1]["lix"], out[1]["claps_per_hour"], out[1]["qa_share"]) == (0.0, None, 0.0, 0.0)
    assert (out[2]["minutes"], out[2]["lix"], out[2]["claps_per_hour"], out[2]["qa_share"]) == (2.0, 40.0, 30.0, 1.0)
    assert topics.overview(rows.limit(0), "t").count() == 0


def test_evidence_falls_back_to_the_first_member(spark):
    quotes = spark.createDataFrame([("a", "said so"), ("b", "never said")], "g string, quote string")
    members = spark.createDataFrame([("a", 3, "he  said\nso"), ("a", 1, "no"), ("b", 5, None), ("b", 4, "x"), ("c", 1, "said so")], "g string, id int, text string")
    out = {r["g"]: (r["id"], r["found"]) for r in evaluate.evidence(quotes, members, "g", "id").collect()}
    assert out == {"a": (3, True), "b": (4, False)}


def test_names_and_ids_of_exchanges(spark):
    rows = spark.createDataFrame([(1, "x"), (2, "y"), (None, "z")], "topic int, v string")
    names = spark.createDataFrame([(1, "Egy"), (1, "Egy")], "topic int, name string")
    assert sorted(r["name"] or "-" for r in bundle.named(rows, names, "topic").collect()) == ["-", "-", "Egy"]
    turns = spark.createDataFrame([([("u1",), ("",), (None,)],), ([("u1",), ("u2",)],), (None,)], "turns array<struct<uid string>>")
    assert sorted(r["uid"] for r in bundle.exchange_ids(turns).collect()) == ["u1", "u2"]


def test_repairs_are_counted(spark):
    rows = spark.createDataFrame([("d", 0, 0, "Jobbik", "jobb", "[/Adj]"), ("d", 0, 1, ".", ".", "[Punct]"), ("d", 0, 2, "x", " ", "[/N]")], "doc_id string, sent_id int, pos int, form string, lemma string, xpostag string")
    assert tuple(tokens.repairs(rows, HUNGARIAN).first()) == (3, 1, 1, 1)
