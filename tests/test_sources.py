"""Readers, annotators, sinks and streams on files."""

import json

import pytest
from tables import rows
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rostrum.sources import annotator, readers, sinks
from rostrum.streaming import incremental


def test_json_lines(spark, tmp_path):
    path = tmp_path / "a.jsonl"
    path.write_text('{"uid":"u1","text":"Szép","speaker":{"id":"1","name":"N","is_mp":null}}\n\n{"uid":"u2","n_words":3}\n', encoding="utf-8")
    out = readers.speeches(spark, str(path)).orderBy("uid").collect()
    assert [(r["uid"], r["text"], r["n_words"]) for r in out] == [("u1", "Szép", None), ("u2", None, 3)]
    path.write_text('{"uid":"u1"}\n\nnonsense\n', encoding="utf-8")
    with pytest.raises(Exception):  # noqa: B017
        readers.speeches(spark, str(path)).collect()
    assert rows(readers.malformed_lines(spark, str(path)).select("line_no", "line")) == [(3, "nonsense")]


def test_exchanges(spark, tmp_path):
    path = tmp_path / "qa.jsonl"
    path.write_text('{"exchange_id":"e","turns":[{"uid":"a"},{"uid":""},{"uid":"a"},{"uid":null}],"answer_accepted":null}\n')
    out = readers.exchanges(spark, str(path))
    uids = out.select(F.explode_outer("turns").alias("t")).where("t.uid <> ''").select("t.uid").distinct()
    assert rows(uids) == [("a",)]
    assert out.first()["answer_accepted"] is None


def test_line_corpus(spark, tmp_path):
    (tmp_path / "cycle39-lines.txt").write_text("Taps.\n\n  \nDe\u00adrültség.\nTaps.\n", encoding="utf-8")
    (tmp_path / "cycle40-lines.txt").write_text("Zaj.\r\nZaj.", encoding="utf-8")
    out = readers.line_corpus(spark, f"{tmp_path}/*.txt")
    assert rows(out) == [(39, 0, "Taps.", 0), (39, 1, "Derültség.", 1), (39, 2, "Taps.", 0), (40, 0, "Zaj.", 0), (40, 1, "Zaj.", 0)]
    assert readers.line_corpus(spark, f"{tmp_path}/*.txt", limit=1).count() == 2
    (tmp_path / "other.txt").write_text("x")
    with pytest.raises(Exception, match="no cycle"):
        readers.line_corpus(spark, f"{tmp_path}/other.txt").collect()


def test_word_list(spark, tmp_path):
    path = tmp_path / "w.txt"
    path.write_text("# comment\nJó\n\njó\nszép  szó\n", encoding="utf-8")
    out = readers.word_list(spark, str(path), "w")
    assert rows(out.select("entry", "n_words")) == [("jó", 1), ("szép szó", 2)]
    assert out.first()["lexicon_id"].startswith("w@")
    path.write_text("# nothing\n")
    with pytest.raises(ValueError, match="no entries"):
        readers.word_list(spark, str(path), "w")


def test_two_poles(spark, tmp_path):
    path = tmp_path / "v.json"
    path.write_text(json.dumps({"_meta": {"x": 1}, "courage": {"affirming": ["Bátor", "nagy tett"], "accusing": ["gyáva"]}}))
    assert rows(readers.two_poles(spark, str(path))) == [("courage/accusing", "gyáva", 1), ("courage/affirming", "bátor", 1), ("courage/affirming", "nagy tett", 2)]
    path.write_text(json.dumps({"courage": {"affirming": ["x"]}}))
    with pytest.raises(Exception, match="lacks a pole"):
        readers.two_poles(spark, str(path)).collect()


def test_csv_and_last_written(spark, tmp_path):
    sinks.csv(spark.createDataFrame([(1, "é;x")], "a int, b string"), str(tmp_path / "c"))
    schema = T.StructType([T.StructField("a", T.IntegerType()), T.StructField("b", T.StringType())])
    assert rows(readers.csv_table(spark, str(tmp_path / "c"), schema)) == [(1, "é;x")]
    with pytest.raises(FileNotFoundError, match="run it first"):
        readers.csv_table(spark, str(tmp_path / "none"), schema, "run it first")
    df = spark.createDataFrame([("k", 1, "old"), ("k", 2, "new"), ("j", 1, "one")], "key string, seq int, v string")
    assert rows(readers.last_written(df, "key", "seq").select("key", "v")) == [("j", "one"), ("k", "new")]


TSV = "form\twsafter\tlemma\txpostag\tid\thead\nA\t\" \"\ta\t[/Det]\t1\t2\nház\t\"\\n\"\tház\t[/N]\t2\t0\n\nshort\n.\t\"\"\t.\t[Punct]\t1\t_\n"


def test_annotated_tsv(spark):
    df = spark.createDataFrame([(7, TSV)], "doc_id long, payload string")
    out = readers.annotated_tsv(df)
    got = rows(out.select("sent_id", "pos", "form", "lemma", "xpostag", "dep_id", "head", "upostag"))
    assert got[:2] == [(0, 0, "A", "a", "[/Det]", 1, 2, None), (0, 1, "ház", "ház", "[/N]", 2, 0, None)]
    assert (1, 3, ".", ".", "[Punct]", 1, None, None) in got
    assert [r["line"] for r in readers.input_lines(out).orderBy("pos").collect()] == [0, 0, 1, 1]


def test_batches_keep_both_caps():
    texts = ["a b", "c " * 9, "d", "e " * 40, "f"]
    batches = list(annotator.batches_of(texts, 2, 12))
    assert [i for b in batches for i in b] == list(range(5))
    assert all(len(b) <= 2 and (len(b) == 1 or sum(len(texts[i].split()) for i in b) <= 12) for b in batches)


def test_annotator_annotates_each_text_once(spark, tmp_path):
    log = tmp_path / "log"

    def factory():
        def call(texts):
            if any("bad" in t for t in texts):
                raise RuntimeError("no")
            with open(log, "a") as f:
                f.writelines(f"{t}\n" for t in texts)
            return [t.upper() for t in texts]

        return call

    df = spark.createDataFrame([(1, "x"), (2, "x"), (3, "bad"), (4, None)], "doc_id long, text string").coalesce(1)
    out = {r["doc_id"]: (r["ok"], r["payload"], r["error"]) for r in annotator.annotated(df, factory).collect()}
    assert out == {1: (True, "X", None), 2: (True, "X", None), 3: (False, None, "RuntimeError: no"), 4: (None, None, None)}
    assert log.read_text().split() == ["x"]


def test_retries():
    calls = []

    def flaky(texts):
        calls.append(1)
        if len(calls) < 3:
            raise OSError
        return texts

    assert annotator.with_retries(flaky, 3, 0)(["a"]) == ["a"]


def test_encoder(spark):
    df = spark.createDataFrame([("abc",), ("abc",), (None,)], "text string")
    vectors = [tuple(r["vector"]) for r in annotator.encoded(df, lambda: annotator.hashing_encoder(8)).collect()]
    assert len({v for v in vectors if any(v)}) == 1
    assert sum(not any(v) for v in vectors) == 1


def test_annotation_store(spark, tmp_path):
    path = str(tmp_path / "store")
    sinks.append_annotations(spark.createDataFrame([(1,)], "doc_id long"), path, "tok", "v1")
    sinks.append_annotations(spark.createDataFrame([(2,)], "doc_id long"), path, "tok", "v2")
    assert rows(readers.annotations(spark, path, "tok", "v2").select("doc_id")) == [(2,)]


def test_provenance(spark, tmp_path):
    (tmp_path / "m.json").write_text("{}")
    (tmp_path / "a.txt").write_text("abc")
    out = readers.provenance(spark, str(tmp_path), ["a.txt", "b.txt"], "m.json")
    assert rows(out.select("file", "bytes")) == [("a.txt", 3), ("b.txt", None)]
    with pytest.raises(FileNotFoundError):
        readers.provenance(spark, str(tmp_path), ["a.txt"], "none.json")


def test_graph_sinks(spark):
    nodes = spark.createDataFrame([("a", None, 3), ("b", True, 1)], "id string, is_mp boolean, n int")
    edges = spark.createDataFrame([("a", "b", 2)], "src string, dst string, weight int")
    body = json.loads(sinks.node_link(nodes, edges, source="x").first()["value"])
    assert body["links"] == [{"source": "a", "target": "b", "weight": 2}]
    assert body["source"] == "x"
    text = sinks.graphml(nodes, edges)
    assert '<data key="d0">unknown</data>' in text
    assert 'attr.type="int"' in text
    assert sinks.markdown(edges, "Edges").endswith("| a | b | 2 |")


def test_dashboard_and_manifest(spark):
    df = spark.createDataFrame([(1, "x")], "k int, v string")
    assert json.loads(sinks.dashboard({"a": df, "b": df}).first()["value"]) == {"a": [{"k": 1, "v": "x"}], "b": [{"k": 1, "v": "x"}]}
    assert json.loads(sinks.manifest({"a": df}, version=2)) == {"a": {"k": 1, "v": "x"}, "version": 2}


def test_stream_counts_equal_batch(spark, sf_dir, tmp_path):
    folder = str(tmp_path / "in")
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    events.select(*incremental.EVENT.names).repartition(3).write.parquet(folder)
    stream = incremental.windowed_counts(incremental.arriving(spark, folder, files_at_once=1), "1 day", "40 days")
    query = stream.writeStream.format("memory").queryName("counts").outputMode("update").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c")).start()
    query.awaitTermination(120)
    got = spark.table("counts").groupBy("start", "event_type").agg(F.max("events").alias("n"))
    want = events.groupBy(F.date_trunc("day", "ts").alias("start"), "event_type").agg(F.count(F.lit(1)).alias("n"))
    assert rows(got) == rows(want)


def test_new_rows_alone_are_annotated(spark, sf_dir, tmp_path):
    folder, store = str(tmp_path / "in"), str(tmp_path / "store")
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select(*incremental.EVENT.names)
    seen = []

    def annotate(df):
        seen.append(df.count())
        return df.select("event_id")

    for part in (events.where("event_id < 100"), events.where("event_id < 150")):
        part.write.mode("append").parquet(folder)
        incremental.annotate_new(incremental.arriving(spark, folder), "event_id", annotate, store, str(tmp_path / "c")).awaitTermination(120)
    assert spark.read.parquet(store).count() == events.where("event_id < 150").count()
    assert sum(seen) == events.where("event_id < 150").count()
