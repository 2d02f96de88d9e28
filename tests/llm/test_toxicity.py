"""Toxicity scores on held-out rows."""

import zlib

import pytest
from pyspark.sql import functions as F

from rostrum.llm import toxicity

SF = "/root/testdata/sf0.1"


@pytest.fixture(scope="module")
def model(spark):
    return toxicity.train(spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet"), trees=12)


def test_held_out_accuracy(spark, model):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    held = docs.join(labels, "doc_id").where(toxicity.fold_of(F.col("doc_id")) == 0).select("doc_id", "text", "toxic")
    out = toxicity.judged(held, model).collect()
    right = sum(r["predicted"] == r["toxic"] for r in out) / len(out)
    assert right > 0.97
    assert sum((r["score"] - r["toxic"]) ** 2 for r in out) / len(out) < 0.02
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in out)


def test_folds_are_crc32(spark):
    out = spark.range(50).select("id", toxicity.fold_of(F.col("id"))).collect()
    assert all(f == zlib.crc32(str(i).encode()) % 5 for i, f in out)


def test_odd_texts(docs, no_docs, model, clash):
    out = toxicity.judged(clash(docs), model)
    assert out.count() == docs.count()
    assert out.where("score IS NULL OR predicted IS NULL").count() == 0
    equal = out.groupBy("text").agg(F.count_distinct("score").alias("n")).where("n > 1")
    assert equal.isEmpty()
    assert toxicity.judged(no_docs, model).count() == 0


def test_other_columns_are_no_inputs(docs, model):
    a = toxicity.judged(docs, model).select("text", "score").distinct()
    b = toxicity.judged(docs.withColumns({"doc_id": F.lit(7), "lang": F.lit("xx"), "source": F.lit("y")}), model).select("text", "score").distinct()
    assert a.exceptAll(b).isEmpty()


def test_features(spark):
    df = spark.createDataFrame([("You are an 1d1ot, you STUPID clown!!! sooooo s t u p i d",)], "text string")
    out = dict(zip(toxicity.FEATURES, toxicity.with_features(df).first()["toxic_features"], strict=True))
    assert out["insult_density"] > 0
    assert out["near_density"] > 0
    assert out["obfuscated_density"] > 0
    assert all(out[k] > 0 for k in ("shout_density", "burst_density", "disguise_density", "stretch_density", "spread_density", "second_density"))


@pytest.mark.parametrize("toxic", [None, 0, 1])
def test_one_label_alone_gives_its_share(spark, docs, no_docs, toxic):
    labels = spark.createDataFrame([(i, toxic) for i in range(30)], "doc_id long, toxic int")
    for given in (docs, no_docs):
        model = toxicity.train(given, labels)
        out = toxicity.judged(docs, model).collect()
        want = float(toxic or 0) if given is docs else 0.0
        assert {(r["score"], r["predicted"]) for r in out} == {(want, int(want >= 0.5))}
        assert len(out) == docs.count()


def test_without_rows_that_calibrate_scores_are_the_trees_own(spark):
    ids = [i for i in range(400) if zlib.crc32(str(i).encode()) % 5 > 1]
    docs = spark.createDataFrame([(i, "you stupid idiot" if i % 2 else "a fine day by the sea") for i in ids], "doc_id long, text string")
    model = toxicity.train(docs, docs.selectExpr("doc_id", "int(doc_id % 2) AS toxic"), trees=2)
    assert model.calibration is None
    out = toxicity.judged(docs.withColumns({c: F.lit("kept") for c in ("__text", "__row", "__low", "toxic_features")}), model).collect()
    assert all(r["predicted"] == r["doc_id"] % 2 and r["__low"] == r["__text"] == r["toxic_features"] == "kept" for r in out)
