"""The pipeline's stages against what each promises, and queries over the sample tables."""

import corpus_pipeline
import pytest
from pyspark.sql import functions as F

from rostrum.llm import decontam, mixing, neardup, queries

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def stages(spark):
    from rostrum.llm.common import shared_dir, stored

    docs, home, out = spark.read.parquet(f"{SF}/documents.parquet"), shared_dir(spark), {}
    for name, stage in corpus_pipeline.STAGES:
        docs = out[name] = stored(stage(spark, docs, SF), f"{home}/{name}")
    return out


def test_order_and_columns(spark, stages):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_duplicates", "decontamination", "mixing", "token_store"]
    columns = spark.read.parquet(f"{SF}/documents.parquet").columns
    assert all(stages[n].columns == columns for n in list(stages)[:-1])


def test_toxicity_keeps_clean_documents(spark, stages):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    kept = stages["toxicity"].select("doc_id").distinct().withColumn("kept", F.lit(1))
    out = labels.join(kept, "doc_id", "left").groupBy("toxic").agg(F.avg(F.coalesce("kept", F.lit(0))).alias("share")).collect()
    share = {r["toxic"]: r["share"] for r in out}
    assert share[0] > 0.97
    assert share[1] < 0.4


def test_one_document_of_each_class(stages):
    before = neardup.near_duplicates(stages["toxicity"])
    assert stages["near_duplicates"].count() == before.select("class_id").distinct().count()
    assert neardup.near_duplicates(stages["near_duplicates"]).where("n_docs > 1").isEmpty()


def test_no_item_is_left(spark, stages):
    items = [decontam.word_shingles(r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    hit = lambda t: any(len(i & decontam.word_shingles(t)) >= 0.8 * len(i) for i in items)
    before = {r["doc_id"]: r["text"] for r in stages["near_duplicates"].collect()}
    after = {r["doc_id"] for r in stages["decontamination"].collect()}
    assert after == {d for d, t in before.items() if not hit(t)}


def test_mix_and_store(stages):
    plan = mixing.plan_mix(stages["decontamination"]).agg(F.sum("copies")).first()[0]
    assert stages["mixing"].count() == plan
    assert stages["token_store"].count() == plan
    sums = stages["token_store"].agg(F.max(F.col("start") + F.col("n_tokens")).alias("end"), F.sum("n_tokens").alias("n")).first()
    assert sums["end"] == sums["n"]


def test_run_gives_the_last_stage(spark, stages):
    a = sorted(tuple(r) for r in corpus_pipeline.run(spark, SF).collect())
    assert a == sorted(tuple(r) for r in stages["token_store"].collect())


@pytest.mark.parametrize("empty", [("documents",), ("labels", "benchmark")])
def test_empty_tables_pass_through(spark, sf_dir, tmp_path, empty):
    for name in ("documents", "labels", "benchmark"):
        rows = spark.read.parquet(f"{sf_dir}/{name}.parquet")
        if name == "documents":
            rows = rows.limit(60).unionByName(spark.createDataFrame([((1 << 60) + 1, None, None, None, None), (None, "", "xx", None, 0), (None, "", "xx", None, 0)], rows.schema))
        (rows.limit(0) if name in empty else rows).write.parquet(f"file://{tmp_path}/{name}.parquet")
    out = corpus_pipeline.run(spark, f"file://{tmp_path}").collect()
    assert bool(out) == ("documents" not in empty)
    assert all(r["n_tokens"] > 0 for r in out)


@pytest.mark.parametrize("name", sorted(queries.queries()))
def test_queries_cover_their_tables(spark, sf_dir, name):
    out = queries.queries()[name](spark, sf_dir)
    read = lambda table: spark.read.parquet(f"{sf_dir}/{table}.parquet")
    if name.startswith("op11"):  # a row for each piece
        assert out.select("doc_id").distinct().count() == read("documents").count()
    elif name.startswith("op12"):
        assert out.count() == read("conversations").select("conv_id").distinct().count()
    elif name.startswith("op13"):  # a pair and the other way for any two sources of a language
        assert out.where("part = 'pair'").select("lang", "source").distinct().count() == read("documents").select("lang", "source").distinct().count()
    elif not name.startswith("op8"):
        assert out.count() == read("pages" if name.startswith(("op5", "op7")) else "documents").count()
