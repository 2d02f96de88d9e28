"""The numbered queries: thin wrappers that derive digest columns from the operators.

Each gives one row for each row of its table (op8: each pair that it finds);
nulls, empty texts, ties and empty tables are as the operator's docstring says.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontam, dedup, divergence, media, mixing, neardup, packing, repair, secrets, tokens, toxicity, urls, warc
from .common import shared_dir, stored, table
from .sql import oracle_sql as oracle_sql


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = dedup.deduplicated(table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op2_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = tokens.write_store(table(spark, sf_dir, "documents"), tokenizer_path())
    return tokens.read_store(store).select("doc_id", "start", "n_tokens", "ids_crc32")


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scanned(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "secrets")
    n = lambda kind: F.size(F.filter("secrets", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter("secrets", lambda s: s["kind"].isin(*(r.kind for r in secrets.BASE)))
    digest = F.sha2(secrets.joined(base), 256).alias("base_sha256")
    return found.select("doc_id", *(n(r.kind) for r in secrets.BASE), digest, secrets.joined(F.col("secrets")).alias("spans"))


def op4_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    media_rows = stored(media.wrapped(docs, "text", ("doc_id",)), f"{shared_dir(spark)}/media")
    back = media.payloads(media_rows, ("doc_id", "n_bytes", "media"))
    first = F.element_at("keyframes", 1)
    feature = F.concat_ws(
        ";", F.trim("codec"), F.format_string("%.3fs", "duration_s"), F.concat("n_samples", F.lit(" units")),
        F.concat(F.size("keyframes"), F.lit(" keyframes")), F.concat_ws("-", first["start"], first["end"]),
    )
    return back.select(
        "doc_id",
        "n_bytes",
        F.octet_length("payload").cast("long").alias("payload_bytes"),
        F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(F.substring("payload", -32, 32)).alias("tail_crc32"),
        F.octet_length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        feature.alias("feature"),
    )


def op5_warc_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = warc.archived(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op6_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = mixing.plan_mix(table(spark, sf_dir, "documents"))
    return plan.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return urls.judged(pages, urls.train(urls.labelled_urls(spark))).select("page_id", "host", "path", "rule", "verdict", "score")


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contained(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = toxicity.judged(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))
    return out.select("doc_id", (toxicity.fold_of(F.col("doc_id")) == 0).alias("held_out"), "score", "predicted")


def op10_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents"))


def op11_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(table(spark, sf_dir, "documents"), tokenizer_path())


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = table(spark, sf_dir, "conversations")
    made = repair.summaries(repair.edited(repair.faulted(repair.damaged(given)))).withColumnRenamed("conv_id", "of")
    out = given.select("conv_id").distinct().join(made, F.col("conv_id").eqNullSafe(F.col("of")), "left")
    counts = {c: F.coalesce(c, F.lit(0).cast("long")) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")}
    nothing = {"audit": F.coalesce("audit", F.lit("")), "repaired_sha256": F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256))}
    return out.select("conv_id", *(v.alias(c) for c, v in (counts | nothing).items()))


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audited(table(spark, sf_dir, "documents"))


def queries() -> dict:
    return {f.__name__: f for f in (op1_suffix_dedup, op2_token_store, op3_secret_scan, op4_media_columns, op5_warc_archive, op6_mix_sources, op7_url_filter, op8_decontamination, op9_toxicity, op10_near_duplicates, op11_best_fit_packing, op12_conversation_repair, op13_source_divergence)}
