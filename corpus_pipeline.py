"""The training-data pipeline: from raw documents to a store of token ids.

Each stage reads what its predecessor kept; all but the last return the columns
of documents. Null and empty texts pass as empty ones: they are judged, are one
group of copies, match no test item, have no words to mix and so are never
taken. Repeated rows are one group of copies. Empty tables pass through all
stages; without labels no text counts as toxic, without test items none is held.
Columns of any other names are carried along up to the last stage.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from rostrum.llm import decontam, mixing, neardup, tokens, toxicity
from rostrum.llm.common import shared_dir, stored, table
from rostrum.llm.queries import tokenizer_path


def screen_toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that the toxicity model rejects. The model learns from the labelled ones among ``docs``."""
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    return toxicity.judged(docs, model).where("predicted = 0").select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each class of near-duplicates."""
    return neardup.one_of_each(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that contain a test item."""
    return decontam.clean(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats and samples documents to the sources' target weights: a document that is taken twice is two rows."""
    return mixing.mixed(docs)


def store_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Writes the token store and reads it back: doc_id, start, n_tokens, ids_crc32."""
    return tokens.read_store(tokens.write_store(docs, tokenizer_path()))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", screen_toxicity),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", decontaminate),
    ("mixing", mix_sources),
    ("token_store", store_tokens),
]

#: No SQL for the stages: a trained model, signatures and a tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what each keeps is written, and read by the next."""
    docs, home = table(spark, sf_dir, "documents"), shared_dir(spark)
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = stored(docs, f"{home}/{k}-{name}")
    return docs
