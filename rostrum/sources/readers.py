"""Readers: JSON lines, line corpora, word lists, annotator tables, caches."""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.arrays import let
from ..functions.text import composed, decoded_whitespace, without_soft_hyphens

_PERSON = T.StructType([T.StructField(n, T.StringType()) for n in ("id", "name", "faction", "office")] + [T.StructField("is_mp", T.BooleanType())])
_AGENDA = T.StructType([T.StructField(n, T.StringType()) for n in ("id", "title", "kind")])

SPEECH = T.StructType(
    [T.StructField(n, T.StringType()) for n in ("uid", "date", "speech_type", "text", "text_clean")]
    + [T.StructField("speaker", _PERSON), T.StructField("agenda", _AGENDA), T.StructField("n_words", T.LongType())]
    + [T.StructField(n, T.DoubleType()) for n in ("time_start_s", "duration_s")]
    + [T.StructField("sentences", T.ArrayType(T.StringType())), T.StructField("sentence_paragraphs", T.ArrayType(T.IntegerType()))]
)
_TURN = T.StructType([T.StructField(n, T.StringType()) for n in ("uid", "role", "text")] + [T.StructField("speaker", _PERSON)])
EXCHANGE = T.StructType(
    [T.StructField("exchange_id", T.StringType()), T.StructField("turns", T.ArrayType(_TURN))]
    + [T.StructField("answer_accepted", T.BooleanType()), T.StructField("complete", T.BooleanType())]
)


def dealt_out(rows: DataFrame, key: str) -> DataFrame:
    """Rows of a table in fewer pieces than there are cores, dealt out by ``key``; others as they are.

    A Parquet file of one row group is one task's work, however many splits it
    is planned as. Tables of many files are left alone, so nothing is shuffled
    where it would cost.
    """
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(cores, key) if len(rows.inputFiles()) < cores and rows.rdd.getNumPartitions() <= cores else rows


def data_dir(argument: str | None = None, variable: str = "ROSTRUM_DATA", default: str = "data/raw") -> str:
    """The argument, or else the environment variable, or else the default."""
    return argument or os.environ.get(variable) or default


def json_lines(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Records of a file of JSON lines; blank lines are passed over, a malformed one fails the job."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def malformed_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, line_no, line) of lines that are no JSON, counted from 1: to be run when ``json_lines`` has failed."""
    rows = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_name").alias("file"), F.posexplode(F.split("value", r"\R")).alias("i", "line"))
    bad = (F.trim("line") != "") & F.try_parse_json("line").isNull()
    return rows.where(bad).select("file", (F.col("i") + 1).alias("line_no"), "line")


def speeches(spark: SparkSession, path: str) -> DataFrame:
    return json_lines(spark, path, SPEECH)


def exchanges(spark: SparkSession, path: str) -> DataFrame:
    """Question-time exchanges, incomplete ones too."""
    return json_lines(spark, path, EXCHANGE)


def json_document(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """One row of a file that is one JSON document."""
    reader = spark.read.option("multiLine", True).option("mode", "FAILFAST")
    return (reader.schema(schema) if schema else reader).json(path)


def line_corpus(spark: SparkSession, path: str, pattern: str = r"cycle(\d+)", limit: int | None = None, normalise: bool = True) -> DataFrame:
    """(cycle, line_no, text, hyphens): lines of text files in the order of their file; blank ones are dropped.

    The cycle is taken from the file's name; a name without one fails. Line
    numbers count lines that are not blank, from 0, for each file alone: a
    file is read whole, since its order is data. ``limit`` keeps the first
    lines of each file.
    """
    files = spark.read.text(path, wholetext=True).select(F.regexp_extract("_metadata.file_name", pattern, 1).alias("c"), "value")
    named = F.when(F.col("c") != "", F.col("c").cast("int")).otherwise(F.raise_error(F.lit("a file's name has no cycle")).cast("int"))
    kept = F.filter(F.split("value", r"\R|[\x1c-\x1e]"), lambda x: F.trim(x) != "")
    if limit is not None:
        kept = F.slice(kept, 1, limit)
    rows = files.select(named.alias("cycle"), F.posexplode(kept).alias("line_no", "line"))
    bare, removed = without_soft_hyphens(F.col("line"))
    return rows.select("cycle", "line_no", (bare if normalise else F.col("line")).alias("text"), (removed if normalise else F.lit(0)).alias("hyphens"))


def word_list(spark: SparkSession, path: str, name: str) -> DataFrame:
    """(category, entry, n_words, lexicon_id) of a list with an entry a line; blank lines and comments are passed over, marks are joined to their letters. An empty list fails."""
    content = spark.read.format("binaryFile").load(path).select(F.sha2("content", 256).alias("sha"), F.decode("content", "UTF-8").alias("t"))
    rows = content.select("sha", F.explode(F.split("t", r"\R")).alias("line"))
    rows = rows.select("sha", F.lower(composed(F.trim(F.regexp_replace("line", r"\s+", " ")))).alias("entry")).where("entry <> '' AND NOT startswith(entry, '#')").distinct()
    out = rows.select(F.lit(name).alias("category"), "entry", F.size(F.split("entry", " ")).alias("n_words"), F.concat(F.lit(f"{name}@"), F.substring(F.col("sha"), 1, 12)).alias("lexicon_id"))
    if out.isEmpty():
        raise ValueError(f"{path} has no entries")
    return out


def two_poles(spark: SparkSession, path: str) -> DataFrame:
    """(category as virtue/pole, entry, n_words) of a JSON document of virtues; keys with ``_`` in front are passed over, both poles must be there."""
    pole = T.StructType([T.StructField("affirming", T.ArrayType(T.StringType())), T.StructField("accusing", T.ArrayType(T.StringType()))])
    text = spark.read.text(path, wholetext=True).select(F.from_json("value", T.MapType(T.StringType(), T.StringType())).alias("m"))
    rows = text.select(F.explode("m").alias("virtue", "body")).where("NOT startswith(virtue, '_')").select("virtue", F.from_json("body", pole).alias("p"))
    whole = F.col("p.affirming").isNotNull() & F.col("p.accusing").isNotNull()
    rows = rows.withColumn("virtue", F.when(whole, F.col("virtue")).otherwise(F.raise_error(F.concat("virtue", F.lit(" lacks a pole"))).cast("string")))
    each = rows.select("virtue", F.explode(F.create_map(F.lit("affirming"), "p.affirming", F.lit("accusing"), "p.accusing")).alias("pole", "entries"))
    each = each.select(F.concat_ws("/", "virtue", "pole").alias("category"), F.explode("entries").alias("entry")).withColumn("entry", F.lower("entry"))
    return each.select("category", "entry", F.size(F.split("entry", r"\s+")).alias("n_words"))


def csv_table(spark: SparkSession, path: str, schema: T.StructType, hint: str = "") -> DataFrame:
    """A CSV file with a header; a missing one fails with ``hint``."""
    try:
        return spark.read.option("header", True).schema(schema).csv(path)
    except Exception as e:
        if "PATH_NOT_FOUND" in str(e):
            raise FileNotFoundError(f"{path} is missing. {hint}".strip()) from e
        raise


def annotated_tsv(payloads: DataFrame) -> DataFrame:
    """Tokens (doc_id, sent_id, pos, form, lemma, xpostag, upostag, dep_id, head, wsafter) of annotator tables (doc_id, payload).

    Columns are found by the header's names, whatever their order; those that
    are missing are null. Blank lines end sentences, short rows are passed
    over, ``_`` is no number. A payload is cut up where it lies; nothing is
    shuffled.
    """
    named = lambda lines: F.split(lines[0], "\t")

    def sentences(lines: Column, names: Column) -> Column:
        """Arrays of rows as arrays of cells, one for each run of lines between blank ones that has rows."""
        blank = F.filter(F.transform(lines, lambda x, i: F.when((i > 0) & (F.trim(x) == ""), i)), lambda i: i.isNotNull())
        ends = let(F.array_append(blank, F.size(lines)), lambda b: F.transform(b, lambda end, k: F.struct(F.when(k > 0, F.get(b, k - 1) + 1).otherwise(1).alias("start"), end.alias("end"))))
        form = F.array_position(names, "form")
        cells = lambda x: F.filter(F.transform(x, lambda line: F.split(line, "\t")), lambda c: F.size(c) >= form)
        return F.filter(F.transform(ends, lambda e: cells(F.slice(lines, e["start"] + 1, e["end"] - e["start"]))), lambda rows: F.size(rows) > 0)

    numbered = lambda found: F.flatten(F.transform(found, lambda rows, s: F.transform(rows, lambda c: F.struct(s.alias("sent_id"), c.alias("cells")))))
    parts = let(F.split("payload", r"\r?\n"), lambda lines: let(named(lines), lambda names: F.struct(names.alias("names"), numbered(sentences(lines, names)).alias("rows"))))
    rows = payloads.select("doc_id", F.inline(F.array(parts))).select("doc_id", "names", F.posexplode("rows").alias("pos", "row")).select("doc_id", "row.sent_id", "pos", "names", "row.cells")
    cell = lambda name: F.try_element_at("cells", F.nullif(F.array_position("names", name).cast("int"), F.lit(0)))
    number = lambda name: F.try_to_number(F.nullif(cell(name), F.lit("_")), F.lit("999999")).cast("int")
    return rows.select(
        "doc_id", "sent_id", "pos", cell("form").alias("form"), cell("lemma").alias("lemma"),
        cell("xpostag").alias("xpostag"), cell("upostag").alias("upostag"), number("id").alias("dep_id"), number("head").alias("head"), decoded_whitespace(cell("wsafter")).alias("wsafter"),
    )


def input_lines(tokens: DataFrame, expected: DataFrame | None = None) -> DataFrame:
    """Adds ``line``: which line of its document's text a token came from, by the line breaks in the white space before it.

    ``expected`` (doc_id, n_lines) says how many lines each text had. A
    document whose line breaks account for another number fails the job: its
    tokens can't be told apart by line with certainty.
    """
    before = Window.partitionBy("doc_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    breaks = F.coalesce(F.length("wsafter") - F.length(F.replace("wsafter", F.lit("\n"), F.lit(""))), F.lit(0))
    out = tokens.withColumn("line", F.coalesce(F.sum(breaks).over(before), F.lit(0)))
    if expected is None:
        return out
    # the last token's line, and what follows it if it ends its line
    seen = out.groupBy(F.col("doc_id").alias("__of")).agg((F.max(F.col("line") + breaks) + F.when(F.max_by(breaks, "pos") > 0, 0).otherwise(1)).alias("__seen"))
    known = seen.join(expected.select(F.col("doc_id").alias("__known"), "n_lines"), F.col("__of") == F.col("__known"), "left")
    said = F.concat(F.lit("document "), F.col("__of").cast("string"), F.lit(" accounts for "), F.col("__seen").cast("string"), F.lit(" lines, not "), F.coalesce(F.col("n_lines").cast("string"), F.lit("any")))
    checked = known.select("__of", F.when(F.col("__seen").eqNullSafe(F.col("n_lines")), True).otherwise(F.raise_error(said).cast("boolean")).alias("__right"))
    return out.join(checked, F.col("doc_id") == F.col("__of")).where("__right").drop("__of", "__right")


def annotations(spark: SparkSession, path: str, modules: str, normalisation: str) -> DataFrame:
    """The rows of an annotation store that one chain and normalisation made: partitions of other ones are not read."""
    return spark.read.parquet(path).where((F.col("modules") == modules) & (F.col("normalisation") == normalisation))


def last_written(rows: DataFrame, key: str, order: str) -> DataFrame:
    """Of rows with the same key the one written last."""
    rest = [c for c in rows.columns if c != key]
    return rows.groupBy(key).agg(F.max_by(F.struct(*rest), order).alias("__r")).select(key, *(F.col(f"__r.{c}").alias(c) for c in rest))


def provenance(spark: SparkSession, folder: str, expected: list[str], manifest: str) -> DataFrame:
    """(file, bytes, sha256) of expected files, nulls for those that are missing; without the manifest it fails."""
    found = spark.read.format("binaryFile").load(folder).select(F.element_at(F.split("path", "/"), -1).alias("name"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))
    if found.where(F.col("name") == manifest).isEmpty():
        raise FileNotFoundError(f"{folder} has no {manifest}")
    wanted = spark.createDataFrame([(e,) for e in expected], "file string")
    return wanted.join(found, F.col("file") == F.col("name"), "left").drop("name")
