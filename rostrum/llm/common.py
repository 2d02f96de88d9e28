"""What the operators share: tables, the scratch folder, and global order.

Scratch tables cut lineage: an executor that is lost later costs a re-read of
Parquet in the shared folder, never a recomputation of the whole job.
"""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The Parquet table ``name`` below ``sf_dir``; any path that Spark can read."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """A new folder below ``spark.checkpoint.dir``, which all executors share.

    Only where it is unset and all runs on one machine, as in tests, a
    temporary folder is taken, and remembered in the setting.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base and not spark.sparkContext.master.startswith("local"):
        raise ValueError("on a cluster spark.checkpoint.dir must name a folder that all executors share")
    if not base:
        base = f"file://{tempfile.mkdtemp(prefix='rostrum-')}"
        spark.conf.set("spark.checkpoint.dir", base)
    jvm = spark.sparkContext._jvm
    folder = jvm.org.apache.hadoop.fs.Path(f"{base.rstrip('/')}/rostrum-{uuid.uuid4().hex}")
    fs = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    folder = fs.makeQualified(folder)
    fs.mkdirs(folder)
    fs.deleteOnExit(folder)
    return re.sub(r"^file:/+", "file:///", folder.toString())


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a folder below the shared folder."""
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def stored(df: DataFrame, path: str, codec: str = "zstd") -> DataFrame:
    """``df`` written as Parquet at ``path`` and read back: lineage ends there."""
    df.write.option("compression", codec).mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spare(df: DataFrame, *names: str) -> list[str]:
    """Names for helper columns that ``df`` lacks: the given ones after as many underscores as it takes."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        name = f"__{name}"
        while name.lower() in taken:
            name = f"_{name}"
        out.append(name)
    return out


#: Sizes of Arrow batches that operators choose.
BATCHES = (256, 1024)


def small_batches(spark: SparkSession, rows: int = BATCHES[0]) -> None:
    """Arrow batches of ``rows`` rows, so that long texts don't fill a Python worker.

    A smaller setting of the session's own stays.
    """
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(key, "10000"))
    if now > rows or now <= 0 or now in BATCHES:
        spark.conf.set(key, str(rows))


@contextmanager
def batches_of(spark: SparkSession, rows: int = BATCHES[0]):
    """Arrow batches of at most ``rows`` rows for what runs inside, so that long texts don't fill a Python worker."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key, "10000")
    spark.conf.set(key, str(rows if int(before) <= 0 else min(rows, int(before))))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def exact_ids(df: DataFrame, fn: Callable[[Iterator], Iterator], schema: str, *ids: str) -> DataFrame:
    """``df.mapInPandas(fn, schema)`` with the long columns ``ids`` as text on either side of ``fn``.

    Pandas turns longs into doubles wherever a batch also has a null, and these
    hold 53 bits only.
    """
    told = StructType.fromDDL(schema)
    types = StructType([StructField(f.name, StringType() if f.name in ids else f.dataType) for f in told])
    sent = df.select(*(F.col(f"`{c}`").cast("string").alias(c) if c in ids else F.col(f"`{c}`") for c in df.columns))
    out = sent.mapInPandas(fn, types)
    return out.select(*(F.col(f"`{f.name}`").cast(f.dataType).alias(f.name) if f.name in ids else F.col(f"`{f.name}`") for f in told))


def in_order(df: DataFrame, path: str, keys: list[Column], add: dict[str, Column]) -> DataFrame:
    """Adds exclusive running sums over the global order of ``keys``.

    ``add`` maps a new column to the long expression that is summed over all
    rows before. Rows are dealt by ranges of ``keys`` and written once, so that
    the ranges are fixed; each range then sums its own rows and adds the totals
    of the ranges before it. No task sees more than one range. Rows that tie in
    all keys are taken in any order: give keys that tell unlike rows apart.
    """
    names = [f"__key{i}" for i in range(len(keys))]
    ranged = df.select("*", *(k.alias(n) for k, n in zip(keys, names, strict=True)))
    ranged = ranged.repartitionByRange(*(F.col(n).asc_nulls_first() for n in names))
    ranged = stored(ranged.withColumn("__range", F.spark_partition_id()), path)
    totals = ranged.groupBy("__range").agg(*(F.sum(e).alias(f"__sum_{c}") for c, e in add.items()))
    before = Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)  # one row for each range
    totals = totals.select(
        "__range", *(F.coalesce(F.sum(f"__sum_{c}").over(before), F.lit(0)).alias(f"__sum_{c}") for c in add)
    )
    within = (
        Window.partitionBy("__range")
        .orderBy(*(F.col(n).asc_nulls_first() for n in names))
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    out = ranged.select("*", *(F.coalesce(F.sum(e).over(within), F.lit(0)).alias(f"__own_{c}") for c, e in add.items()))
    out = out.join(totals, "__range")
    return out.select(*df.columns, *((F.col(f"__sum_{c}") + F.col(f"__own_{c}")).cast("long").alias(c) for c in add))
