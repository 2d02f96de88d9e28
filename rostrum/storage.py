"""Scratch tables in the folder that all executors share.

They cut lineage: an executor that is lost later costs a re-read of Parquet,
never a recomputation of the whole job.
"""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """A new folder below ``spark.checkpoint.dir``, which all executors share; it goes when the session ends.

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


def stored(df: DataFrame, path: str | None = None, codec: str = "zstd") -> DataFrame:
    """``df`` written as Parquet at ``path``, or in a folder of its own, and read back: lineage ends there."""
    path = path or f"{shared_dir(df.sparkSession)}/table"
    df.write.option("compression", codec).mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
