"""Order over many rows without one task that sees them all.

Rows are dealt by ranges of the order and written once, so that the ranges are
fixed. Each range is put in order by itself; what it needs of those before it,
their totals or the last row of all, is one row a range. A group of any size is
so spread over tasks, where a window by group would bring it into one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import stored


def _ranged(rows: DataFrame, keys: list[Column]) -> tuple[DataFrame, list[str]]:
    """(rows with ``__range`` and their keys as columns, written; the keys' names)."""
    names = [f"__key{i}" for i in range(len(keys))]
    out = rows.select("*", *(k.alias(n) for k, n in zip(keys, names, strict=True)))
    return stored(out.repartitionByRange(*(F.col(n).asc_nulls_first() for n in names)).withColumn("__range", F.spark_partition_id())), names


def _within(names: list[str]):
    return Window.partitionBy("__range").orderBy(*(F.col(n).asc_nulls_first() for n in names))


def running(rows: DataFrame, keys: list[Column], add: dict[str, Column]) -> DataFrame:
    """``rows`` with, for each of ``add``, the sum of its long over all rows before in the order of ``keys``, nulls first.

    Rows that tie in all keys are taken in any order.
    """
    ranged, names = _ranged(rows, keys)
    totals = ranged.groupBy("__range").agg(*(F.sum(e).alias(f"__sum_{c}") for c, e in add.items()))
    before = Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
    totals = totals.select(F.col("__range").alias("__of"), *(F.coalesce(F.sum(f"__sum_{c}").over(before), F.lit(0)).alias(f"__sum_{c}") for c in add))
    ahead = _within(names).rowsBetween(Window.unboundedPreceding, -1)
    out = ranged.select("*", *(F.coalesce(F.sum(e).over(ahead), F.lit(0)).alias(f"__own_{c}") for c, e in add.items()))
    out = out.join(totals, F.col("__range") == F.col("__of"))
    return out.select(*rows.columns, *((F.col(f"__sum_{c}") + F.col(f"__own_{c}")).cast("long").alias(c) for c in add))


def previous(rows: DataFrame, group: str, order: list[Column], value: Column, name: str) -> DataFrame:
    """``rows`` with ``name``: the ``value`` of the row before in its group, null for the first.

    The last row of each range is handed to the next range that has rows.
    """
    ranged, names = _ranged(rows.withColumn("__value", value), [F.col(group), *order])
    here = F.struct(*names)
    last = ranged.groupBy("__range").agg(F.max_by(F.struct(F.col("__key0").alias("group"), F.col("__value").alias("value")), here).alias("last"))
    handed = last.select(F.col("__range").alias("__to"), F.lag("last").over(Window.orderBy("__range")).alias("__handed"))  # a row for each range
    at, before = F.row_number().over(_within(names)), F.lag(F.struct(F.col("__key0").alias("group"), F.col("__value").alias("value"))).over(_within(names))
    out = ranged.withColumns({"__at": at, "__before": before}).join(handed, F.col("__range") == F.col("__to"))
    found = F.when(F.col("__at") == 1, F.col("__handed")).otherwise(F.col("__before"))
    return out.select(*rows.columns, F.when(found["group"].eqNullSafe(F.col("__key0")), found["value"]).alias(name))
