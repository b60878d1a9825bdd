"""Runs within ordered logs, folded from ranges so that no task or window holds the log of one producer."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quarry.storage import materialise


def in_ranges(rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    """``rows`` dealt by ranges of (key, order) and written, with the number of each row's ``range``.

    However many rows a key has, a range holds about as many as any other; ranges of a key follow one another in number. The
    copy is read again for each use, so numbers don't change between them.
    """
    return materialise(rows.repartitionByRange(key, *order).withColumn("range", F.spark_partition_id()), "ranges")


def _within(key: str, order: list[str]):
    return Window.partitionBy("range", key).orderBy(*order)


def _folded(ranged: DataFrame, key: str, *sums) -> DataFrame:
    """One row for each key and range; a key has at most as many as there are ranges."""
    return ranged.groupBy(F.col(key).alias("k"), F.col("range").alias("r")).agg(*sums)


def _onto(ranged: DataFrame, folded: DataFrame, key: str) -> DataFrame:
    return ranged.join(folded, F.col(key).eqNullSafe(F.col("k")) & (F.col("range") == F.col("r"))).drop("k", "r")


def _earlier():
    return Window.partitionBy("k").orderBy("r").rowsBetween(Window.unboundedPreceding, -1)


def run_places(ranged: DataFrame, key: str, order: list[str], failed: str = "failed", began: DataFrame | None = None) -> DataFrame:
    """Each row with ``island`` (rows of the key before it that didn't fail) and ``place`` (how many failures in a row end with it; 0 if it didn't fail).

    A range of a key is folded into how many rows it has, how many didn't fail, and how many failures it ends with. That fold is associative: a
    range's run goes on from the ranges before it, back to the last one in which something didn't fail. ``began`` (key,
    ``streak``) has failures in a row that a key brings along from before the first range.
    """
    passed = (~F.col(failed)).cast("int")
    local = _within(key, order)
    n = F.row_number().over(local)
    last = F.max(F.when(~F.col(failed), n)).over(local)
    here = ranged.select("*", F.sum(passed).over(local).alias("_passed"), n.alias("_n"), last.alias("_last"))
    here = here.withColumn("_own", F.when(F.col(failed), F.col("_n") - F.coalesce("_last", F.lit(0))).otherwise(0))
    folded = _folded(here, key, F.count("*").alias("rows"), F.sum(passed).alias("passes"), F.max_by("_own", "_n").alias("ends_with"))
    before = _earlier()
    through = F.sum("rows").over(Window.partitionBy("k").orderBy("r").rowsBetween(Window.unboundedPreceding, 0))
    summed = folded.withColumn("_through", through).withColumn("_stop", F.when(F.col("passes") > 0, F.struct("_through", "ends_with")))
    stop = F.last("_stop", ignorenulls=True).over(before)
    earlier = F.coalesce(F.sum("rows").over(before), F.lit(0))
    carried = summed.select("k", "r", F.coalesce(F.sum("passes").over(before), F.lit(0)).alias("_before"), earlier.alias("_rows"), stop.alias("_at"))
    if began is not None:
        carried = carried.join(began.select(F.col(key).alias("b"), "streak"), F.col("k").eqNullSafe(F.col("b")), "left").drop("b")
    start = F.coalesce("streak", F.lit(0)) if began is not None else F.lit(0)
    carried = carried.withColumn("_carry", F.when(F.col("_at").isNull(), F.col("_rows") + start).otherwise(F.col("_rows") - F.col("_at._through") + F.col("_at.ends_with")))
    met = _onto(here, carried.select("k", "r", "_before", "_carry"), key)
    place = F.when(F.col(failed), F.col("_own") + F.when(F.col("_last").isNull(), F.col("_carry")).otherwise(0)).otherwise(0)
    return met.select(*ranged.columns, (F.col("_before") + F.col("_passed")).cast("long").alias("island"), place.cast("long").alias("place"))


def following(ranged: DataFrame, key: str, order: list[str], value: Column) -> DataFrame:
    """Each row with ``next``: ``value`` in the key's next row, null in its last. The last row of a range takes the first of the key's next range."""
    local = _within(key, order)
    here = ranged.withColumns({"_value": value, "_n": F.row_number().over(local)}).withColumn("_next", F.lead("_value").over(local))
    folded = _folded(here, key, F.min_by("_value", "_n").alias("first"), F.max("_n").alias("size"))
    after = folded.select("k", "r", "size", F.lead("first").over(Window.partitionBy("k").orderBy("r")).alias("_after"))
    met = _onto(here, after, key)
    return met.select(*ranged.columns, F.when(F.col("_n") == F.col("size"), F.col("_after")).otherwise(F.col("_next")).alias("next"))
