"""Bounded samples of rows to learn from."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def bounded_sample(rows: DataFrame, k: int, draw: Column, by: str | None = None, most_values: int = 256) -> DataFrame:
    """The ``k`` rows of smallest ``draw`` (a 64-bit hash), or of each value of ``by``; never more than k.

    An estimate of how many draws there are gives the share that holds about 4 k of a group's, so that few rows are shuffled at
    any size of the table; then the k smallest are taken, in every partition before the shuffle, which bounds rows of equal draw. ``by`` is
    meant to have few values; of more than ``most_values`` the commonest count, the others give no rows. Their counts go to the driver.
    """
    drawn = rows.withColumn("_draw", draw)
    if by is None:
        least = F.lit(_threshold(4 * k, drawn.agg(F.approx_count_distinct("_draw").alias("n")).first().n))
        return drawn.filter(F.col("_draw") <= least).orderBy("_draw").limit(k).drop("_draw")
    counts = [(r[by], r.n) for r in drawn.filter(F.col(by).isNotNull()).groupBy(by).agg(F.approx_count_distinct("_draw").alias("n")).orderBy(F.desc("n"), by).limit(most_values).collect()]
    if not counts:
        return rows.limit(0)
    least = F.create_map(*(F.lit(x) for value, n in counts for x in (value, _threshold(4 * k, n))))
    near = drawn.filter(F.col("_draw") <= least[F.col(by)])
    at = F.row_number().over(Window.partitionBy(by).orderBy("_draw"))
    return near.withColumn("_at", at).filter(F.col("_at") <= k).drop("_at", "_draw")


def _threshold(wanted: int, n: int) -> int:
    return -(2**63) + min(2**64 - 1, (2**64 * wanted) // max(1, n))
