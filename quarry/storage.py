"""Cutting lineage through the folder that every executor shares."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder the cluster names in ``spark.checkpoint.dir``; only a session without it gets a folder of its own."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    own = "file://" + tempfile.mkdtemp(prefix="spark-")
    spark.conf.set("spark.checkpoint.dir", own)
    return own


#: Folders written in each open scope, the innermost last.
_SCOPES: list[list[str]] = []


def materialise(df: DataFrame, name: str = "stage", keep: bool = False) -> DataFrame:
    """Write ``df`` once as Parquet in the shared folder and read it back.

    The copy outlives lost executors and ends the lineage, like a reliable checkpoint, but is
    compressed and columnar, so later readers prune columns and see true sizes. Within ``scratch`` it is dropped at the end, unless it is to ``keep``.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    if _SCOPES and not keep:
        _SCOPES[-1].append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def written_once(spark: SparkSession, name: str, build: Callable[[], DataFrame]) -> DataFrame:
    """What ``build`` gives, as a table that is written under ``name`` once for each application, and again only if it is gone."""
    path = f"{shared_dir(spark)}/{spark.sparkContext.applicationId}-{name}"
    where = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if not where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where):
        build().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Tables that are written within are dropped at the end, by when the caller has to have written its result."""
    _SCOPES.append([])
    try:
        yield
    finally:
        for path in _SCOPES.pop():
            where = spark._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


#: Bytes that a side may have to be broadcast.
BROADCAST_BYTES = 256 << 20


def broadcast_if_small(df: DataFrame, max_rows: int, row_bytes: Column | int = 64) -> DataFrame:
    """Hint a broadcast only after measuring ``df``; beyond ``max_rows`` rows or BROADCAST_BYTES the join shuffles on its key.

    ``row_bytes`` is about what a row takes: a number, or a Column where rows hold strings or arrays.
    """
    size = row_bytes if isinstance(row_bytes, Column) else F.lit(row_bytes)
    found = df.select(size.cast("long").alias("b")).limit(max_rows + 1).agg(F.count("*").alias("n"), F.coalesce(F.sum("b"), F.lit(0)).alias("bytes")).first()
    return F.broadcast(df) if found.n <= max_rows and found.bytes <= BROADCAST_BYTES else df
