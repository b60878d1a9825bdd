"""Structured Streaming operators; each also runs on a batch frame where it keeps no state of its own."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator, Sequence
from contextlib import contextmanager
from functools import reduce
from operator import and_

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.window import Window

from quarry.operators.runs import in_ranges, run_places
from quarry.storage import materialise, shared_dir


def events(spark: SparkSession, sf_dir: str, max_bytes: int = 256 << 20) -> DataFrame:
    """The events table as a stream of files, of which a batch takes at most ``max_bytes``, or one file if that is larger."""
    kind = spark.read.parquet(f"{sf_dir}/events*.parquet").schema
    files = spark.readStream.schema(kind).option("pathGlobFilter", "events*.parquet").option("maxBytesPerTrigger", str(max_bytes))
    return files.parquet(sf_dir).withColumn("ts", F.col("ts").cast("timestamp"))


def finish(spark: SparkSession, stream: DataFrame, mode: str) -> DataFrame:
    """Run a stream over all that is there, with its results and checkpoint in the shared folder, and read them.

    Each batch is written under its number, once however often it is tried; complete mode keeps the last.
    """
    root = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    out = f"{root}/out"

    def keep(batch: DataFrame, number: int) -> None:
        batch.withColumn("_batch", F.lit(number).cast("long")).write.mode("overwrite").parquet(f"{out}/n={number}")

    stream.writeStream.outputMode(mode).foreachBatch(keep).option("checkpointLocation", f"{root}/state").trigger(availableNow=True).start().awaitTermination()
    rows = spark.read.option("recursiveFileLookup", True).parquet(out)
    if mode == "complete":
        last = rows.agg(F.max("_batch").alias("last"))
        rows = rows.join(F.broadcast(last), F.col("_batch") == F.col("last")).drop("last")
    return rows.drop("_batch")


def time_slices(rows: DataFrame, n: int, ts: str = "ts") -> list[DataFrame]:
    """``rows`` in ``n`` slices of equal time, the earliest first; the ends are one row."""
    us = F.unix_micros(F.col(ts))
    lo, hi = rows.agg(F.min(us), F.max(us)).first()
    if lo is None:
        return [rows] * n
    at = F.floor((us - lo) * n / F.lit(hi - lo + 1))
    return [rows.filter(at == k) for k in range(n)]


def replay(spark: SparkSession, slices: Sequence[DataFrame], plan: Callable[[DataFrame], DataFrame], mode: str = "update", fold: Callable[[DataFrame, int, str], DataFrame] | None = None, progress: list | None = None) -> DataFrame:
    """Rows of a stream to which ``slices`` arrive one after another, with the ``slice`` that brought each.

    Every slice is appended to the stream's folder, then the query is started, takes in all that is new, and ends; the next start
    goes on from its checkpoint. So state outlives the query between slices, as it outlives a restart. Input, state and
    results are in the shared folder. ``fold`` (batch, its number, the stream's folder) turns a batch into what is written; it may be tried again under the
    same number. ``progress`` gets each start's reports.
    """
    root = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    for k, part in enumerate(slices):
        part.write.mode("append").parquet(f"{root}/in")

        def keep(batch: DataFrame, number: int, k: int = k) -> None:
            rows = fold(batch, number, root) if fold else batch
            rows.withColumn("slice", F.lit(k).cast("long")).write.mode("overwrite").parquet(f"{root}/out/n={number}")

        stream = plan(spark.readStream.schema(part.schema).parquet(f"{root}/in"))
        query = stream.writeStream.outputMode(mode).foreachBatch(keep).option("checkpointLocation", f"{root}/state").trigger(availableNow=True).start()
        query.awaitTermination()
        if progress is not None:
            progress.append(list(query.recentProgress))
    return spark.read.option("recursiveFileLookup", True).parquet(f"{root}/out")


@contextmanager
def kept_in_files(spark: SparkSession) -> Iterator[None]:
    """State of streams that are started within is held by RocksDB, on disk and in increments; ``transformWithState`` needs it."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def quota_windows(log: DataFrame, max_requests: int = 200, max_tokens: int = 200_000, late: str = "10 minutes", slide: str | None = None) -> DataFrame:
    """Requests and tokens in windows of 60 seconds, which begin every ``slide`` (each after the last if not given), and whether they exceed the limits."""
    source = log.withWatermark("ts", late) if log.isStreaming else log
    sums = source.groupBy(F.window("ts", "60 seconds", slide).alias("w")).agg(F.count("*").alias("requests"), F.sum("tokens").alias("tokens"))
    return sums.select(F.col("w.start").alias("start"), "requests", "tokens", ((F.col("requests") > max_requests) | (F.col("tokens") > max_tokens)).alias("over"))


def run_sessions(rows: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    source = rows.withWatermark("ts", late) if rows.isStreaming else rows
    return source.groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n")).select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("stop"), "n")


def _us(interval: str) -> int:
    return pd.Timedelta(interval).value // 1000


#: From so many keys of a batch on, a share's state is read in one go; below, each key asks for its own.
READ_WHOLE = 64


def _seen(state, wanted: set[tuple]) -> dict[tuple, int]:
    """What a map state holds for the ``wanted`` keys: reading it as a whole comes in batches, while each single key is a call to the JVM."""
    if len(wanted) >= READ_WHOLE:
        return {k: us for k, (us,) in state.iterator() if k in wanted}
    return {k: state.getValue(k)[0] for k in wanted if state.containsKey(k)}


def _forget(state, lifetime_us: int, now_us: int) -> int | None:
    """Drop a map state's entries that have run out; the time of the oldest that is left."""
    due, soonest = [], None
    for k, (us,) in state.iterator():
        if us + lifetime_us <= now_us:
            due.append(k)
        else:
            soonest = us if soonest is None else min(soonest, us)
    for k in due:
        state.removeKey(k)
    return soonest


def _keyed(rows: Iterator[pd.DataFrame], names: list[str]) -> pd.DataFrame:
    """The keys of a share's rows as they are, null ones as None, and their times ``us``."""
    parts = [pdf[names].assign(us=pdf["ts"].to_numpy("datetime64[us]").astype(np.int64)).drop_duplicates() for pdf in rows]
    whole = pd.concat(parts, ignore_index=True)
    return whole.assign(**{n: whole[n].astype(object).where(whole[n].notna(), None) for n in names})


def in_shares(stream: DataFrame, names: list[str], shares: int, late: str):
    """A stream grouped by shares of its keys, which become strings: a share is one call of Python for many keys, and no topic is one task."""
    texts = [F.col(n).cast("string").alias(n) for n in names]
    return stream.select(*texts, "ts").withColumn("share", F.pmod(F.xxhash64(*names), F.lit(shares))).withWatermark("ts", late).groupBy("share")


class FirstWithin(StatefulProcessor):
    """Keeps a key's row if none was kept in the ``lifetime`` before it. The state of a share is a map from key to the time of the last row that was kept; timers drop keys when that has run out."""

    def __init__(self, lifetime_us: int, names: list[str]):
        self.lifetime, self.names = lifetime_us, names

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.kept = handle, handle.getMapState("kept", ", ".join(f"{n} string" for n in self.names), "us long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        whole = _keyed(rows, self.names).sort_values("us", kind="stable")
        names = list(zip(*(whole[n] for n in self.names), strict=True))
        until = {k: us + self.lifetime for k, us in _seen(self.kept, set(names)).items()}
        found, at = [], {}
        for k, us in zip(names, whole["us"].tolist(), strict=True):
            if us >= until.get(k, us):
                at[k], until[k] = us, us + self.lifetime
                found.append((*k, us))
        for k, us in at.items():
            self.kept.updateValue(k, (us,))
        if found:
            self.handle.registerTimer((min(at.values()) + self.lifetime) // 1000 + 1)
            out = pd.DataFrame(found, columns=[*self.names, "ts"])
            yield out.assign(ts=out["ts"].to_numpy().astype("datetime64[us]"))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        soonest = _forget(self.kept, self.lifetime, timerValues.getCurrentWatermarkInMs() * 1000)
        if soonest is not None:
            self.handle.registerTimer((soonest + self.lifetime) // 1000 + 1)
        return iter([])

    def close(self) -> None:
        pass


def first_arrivals(spark: SparkSession, slices: Sequence[DataFrame], keys: list[str], lifetime: str = "30 days", late: str = "1 hour", shares: int = 96, progress: list | None = None) -> DataFrame:
    """The rows of a stream that a cache of ``lifetime`` doesn't have: (keys, ts, slice).

    A row is kept if its key has none, or if the last row that was kept is ``lifetime`` old or older; rows within don't prolong it. Rows that are later
    than ``late`` behind the newest of earlier batches are dropped. Keys are dealt into ``shares``; a task holds a batch's times of one share. Keys whose row
    has run out leave the state, so it is no larger than what a lifetime brings.
    """
    kinds = [slices[0].schema[k].dataType.simpleString() for k in keys]
    names = [f"k{i}" for i in range(len(keys))]
    schema = ", ".join(f"{n} string" for n in names) + ", ts timestamp"

    def plan(stream: DataFrame) -> DataFrame:
        grouped = in_shares(stream.select(*(F.col(k).alias(n) for k, n in zip(keys, names, strict=True)), "ts"), names, shares, late)
        return grouped.transformWithStateInPandas(FirstWithin(_us(lifetime), names), schema, "Update", "EventTime")

    with kept_in_files(spark):
        rows = replay(spark, slices, plan, progress=progress)
    return rows.select(*(F.col(n).cast(kind).alias(k) for k, n, kind in zip(keys, names, kinds, strict=True)), "ts", "slice")


def arrivals_by_rounds(rows: DataFrame, keys: list[str], lifetime: str = "30 days") -> DataFrame:
    """``first_arrivals`` of a table: (keys, ts). Each round takes every key's first row that is ``lifetime`` or more after its last; there are
    as many rounds as lifetimes in the table's time, and minima are taken before the shuffle."""
    at = materialise(rows.groupBy(*keys, F.col("ts").cast("timestamp").alias("ts")).agg(F.count("*").alias("n")).drop("n"), "times")
    front = materialise(at.groupBy(*keys).agg(F.min("ts").alias("ts")), "kept")
    kept = front
    while True:
        last = front.select(*(F.col(k).alias(f"_{k}") for k in keys), (F.col("ts") + F.expr(f"interval {lifetime}")).alias("until"))
        same = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]
        front = materialise(at.join(last, reduce(and_, same)).filter(F.col("ts") >= F.col("until")).groupBy(*keys).agg(F.min("ts").alias("ts")), "kept")
        if not front.limit(1).count():
            return kept
        kept = kept.unionByName(front)


def running_cost(log: DataFrame) -> DataFrame:
    return log.groupBy("purpose").agg(F.count("*").alias("calls"), F.sum("cost_cents").alias("cost_cents"))


class NewKeys(StatefulProcessor):
    """Counts keys of topics that were not seen in the ``timeout`` before. The state of a share is a map from topic and key to when it was last seen; timers drop keys that are due to be forgotten."""

    def __init__(self, timeout_us: int):
        self.timeout = timeout_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.seen = handle, handle.getMapState("seen", "topic string, key string", "us long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        ends = _keyed(rows, ["topic", "key"]).groupby(["topic", "key"], dropna=False, sort=False)["us"].agg(["min", "max"]).reset_index()
        topics = ends["topic"].astype(object).where(ends["topic"].notna(), None)
        names = list(zip(topics, ends["key"], strict=True))
        seen, new, last = _seen(self.seen, set(names)), {}, []
        for k, lo, hi in zip(names, ends["min"].tolist(), ends["max"].tolist(), strict=True):
            was = seen.get(k)
            new[k[0]] = new.get(k[0], 0) + (was is None or lo >= was + self.timeout)
            last.append(hi if was is None else max(was, hi))
            if was is None or hi > was:
                self.seen.updateValue(k, (last[-1],))
        self.handle.registerTimer((min(last) + self.timeout) // 1000 + 1)
        yield pd.DataFrame({"topic": pd.Series(list(new), dtype=object), "n_new": list(new.values())})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        soonest = _forget(self.seen, self.timeout, timerValues.getCurrentWatermarkInMs() * 1000)
        if soonest is not None:
            self.handle.registerTimer((soonest + self.timeout) // 1000 + 1)
        return iter([])

    def close(self) -> None:
        pass


def novelty(spark: SparkSession, slices: Sequence[DataFrame], topic: str, key: str, need: int = 3, timeout: str = "30 days", late: str = "1 hour", shares: int = 96, progress: list | None = None) -> DataFrame:
    """Keys of each topic that are new, slice by slice: topic, batch, n_new, n_seen, stopped.

    A key is new in a slice if its first row there is ``timeout`` or more after its last row before, or if it has none. A topic has stopped from the first batch
    after its own first that brought fewer than ``need`` new keys. Null keys don't count. Keys of all topics are dealt into ``shares``, each a map of its own, so a
    hot topic isn't one task and a topic with few keys isn't a call of Python; counts of shares are added up. Keys leave the state when they would count as new again.
    """
    named = [s.select(F.col(topic).alias("topic"), F.col(key).cast("string").alias("key"), F.col("ts").cast("timestamp").alias("ts")).filter("key is not null") for s in slices]
    kind = named[0].schema["topic"].dataType.simpleString()

    def plan(stream: DataFrame) -> DataFrame:
        return in_shares(stream, ["topic", "key"], shares, late).transformWithStateInPandas(NewKeys(_us(timeout)), "topic string, n_new long", "Update", "EventTime")

    with kept_in_files(spark):
        counts = replay(spark, named, plan, fold=lambda batch, *_: batch.groupBy(F.col("topic").cast(kind).alias("topic")).agg(F.sum("n_new").alias("n_new")), progress=progress)
    counts = counts.withColumnRenamed("slice", "batch")
    so_far = Window.partitionBy("topic").orderBy("batch").rowsBetween(Window.unboundedPreceding, 0)
    few = (F.row_number().over(Window.partitionBy("topic").orderBy("batch")) > 1) & (F.col("n_new") < need)
    folded = counts.withColumn("few", few)
    return folded.select("topic", "batch", "n_new", F.sum("n_new").over(so_far).alias("n_seen"), F.bool_or("few").over(so_far).alias("stopped"))


def breaker(spark: SparkSession, slices: Sequence[DataFrame], need: int = 5, cool_down: str = "60 seconds") -> DataFrame:
    """A row each time ``need`` failures in a row open a producer's breaker: user_id, opened_at, open_until, slice. A success resets the count.

    A batch's rows are dealt by ranges of (producer, ts, event_id) and folded (``operators.runs``), so a producer's rows are never in one task. What is carried from batch to batch is a
    row for each producer with a streak, written under the batch's number; a batch that is tried again reads that of the batch before it.
    """

    def fold(batch: DataFrame, number: int, root: str) -> DataFrame:
        began = spark.read.parquet(f"{root}/streaks/n={number - 1}") if number else spark.createDataFrame([], "user_id long, streak long")
        placed = materialise(run_places(in_ranges(batch, "user_id", ["ts", "event_id"]), "user_id", ["ts", "event_id"], began=began), "placed")
        ended = placed.groupBy("user_id").agg(F.max_by("place", F.struct("ts", "event_id")).alias("now"))
        both = began.withColumnRenamed("user_id", "u").join(ended, F.col("u").eqNullSafe(F.col("user_id")), "full")
        both.select(F.coalesce("user_id", "u").alias("user_id"), F.coalesce("now", "streak").alias("streak")).filter("streak > 0").write.mode("overwrite").parquet(f"{root}/streaks/n={number}")
        return placed.filter(F.col("place") == need).select("user_id", F.col("ts").alias("opened_at"), (F.col("ts") + F.expr(f"interval {cool_down}")).alias("open_until"))

    return replay(spark, [s.select("user_id", "event_id", "ts", "failed") for s in slices], lambda stream: stream, "append", fold)
