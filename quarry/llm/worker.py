"""What a Python worker keeps between batches and tasks, and how large its batches are."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import SparkSession

#: Bytes of an Arrow batch. A batch of very long texts holds at least one row, so it may be larger.
BATCH_BYTES = 4 << 20
_STATE: dict = {}


def bounded_batches(spark: SparkSession) -> None:
    """Bound the session's Arrow batches by bytes (Spark's own default is 64 MB), unless they are smaller already.

    Spark reads this setting when a plan runs, so it has to stay set until the caller has run its plan.
    """
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    given = spark.conf.get(name).rstrip("bB")
    if not given.isdigit() or not 0 < int(given) <= BATCH_BYTES:
        spark.conf.set(name, str(BATCH_BYTES))


def state(key: str | None, build: Callable[[], object]) -> object:
    """What ``build`` made for ``key`` in this worker. One value is kept: a worker that goes on to another operator lets
    the tables and caches of the last one go."""
    if _STATE.get("key") != key:
        _STATE.clear()
        _STATE.update(key=key, value=build())
    return _STATE["value"]


def give_back() -> None:
    """Return freed memory to the system. Arrow and malloc keep it otherwise, and idle workers of earlier stages add up."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def tidy(f: Callable[[Iterator], Iterator], key: str | None = None) -> Callable[[Iterator], Iterator]:
    """``f`` for mapInArrow: state of another key goes before it starts, and freed memory goes back when it ends."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if _STATE.get("key") != key:
            _STATE.clear()
        try:
            yield from f(batches)
        finally:
            give_back()

    return run
