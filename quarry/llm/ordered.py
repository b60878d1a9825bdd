"""Places of rows within groups of any size, from one sort over all rows."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quarry.llm.worker import bounded_batches, tidy
from quarry.storage import materialise


def in_order(rows: DataFrame, group: str, order: Sequence[str], xors: Sequence[str] = ()) -> DataFrame:
    """``rows`` with their ``position`` (long, from 0) in the ``order`` of their group, nulls first, and with each column of ``xors``
    replaced by the exclusive-or of it over the rows of the group up to this one.

    All rows are dealt by ranges of (group, order), so that a group of any size is spread over partitions unless its rows are equal in
    ``order``; every partition counts from its own first row on, and only the group that
    runs on from the partition before needs what that one had: at most one small row for each partition, which is broadcast.
    ``group`` and ``xors`` are longs without nulls, and no column is called position or part. ``rows`` is read twice, once for the ranges, and should be a written table.
    """
    bounded_batches(rows.sparkSession)
    names = rows.columns
    places = [names.index(x) for x in xors]

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, last, count, carried = TaskContext.get().partitionId(), None, 0, [np.int64(0)] * len(places)
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            g = batch.column(names.index(group)).to_numpy()
            first = np.flatnonzero(np.concatenate([[True], g[1:] != g[:-1]]))
            run = np.repeat(np.arange(len(first)), np.diff(np.append(first, n)))
            on = g[0] == last
            position = np.arange(n) - first[run] + np.where(run == 0, count if on else 0, 0)
            columns = list(batch.columns)
            for k, c in enumerate(places):
                total = np.bitwise_xor.accumulate(batch.column(c).to_numpy())
                before = np.concatenate([[carried[k] if on else np.int64(0)], total[first[1:] - 1]])
                total = total ^ before[run]
                columns[c], carried[k] = pa.array(total), total[-1]
            last, count = g[-1], position[-1] + 1
            yield pa.RecordBatch.from_arrays([*columns, pa.array(position), pa.array(np.full(n, part, np.int32))], [*names, "position", "part"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema) + ", position long, part int"
    dealt = rows.repartitionByRange(group, *order).sortWithinPartitions(group, *order)
    local = materialise(dealt.mapInArrow(tidy(number), schema), "ordered")
    last = F.max_by(F.struct("position", *xors), "position")
    ends = local.groupBy(F.col(group).alias("_g"), F.col("part").alias("_p")).agg(last.alias("end"))
    before = Window.partitionBy("_g").orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    carry = ends.select(
        "_g", "_p", F.sum(F.col("end.position") + 1).over(before).alias("_rows"), *(F.expr("bit_xor(end.`%s`)" % x).over(before).alias(f"_before{k}") for k, x in enumerate(xors))
    ).filter("_rows is not null")
    out = local.join(F.broadcast(carry), (F.col("part") == F.col("_p")) & (F.col(group) == F.col("_g")), "left")
    place = (F.col("position") + F.coalesce("_rows", F.lit(0))).alias("position")
    found = {x: F.col(x).bitwiseXOR(F.coalesce(F.col(f"_before{k}"), F.lit(0))).alias(x) for k, x in enumerate(xors)}
    return out.select(*(found.get(c, F.col(f"`{c}`")) for c in names), place)
