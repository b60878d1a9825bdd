"""Claims, verdicts and what follows from them."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The bars of the two kinds of judge; an unknown judge counts as typed.
BARS = {"typed": {"contradict": 0.85, "unsupported": 0.95, "support": 0.50, "summary": 0.60}, "prompted": {"contradict": 0.90, "unsupported": 0.95, "support": 0.90, "summary": 0.90}}


def bar(backend: Column, name: str) -> Column:
    return F.when(backend == "prompted", BARS["prompted"][name]).otherwise(BARS["typed"][name])


def mass(relation: str) -> Column:
    """Probability of a relation, where the map holds the stated one; else the confidence if it is the stated one, else 0."""
    stated = F.col("probabilities").isNotNull() & F.map_contains_key("probabilities", F.col("relation"))
    scalar = F.when(F.col("relation") == relation, F.coalesce("confidence", F.lit(0.0))).otherwise(0.0)
    return F.when(stated, F.coalesce(F.try_element_at("probabilities", F.lit(relation)), F.lit(0.0))).otherwise(scalar)


def fold_verdicts(verdicts: DataFrame, keys: list[str]) -> DataFrame:
    """One row for each claim: flag, strength_cap and the citations it keeps, in source order. Never drops a claim.

    First match wins: no real verdict, nothing changes; all say nothing, flag ``unaddressed`` and weak; any
    contradicts, flag ``contradicted`` and weak; some support, citations shrink to the supporting and the unverified;
    none supports, weak. ``verdicts``: keys, source_index, relation, confidence, probabilities, backend.
    """
    over = lambda relation, name: mass(relation) >= bar(F.col("backend"), name)
    real = F.col("relation") != "error"
    facts = verdicts.withColumn("real", real).withColumn("nothing", over("says_nothing", "unsupported")).withColumn("against", over("contradicts", "contradict")).withColumn("for", over("supports", "support"))
    folded = facts.groupBy(*keys).agg(
        F.count_if("real").alias("n_real"), F.coalesce(F.bool_and(F.when(F.col("real"), F.col("nothing"))), F.lit(False)).alias("all_nothing"), F.coalesce(F.bool_or(F.when(F.col("real"), F.col("against"))), F.lit(False)).alias("any_against"),
        F.coalesce(F.bool_or(F.when(F.col("real"), F.col("for"))), F.lit(False)).alias("any_for"), F.sort_array(F.collect_set("source_index")).alias("cited"),
        F.sort_array(F.collect_set(F.when(~F.col("real") | F.col("for"), F.col("source_index")))).alias("kept"),
    )
    rule = F.when(F.col("n_real") == 0, 1).when(F.col("all_nothing"), 2).when(F.col("any_against"), 3).when(F.col("any_for"), 4).otherwise(5)
    return folded.withColumn("rule", rule).select(
        *keys, F.when(F.col("rule") == 2, "unaddressed").when(F.col("rule") == 3, "contradicted").otherwise("").alias("flag"), F.col("rule").isin(2, 3, 5).alias("weak"), F.when(F.col("rule") == 4, F.col("kept")).otherwise(F.col("cited")).alias("citations")
    )


def judge_in_batches(rows: DataFrame, judge: Callable[[list], list], size: int = 15, input_col: str = "input", id_col: str = "id") -> DataFrame:
    """A user's ``judge`` over chunks of at most ``size`` inputs: id, score in [0, 1], error. A chunk that fails loses only its own rows.

    A chunk holds ids of one range of ``size`` numbers, in order, so which rows fail together doesn't depend on how rows lie in partitions; rows without an id
    are dealt by their input. Chunks are dealt by ranges of their numbers, and one task goes through many, one at a time.
    """

    def chunk(part: pd.DataFrame) -> pd.DataFrame:
        try:
            scores = [None if s is None else min(1.0, max(0.0, float(s))) for s in judge(part[input_col].tolist())]
            if len(scores) != len(part):
                raise ValueError(f"{len(scores)} scores for {len(part)} rows")
            return pd.DataFrame({"id": part[id_col], "score": pd.Series(scores, part.index, dtype="float64"), "error": pd.Series([None] * len(part), part.index, dtype=object)})
        except Exception as e:  # noqa: BLE001  the chunk's failure is its result
            return pd.DataFrame({"id": part[id_col], "score": pd.Series([None] * len(part), part.index, dtype="float64"), "error": str(e)[:200]})

    def pieces(pdf: pd.DataFrame) -> Iterator[pd.DataFrame]:
        for _, part in pdf.groupby("_chunk", sort=False):
            for a in range(0, len(part), size):  # more than one only where ids are repeated
                yield chunk(part.iloc[a : a + size])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest = None
        for pdf in frames:
            pdf = pdf if rest is None else pd.concat([rest, pdf], ignore_index=True)
            # the last chunk may go on in the next frame; whole pieces of it needn't wait
            keep = int((pdf["_chunk"] == pdf["_chunk"].iloc[-1]).sum()) % size if len(pdf) else 0
            rest = pdf.iloc[len(pdf) - keep :]
            yield from pieces(pdf.iloc[: len(pdf) - keep])
        if rest is not None and len(rest):
            yield from pieces(rest)

    number = F.coalesce(F.floor(F.col(id_col) / size), F.lit(-(2**62)) + F.pmod(F.xxhash64(input_col), F.lit(1 << 20)))
    dealt = rows.select(id_col, input_col, number.alias("_chunk")).repartitionByRange("_chunk").sortWithinPartitions("_chunk", id_col, input_col)
    return dealt.mapInPandas(run, "id long, score double, error string")
