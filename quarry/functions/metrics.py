"""Ranked metrics as aggregates: a native fold over a sorted array, and a grouped function that SQL can call by name."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F


def dcg(grades: Column, k: int = 10) -> Column:
    """Discounted gain of an array of grades in rank order: (2 ** grade - 1) / log2(place + 1) over the first ``k``."""
    first = F.slice(grades, 1, k)
    return F.aggregate(F.transform(first, lambda g, i: (F.pow(F.lit(2.0), F.coalesce(g, F.lit(0))) - 1) / F.log2(i + 2.0)), F.lit(0.0), lambda total, x: total + x)


def ndcg(grades: Column, k: int = 10, ideal: Column | None = None) -> Column:
    """``dcg`` over that of the best order of ``ideal`` (the same grades if not given); 0 where nothing is relevant."""
    best = dcg(F.sort_array(grades if ideal is None else ideal, asc=False), k)
    return F.coalesce(F.try_divide(dcg(grades, k), best), F.lit(0.0))


def in_order(place: Column, grade: Column) -> Column:
    """An aggregate: the grades of a group by ``place``. A group is a cut pool, so the array is short."""
    return F.transform(F.array_sort(F.collect_list(F.struct(place.alias("place"), grade.alias("grade")))), lambda x: x["grade"])


def ndcg_of_group(k: int = 10):
    """``ndcg`` as a grouped-aggregate function of (place, grade), on Arrow columns."""

    @F.pandas_udf("double")
    def grouped(place: pd.Series, grade: pd.Series) -> float:
        gain = np.exp2(grade.fillna(0).to_numpy(np.float64)) - 1
        ordered, best = gain[np.argsort(place.to_numpy(), kind="stable")][:k], np.sort(gain)[::-1][:k]
        weight = 1 / np.log2(np.arange(2, k + 2))
        ideal = float((best * weight[: len(best)]).sum())
        return float((ordered * weight[: len(ordered)]).sum()) / ideal if ideal else 0.0

    return grouped


def register_metrics(spark: SparkSession, k: int = 10) -> str:
    """Make the grouped function callable from SQL; gives its name."""
    name = f"ndcg_at_{k}"
    spark.udf.register(name, ndcg_of_group(k))
    return name
