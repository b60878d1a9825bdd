"""Fitting the weights of a ranking to graded pools."""

from __future__ import annotations

import random

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.operators.index import batches_of
from quarry.storage import materialise

#: Graded candidates of a pool up to which places are counted for these alone; where more have a grade, the pool is sorted.
COUNTED = 16


def pack(pools: DataFrame, names: list[str], folds: int) -> DataFrame:
    """One row for each topic: its fold, and its candidates' signals and grades in order of arrival. A pool is what a cut left, so a row is small."""
    one = F.struct("arrival", F.transform(F.array(*names), lambda x: F.coalesce(x.cast("double"), F.lit(0.0))).alias("x"), "grade")
    rows = pools.groupBy("topic_id").agg(F.sort_array(F.collect_list(one)).alias("p"))
    return rows.select(F.pmod(F.xxhash64("topic_id"), F.lit(folds)).cast("int").alias("fold"), F.flatten("p.x").alias("x"), F.col("p.grade").alias("grade"))


def spread(packed: DataFrame) -> DataFrame:
    """``packed`` written in a file for each core, as every step of a search scans it: a few topics are small, and in one file they are one task."""
    return materialise(packed.repartition(max(1, packed.sparkSession.sparkContext.defaultParallelism)), "pools")


def discounted(score: np.ndarray, gain: np.ndarray, depth: int) -> np.ndarray:
    """Discounted gain of the first ``depth`` candidates for each row of ``score``, equal scores in order of arrival; a score that is no number comes last."""
    discount = 1 / np.log2(np.arange(depth) + 2)
    graded = np.flatnonzero(gain)
    score = np.where(np.isnan(score), -np.inf, score)
    if len(graded) > COUNTED:
        first = np.argsort(-score, axis=1, kind="stable")[:, :depth]
        return gain[first] @ discount[: first.shape[1]]
    total, discount = np.zeros(len(score)), np.append(discount, 0.0)
    for g in graded:
        own = score[:, g : g + 1]
        place = np.count_nonzero(score > own, axis=1) + np.count_nonzero(score[:, :g] == own, axis=1)
        total += gain[g] * discount[np.minimum(place, depth)]
    return total


def objective(packed: DataFrame, vectors: np.ndarray, folds: int, depth: int = 10) -> tuple[np.ndarray, np.ndarray]:
    """Sums of nDCG at ``depth`` for each fold and weight vector, and topics of each fold. A topic without a grade counts as 0."""
    width = vectors.shape[1]
    vectors, asked = np.unique(vectors, axis=0, return_inverse=True)  # runs that have met ask for the same ones

    def part(batches):
        sums, topics = np.zeros((folds, len(vectors))), np.zeros(folds, dtype=np.int64)
        discount = 1 / np.log2(np.arange(depth) + 2)
        for pdf in batches:
            for fold, x, grade in zip(pdf["fold"], pdf["x"], pdf["grade"], strict=True):
                gain = 2.0 ** np.asarray(grade) - 1
                ideal = (np.sort(gain)[::-1][:depth] * discount[: len(gain)]).sum()
                topics[fold] += 1
                if ideal > 0:
                    score = np.round(vectors @ np.asarray(x).reshape(-1, width).T, 9)
                    sums[fold] += discounted(score, gain, depth) / ideal
        for fold in np.flatnonzero(topics):
            yield pd.DataFrame({"fold": fold, "vector": np.arange(len(vectors)), "total": sums[fold], "topics": topics[fold]})

    found = packed.mapInPandas(part, "fold int, vector int, total double, topics long").groupBy("fold", "vector").agg(F.sum("total").alias("total"), F.sum("topics").alias("topics"))
    sums, topics = np.zeros((folds, len(vectors))), np.zeros(folds)
    for r in found.collect():
        sums[r.fold, r.vector], topics[r.fold] = r.total, r.topics
    return sums[:, asked.ravel()], topics


def _mean(sums: np.ndarray, topics: np.ndarray, held: int | None) -> np.ndarray:
    """Mean over the topics of all folds but ``held``."""
    use = np.arange(len(topics)) != (-1 if held is None else held)
    return np.round(sums[use].sum(axis=0) / max(1, topics[use].sum()), 9)


def calibrate(
    pools: DataFrame, start: dict[str, float], bounds: dict[str, tuple[float, float]], step: float = 0.02, passes: int = 4, starts: int = 6, folds: int = 5, seed: int = 7,
) -> tuple[dict[str, float], dict[str, float]]:
    """The weights found, and the means of nDCG at 10: ``base`` of ``start``, ``train`` of the weights found, ``held`` of folds left out.

    Coordinate ascent from ``start`` and from random points: a weight is moved along its whole grid and changed only by a strict
    gain; passes end when none gains. This is done on all topics and, for ``held``, without each fold in turn, whose own topics then judge
    what was found. All these runs advance together: each step is one scan of the packed pools that scores all their grids, and what
    the driver receives is one sum for each fold and weight vector, however many topics there are. Without topics ``start`` is returned
    with means of 0. ``pools``: topic_id, arrival, grade and the signals named by ``start``.
    """
    names, draw = list(start), random.Random(seed)
    batches_of(pools.sparkSession)
    packed = spread(pack(pools, names, folds))
    origins = [np.array([start[n] for n in names])] + [np.array([round(draw.uniform(*bounds[n]), 3) for n in names]) for _ in range(starts - 1)]
    runs = [{"held": held, "w": w.copy(), "best": -1.0, "live": True} for held in (None, *range(folds)) for w in origins]
    for _ in range(passes):
        for run in runs:
            run["order"], run["gained"] = draw.sample(range(len(names)), len(names)), False
        for k in range(len(names)):
            live = [run for run in runs if run["live"]]
            grids = []
            for run in live:
                low, high = bounds[names[run["order"][k]]]
                values = np.round(low + step * np.arange(round((high - low) / step) + 1), 4)
                grid = np.tile(run["w"], (len(values) + 1, 1))
                grid[1:, run["order"][k]] = values
                grids.append(grid)
            if not live:
                break
            sums, topics = objective(packed, np.vstack(grids), folds)
            ends = np.cumsum([len(g) for g in grids])
            for run, grid, end in zip(live, grids, ends, strict=True):
                means = _mean(sums[:, end - len(grid) : end], topics, run["held"])
                run["best"] = max(run["best"], means[0])
                if means.max() > run["best"]:
                    run["w"], run["best"], run["gained"] = grid[means.argmax()], means.max(), True
        for run in runs:
            run["live"] = run["live"] and run["gained"]
    chosen = [max((run for run in runs if run["held"] == held), key=lambda run: run["best"])["w"] for held in (None, *range(folds))]
    sums, topics = objective(packed, np.vstack([origins[0], *chosen]), folds)
    every = _mean(sums, topics, None)
    held = [sums[f, f + 2] / topics[f] for f in range(folds) if topics[f]]
    return dict(zip(names, map(float, chosen[0]), strict=True)), {"base": float(every[0]), "train": float(every[1]), "held": float(np.round(np.mean(held), 9)) if held else 0.0}
