"""Cutting, capping and diversifying ranked pools. Every ordering ends in ``arrival``."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quarry.functions.text import extract_doi, paper_id, url_key
from quarry.operators.retrieve import top_per_group


def relevance_floor(rows: DataFrame, floor: float = 0.45, group: str = "topic_id", value: str = "relevance") -> DataFrame:
    """Rows at or above the floor; a group with none keeps its single best, the earliest on a tie."""
    best = rows.groupBy(F.col(group).alias("_g")).agg(F.max(F.struct(value, -F.col("arrival"))).alias("_best"))
    survives = (F.col(value) >= floor) | ((F.col(f"_best.{value}") < floor) & (F.col("arrival") == -F.col("_best.col2")))
    return rows.join(best, F.col(group) == F.col("_g")).filter(survives).drop("_g", "_best")


def pool_cut(rows: DataFrame, authority: int = 180, cosine: int = 60) -> DataFrame:
    """First the ``authority`` rows of largest citation + tier + evidence of each topic, then the ``cosine`` most similar."""
    first = top_per_group(rows, ["topic_id"], [F.desc("authority"), "arrival"], authority, "authority_rank")
    return top_per_group(first, ["topic_id"], [F.desc("cosine"), "arrival"], cosine, "cosine_rank")


def source_cap(rows: DataFrame, capped: str, limit: int, order: list) -> DataFrame:
    """A ranked list where only the first row of source ``capped`` stays in place and others go to the end, cut to ``limit``."""
    nth = F.row_number().over(Window.partitionBy("topic_id", "source_type").orderBy(*order))
    deferred = rows.withColumn("deferred", (F.col("source_type") == capped) & (nth > 1))
    return top_per_group(deferred, ["topic_id"], ["deferred", *order], limit, "place")


def mmr(rows: DataFrame, weight: float = 0.72, limit: int = 66) -> DataFrame:
    """Greedy diversification of each topic's shortlist: the best score first, then weight * score - (1 - weight) * the
    largest similarity to what was picked, never below 0. A row without a vector keeps its score. Ties go to the
    earlier row. The shortlist is cut to ``limit`` natively, so a group that Python sees is small.

    Columns: topic_id, ev_id, place.
    """
    short = top_per_group(rows, ["topic_id"], [F.desc("score"), "arrival"], limit, "_r").select("topic_id", "ev_id", "score", "arrival", "embedding")

    def pick(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["score", "arrival"], ascending=[False, True], kind="stable").reset_index(drop=True)
        has = np.array([v is not None and len(v) > 0 for v in pdf.embedding])
        size = max((len(v) for v in pdf.embedding[has]), default=1)
        unit = np.zeros((len(pdf), size))
        for k in np.flatnonzero(has):
            v = np.asarray(pdf.embedding[k], np.float64)
            if len(v) == size and v.any():
                unit[k] = v / np.sqrt((v * v).sum())
        score, left, order, near = pdf.score.to_numpy(), np.ones(len(pdf), bool), [], np.zeros(len(pdf))
        arrival = pdf.arrival.to_numpy()
        while left.any():
            value = np.where(has & bool(order), weight * score - (1 - weight) * near, score)
            rest = np.flatnonzero(left)
            k = rest[np.lexsort((arrival[rest], -value[rest]))[0]]
            order.append(k)
            left[k] = False
            near = np.maximum(near, np.maximum(0, unit @ unit[k]))
        return pd.DataFrame({"topic_id": pdf.topic_id.iloc[order].to_numpy(), "ev_id": pdf.ev_id.iloc[order].to_numpy(), "place": np.arange(1, len(order) + 1, dtype=np.int32)})

    return short.groupBy("topic_id").applyInPandas(pick, "topic_id long, ev_id long, place int")


def tier_gate(hits: DataFrame, need: int = 3) -> DataFrame:
    """Rows of a retry tier count only while the tiers before it gave fewer than ``need`` usable hits.

    ``hits``: topic_id, tier_no, usable boolean. Tiers are pre-aggregated; the window sees one row for each tier.
    """
    sums = hits.groupBy("topic_id", "tier_no").agg(F.count_if("usable").alias("n"))
    before = Window.partitionBy("topic_id").orderBy("tier_no").rowsBetween(Window.unboundedPreceding, -1)
    reached = sums.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0))).filter(F.col("before") < need)
    return hits.join(reached.select("topic_id", "tier_no"), ["topic_id", "tier_no"], "left_semi")


def round_saturation(rows: DataFrame, bar: float = 0.30, need: int = 3) -> DataFrame:
    """topic_id, round, n_new, kept: new relevant keys of each round, and whether the search came that far.

    Round 1 only fills what has been seen; the search stops after the first later round with fewer than ``need``
    new keys of cosine ``bar`` or more. ``rows``: topic_id, round, key, cosine.
    """
    first = rows.groupBy("topic_id", "key").agg(F.min("round").alias("round"), F.max(F.col("cosine") >= bar).alias("relevant"))
    new = first.filter("relevant").groupBy("topic_id", "round").agg(F.count("*").alias("n_new"))
    every = rows.select("topic_id", "round").distinct().join(new, ["topic_id", "round"], "left").withColumn("n_new", F.coalesce("n_new", F.lit(0)))
    before = Window.partitionBy("topic_id").orderBy("round").rowsBetween(Window.unboundedPreceding, -1)
    stopped = F.coalesce(F.max((F.col("round") > 1) & (F.col("n_new") < need)).over(before), F.lit(False))
    return every.withColumn("kept", ~stopped)


def slot_merge(rows: DataFrame, size: int, review: str = "review") -> DataFrame:
    """Priority list, then relevance list, then citation list, first wins; a third of the slots is kept for citations on review queries.

    ``rows``: topic_id, list_no 1 to 3, rank, key, and a boolean column ``review``. Columns out: topic_id, key, place.
    """
    topic = Window.partitionBy("topic_id")
    base = rows.filter("list_no < 3").groupBy("topic_id", "key").agg(F.min(F.struct("list_no", "rank")).alias("at"), F.max(review).alias("review"))
    base = base.withColumn("n", F.row_number().over(topic.orderBy("at"))).filter(F.col("n") <= size).withColumn("m", F.count("*").over(topic))
    reserved = F.when(F.col("review"), F.greatest(F.lit(1), F.floor(F.lit(size) / 3))).otherwise(0)
    trim = F.greatest(F.lit(0), reserved - (size - F.col("m")))
    merged = base.filter(F.col("n") <= F.col("m") - trim).select("topic_id", "key", F.struct(F.lit(0).alias("l"), F.col("n").cast("int").alias("r")).alias("order"))
    cited = rows.filter("list_no = 3").groupBy("topic_id", "key").agg(F.min("rank").alias("r")).join(merged.select("topic_id", "key"), ["topic_id", "key"], "left_anti")
    both = merged.unionByName(cited.select("topic_id", "key", F.struct(F.lit(1).alias("l"), F.col("r").cast("int").alias("r")).alias("order")))
    return top_per_group(both, ["topic_id"], ["order", "key"], size, "place").select("topic_id", "key", "place")


def citation_expand(edges: DataFrame, seeds: DataFrame, per_seed: int = 6) -> DataFrame:
    """Neighbours of seeds that aren't seeds, at most ``per_seed`` of each seed and kind, smallest first.

    ``edges``: src, dst, kind. ``seeds``: id. Columns: src, kind, dst, n.
    """
    met = edges.join(seeds.select(F.col("id").alias("src")), "src", "left_semi").filter("src <> dst").distinct()
    kept = top_per_group(met, ["src", "kind"], ["dst"], per_seed, "n")
    return kept.join(seeds.select(F.col("id").alias("dst")), "dst", "left_anti").select("src", "kind", "dst", "n")


#: Providers whose records are papers.
PAPER_PROVIDERS = ("pubmed", "europe_pmc", "biorxiv")


def choose_seeds(pool: DataFrame, size: int = 4, floor: float = 0.30) -> DataFrame:
    """The records of each topic from which citations are followed, with their ``seed_rank``.

    The ``size`` nearest of those with cosine ``floor`` or more; where none has that, the ``size`` nearest. Ties go to
    the earlier arrival. ``pool``: topic_id, cosine, arrival and what else is to be kept.
    """
    near = top_per_group(pool, ["topic_id"], [F.desc("cosine"), "arrival"], size, "seed_rank")
    best = F.max("cosine").over(Window.partitionBy("topic_id"))
    return near.withColumn("_best", best).filter((F.col("cosine") >= floor) | (F.col("_best") < floor)).drop("_best")


def seedable(url: Column, provider: Column) -> Column:
    """Whether a record is a paper that a citation graph can know."""
    return provider.isin(*PAPER_PROVIDERS) & paper_id(url).isNotNull()


def expand_seeds(seeds: DataFrame, edges: DataFrame, records: DataFrame, per_seed: int = 6) -> DataFrame:
    """What a topic gains by following its seeds' citations: topic_id, seed, kind, ev_id, place.

    Only seedable seeds are followed, at most ``per_seed`` records of each seed and kind, in order of id; ``related`` works come from
    the topic's first seed with a DOI alone. A url that any seed of the topic has, followed or not, or that an earlier find has, isn't
    taken again. ``seeds``: as ``choose_seeds`` gives them, with ev_id, url, source_type; ``edges``: src, dst, kind_no, kind;
    ``records``: ev_id, url. Edges are shuffled by their ends, and cut in each partition before they are ranked.
    """
    followed = seeds.filter(seedable(F.col("url"), F.col("source_type"))).select("topic_id", F.col("ev_id").alias("src"), "seed_rank", extract_doi(F.col("url")).isNotNull().alias("has_doi"))
    first = F.min(F.when(F.col("has_doi"), F.col("seed_rank"))).over(Window.partitionBy("topic_id"))
    followed = followed.withColumn("leads", F.coalesce(F.col("seed_rank") == first, F.lit(False))).drop("has_doi")
    known = records.select(F.col("ev_id").alias("dst"), url_key(F.col("url")).alias("key")).filter("key <> ''")
    met = edges.join(followed, "src").filter((F.col("kind") != "related") | F.col("leads")).join(known, "dst")
    near = top_per_group(met, ["topic_id", "src", "kind"], ["dst"], per_seed, "n")
    new = near.join(seeds.select("topic_id", url_key(F.col("url")).alias("key")), ["topic_id", "key"], "left_anti")
    once = top_per_group(new, ["topic_id", "key"], ["seed_rank", "kind_no", "n"], 1, "_first")
    order = Window.partitionBy("topic_id").orderBy("seed_rank", "kind_no", "n")
    return once.select("topic_id", F.col("src").alias("seed"), "kind", F.col("dst").alias("ev_id"), F.row_number().over(order).alias("place"))
