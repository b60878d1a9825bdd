"""Queries of pool evaluation, weight calibration and multi-round discovery."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.functions import metrics
from quarry.functions.signals import PRIOR_WEIGHTS, weighted, weighted_sql
from quarry.functions.text import paper_id, tokenize
from quarry.operators import retrieve
from quarry.operators.calibrate import calibrate as fit
from quarry.operators.index import build_index, extend_index, search_index, term_weights
from quarry.operators.rank import round_saturation
from quarry.plans.ranking import curves
from quarry.plans.retrieval import BM25_SQL, CUT, METRICS_SQL, QRELS_SQL, TEXT_SQL, bm25_sql, qrels, ranked_documents, topics
from quarry.plans.pool import SIGNALS, signals, window_text
from quarry.plans.registry import query
from quarry.sources.tables import evidence, table
from quarry.storage import materialise


@query("pool_relevance", f"""WITH {SIGNALS} SELECT source_type, count(*) AS items, count(*) FILTER (relevance >= 0.6) AS relevant, round(count(*) FILTER (relevance >= 0.6) / count(*), 6) AS share, round(CASE WHEN min(cosine) = max(cosine) THEN NULL ELSE corr(cosine, relevance) END, 6) AS r FROM signals GROUP BY source_type""")
def pool_relevance(spark, sf):
    hit = F.count_if(F.col("relevance") >= 0.6)
    r = F.when(F.min("cosine") == F.max("cosine"), None).otherwise(F.corr("cosine", "relevance"))
    return signals(spark, sf).groupBy("source_type").agg(F.count("*").alias("items"), hit.alias("relevant"), F.round(hit / F.count("*"), 6).alias("share"), F.round(r, 6).alias("r"))


@query("pool_correlation", f"""WITH {SIGNALS}, p AS (SELECT topic_id, count(*) AS size, count(*) FILTER (relevance >= 0.6) / count(*) AS rate FROM signals WHERE cosine >= 0.25 GROUP BY topic_id)
    SELECT count(*) AS n_topics, round(CASE WHEN count(*) < 2 OR min(size) = max(size) OR min(rate) = max(rate) THEN NULL ELSE corr(size, rate) END, 6) AS r FROM p""")
def pool_correlation(spark, sf):
    """Over topics, the correlation of how large a pool is with the share of it that is relevant; null where either is constant."""
    pools = signals(spark, sf).filter("cosine >= 0.25").groupBy("topic_id").agg(F.count("*").alias("size"), (F.count_if(F.col("relevance") >= 0.6) / F.count("*")).alias("rate"))
    flat = (F.count("*") < 2) | (F.min("size") == F.max("size")) | (F.min("rate") == F.max("rate"))
    return pools.agg(F.count("*").alias("n_topics"), F.round(F.when(~flat, F.corr("size", "rate")), 6).alias("r"))


#: Steps of one weight that a pass of the calibration looks at.
STEPS = (0.0, 0.1, 0.2, 0.3, 0.4)
SIGNAL_NAMES = ("rerank", "cosine", "bm25", "rrf", "concept", "evidence", "offtopic")


def _base():
    return {n: PRIOR_WEIGHTS[n] for n in SIGNAL_NAMES}


def ndcg_of_grid(rows, grid: list[dict[str, float]]):
    """Mean nDCG at 10 over all topics for every weight vector: one scan scores them all, a topic ranks its own pool for each."""
    vectors = F.array(*(F.struct(F.lit(k).alias("grid"), weighted(w).alias("score")) for k, w in enumerate(grid)))
    scored = rows.select("topic_id", "arrival", "grade", F.explode(vectors).alias("x")).select("topic_id", "arrival", "grade", F.col("x.grid").alias("grid"), F.round("x.score", 9).alias("score"))
    top = retrieve.top_per_group(scored, ["grid", "topic_id"], [F.desc("score"), "arrival"], 10)
    dcg = top.groupBy("grid", "topic_id").agg(F.sum((F.pow(F.lit(2.0), "grade") - 1) / F.log2(F.col("rank") + 1.0)).alias("dcg"))
    best = retrieve.top_per_group(rows.select("topic_id", "arrival", "grade"), ["topic_id"], [F.desc("grade"), "arrival"], 10)
    ideal = best.groupBy("topic_id").agg(F.sum((F.pow(F.lit(2.0), "grade") - 1) / F.log2(F.col("rank") + 1.0)).alias("ideal")).filter("ideal > 0")
    return dcg.join(ideal, "topic_id").groupBy("grid").agg(F.round(F.avg(F.col("dcg") / F.col("ideal")), 6).alias("ndcg"), F.count("*").alias("n_topics"))


def graded(spark, sf):
    """The pools' signals with the grade that the gold has for each candidate; 0 where it has none."""
    gold = materialise(qrels(spark, sf).withColumnRenamed("id", "ev_id"), "qrels")
    return signals(spark, sf).join(gold, ["topic_id", "ev_id"], "left").withColumn("grade", F.coalesce("grade", F.lit(0)))


def _grid_sql() -> str:
    parts = [f"SELECT {k} AS grid, topic_id, arrival, grade, round({weighted_sql(_base() | {'cosine': step})}, 9) AS score FROM graded" for k, step in enumerate(STEPS)]
    return f"""WITH {SIGNALS}, gold AS (WITH {QRELS_SQL} SELECT * FROM qrels), graded AS (SELECT s.*, coalesce(q.grade, 0) AS grade FROM signals s LEFT JOIN gold q ON q.topic_id = s.topic_id AND q.id = s.ev_id), s AS ({' UNION ALL '.join(parts)}),
    r AS (SELECT *, row_number() OVER (PARTITION BY grid, topic_id ORDER BY score DESC, arrival) AS rank FROM s), d AS (SELECT grid, topic_id, sum((pow(2, grade) - 1) / log2(rank + 1)) AS dcg FROM r WHERE rank <= 10 GROUP BY ALL),
    i AS (SELECT topic_id, sum((pow(2, grade) - 1) / log2(rank + 1)) AS ideal FROM (SELECT *, row_number() OVER (PARTITION BY topic_id ORDER BY grade DESC, arrival) AS rank FROM graded) WHERE rank <= 10 GROUP BY topic_id)
    SELECT grid, round(avg(dcg / ideal), 6) AS ndcg, count(*) AS n_topics FROM d JOIN i USING (topic_id) WHERE ideal > 0 GROUP BY grid"""


@query("grid_objective", _grid_sql())
def grid_objective(spark, sf):
    return ndcg_of_grid(graded(spark, sf), [_base() | {"cosine": step} for step in STEPS])


#: What each weight may be. A sense that isn't meant only takes away.
BOUNDS = {n: (-0.6, 0.0) if n == "offtopic" else (0.0, 0.5) for n in PRIOR_WEIGHTS}


@query("calibrate")
def calibrate(spark, sf, **how):
    """The prior's weights fitted to graded pools by ``operators.calibrate``: name, weight, and the means before, after and on folds left out."""
    pools = graded(spark, sf)
    # a topic without gold in its pool has no order that is better than another
    judged = retrieve.broadcast_if_small(pools.filter("grade > 0").select("topic_id").distinct(), 1_000_000)
    rows = curves(pools.join(judged, "topic_id", "left_semi")).select("topic_id", "arrival", "grade", *PRIOR_WEIGHTS)
    weights, means = fit(rows, PRIOR_WEIGHTS, BOUNDS, **how)
    return spark.createDataFrame([(n, w, means["base"], means["train"], means["held"]) for n, w in weights.items()], "name string, weight double, base_ndcg double, train_ndcg double, held_ndcg double")


def feedback_rounds(spark, sf, rounds: int = 2, hits_per_topic: int = 8, terms_per_round: int = 3, hits_per_provider: int = 14):
    """Discovery in rounds: BM25 hits of a topic's terms, then the weightiest new terms of its best hits as the next round's query.

    A round keeps ``hits_per_provider`` hits of each provider, among which new keys are counted; the best
    ``hits_per_topic`` of all only choose the new terms. These are plain relevance feedback (count in the hits times
    inverse document frequency). Rounds stop as in ``round_saturation``. Texts are indexed once; rounds read blocks of the
    index, and of texts only those of the best hits. Columns: topic_id, round, n_new, kept.
    """
    docs = evidence(spark, sf).select("ev_id", "source_type", F.col("content").alias("doc_text"))
    index = build_index(docs, part="source_type")
    n_docs = docs.count()
    asked = materialise(retrieve.query_terms(table(spark, sf, "benchmark").select(F.col("item_id").alias("topic_id"), "text")), "asked")
    found = None
    for number in range(1, rounds + 1):
        hits = materialise(search_index(index, asked, hits_per_provider, by_part=True).withColumn("round", F.lit(number)), "hits")
        found = hits if found is None else found.unionByName(hits)
        if number == rounds:
            break
        best = materialise(retrieve.top_per_group(hits.drop("rank"), ["topic_id"], [F.desc("score"), "id"], hits_per_topic).select("topic_id", "id"), "best")
        near = docs.join(retrieve.broadcast_if_small(best.select(F.col("id").alias("ev_id")).distinct(), 1_000_000), "ev_id", "left_semi")
        tokens = near.select(F.col("ev_id").alias("id"), F.explode(tokenize(F.col("doc_text"))).alias("term")).groupBy("id", "term").agg(F.count("*").alias("tf"))
        seen = tokens.join(best, "id").groupBy("topic_id", "term").agg(F.sum("tf").alias("tf"))
        fresh = materialise(seen.join(asked.select("topic_id", "term"), ["topic_id", "term"], "left_anti"), "fresh")
        weight = F.round(F.col("tf") * F.log(n_docs / F.col("df")), 6)
        weighed = fresh.join(term_weights(index, fresh.select("term")), "term").withColumn("w", weight)
        asked = materialise(retrieve.top_per_group(weighed, ["topic_id"], [F.desc("w"), "term"], terms_per_round, "r").select("topic_id", "term", F.lit(1).cast("long").alias("qtf")), "asked")
    return round_saturation(found.select("topic_id", "round", F.col("id").alias("key"), F.col("score").alias("cosine")))


@query("feedback_rounds")
def three_feedback_rounds(spark, sf):
    """All rounds of the reference: the first and up to two reformulations, so that saturation can stop a topic."""
    return feedback_rounds(spark, sf, rounds=3)


@query("first_seen_round", f"""WITH {SIGNALS} SELECT topic_id, key, min(round) AS round, count(*) AS n FROM (SELECT topic_id, ev_id % 5 + 1 AS round, (ev_id * 7) % 41 AS key FROM signals) GROUP BY ALL""")
def first_seen_round(spark, sf):
    rows = signals(spark, sf).select("topic_id", (F.col("ev_id") % 5 + 1).alias("round"), ((F.col("ev_id") * 7) % 41).alias("key"))
    return rows.groupBy("topic_id", "key").agg(F.min("round").alias("round"), F.count("*").alias("n"))


_TEN_SQL = "SELECT topic_id, id, score, CAST(rank AS INTEGER) AS rank FROM ranked WHERE rank <= 10"


def _of_two_segments(spark, sf, text):
    """The ten best of every topic by ``text``, from an index that is written in two segments, the later one added to what was there."""
    docs = evidence(spark, sf).select("ev_id", text.alias("doc_text"))
    old = F.pmod(F.xxhash64("ev_id"), F.lit(4)) < 3
    index = extend_index(build_index(docs.filter(old)), docs.filter(~old))
    asked = materialise(retrieve.query_terms(topics(spark, sf), F.col("must_include")), "asked")
    return search_index(index, asked, 10).select("topic_id", "id", "score", "rank")


@query("bm25_index", f"WITH {BM25_SQL} {_TEN_SQL}")
def bm25_index(spark, sf):
    """``bm25`` from an index in two segments."""
    return _of_two_segments(spark, sf, window_text())


@query("bm25_index_whole", f"WITH {bm25_sql(TEXT_SQL)} {_TEN_SQL}")
def bm25_index_whole(spark, sf):
    """``bm25_index`` over whole texts: their lengths, counts and frequencies are of all tokens, not of a window's."""
    return _of_two_segments(spark, sf, window_text(None))


@query("ndcg_aggregates", f"WITH {METRICS_SQL} SELECT topic_id, ndcg_at_10_pool AS native, ndcg_at_10_pool AS grouped FROM metrics WHERE n_gradable > 0")
def ndcg_aggregates(spark, sf):
    """nDCG of every topic's gradable slots twice: as a native fold of its sorted array, and by the grouped function in SQL."""
    ids = evidence(spark, sf).select(F.col("ev_id").alias("id"), paper_id(F.col("url")).isNotNull().alias("gradable"))
    gold = materialise(qrels(spark, sf), "qrels")
    ranked = ranked_documents(spark, sf, CUT).join(gold.select("topic_id").distinct(), "topic_id", "left_semi")
    slots = materialise(ranked.join(ids.filter("gradable"), "id").join(gold, ["topic_id", "id"], "left").select("topic_id", F.col("rank").alias("place"), F.coalesce("grade", F.lit(0)).alias("grade")), "slots")
    native = slots.groupBy("topic_id").agg(metrics.in_order(F.col("place"), F.col("grade")).alias("grades")).select("topic_id", F.round(metrics.ndcg(F.col("grades")), 6).alias("native"))
    name = metrics.register_metrics(spark)
    grouped = spark.sql(f"SELECT topic_id, round({name}(place, grade), 6) AS grouped FROM {{slots}} GROUP BY topic_id", slots=slots)
    return native.join(grouped, "topic_id")
