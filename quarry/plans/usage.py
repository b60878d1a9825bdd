"""Queries of call logs and event streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.operators.runs import following, in_ranges, run_places
from quarry.plans.registry import query
from quarry.sources.tables import table
from quarry.streaming import streams

LOG_SQL = """call_log AS (SELECT event_id, ts, event_type AS purpose, 'm' || (event_id % 3) AS model, 'p' || (user_id % 12) AS provider, user_id AS run_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS tokens, CAST(round(value * 100) AS BIGINT) AS cost_cents,
    event_id % 7 = 0 AS cached, event_type = 'error' AS failed FROM events)"""


def call_log(events):
    return events.select(
        "event_id", "ts", F.col("event_type").alias("purpose"), F.concat(F.lit("m"), (F.col("event_id") % 3).cast("string")).alias("model"), F.concat(F.lit("p"), (F.col("user_id") % 12).cast("string")).alias("provider"), F.col("user_id").alias("run_id"),
        F.get_json_object("props", "$.k").cast("long").alias("tokens"), F.round(F.col("value") * 100).cast("long").alias("cost_cents"), (F.col("event_id") % 7 == 0).alias("cached"), (F.col("event_type") == "error").alias("failed"),
    )


@query("usage_rollup", f"""WITH {LOG_SQL} SELECT coalesce(purpose, '') AS purpose, coalesce(model, '') AS model, coalesce(provider, '') AS provider, CAST(GROUPING(purpose, model, provider) AS BIGINT) AS level, count(*) AS calls, count(*) FILTER (cached) AS n_cached, count(*) FILTER (failed) AS n_failed, CAST(sum(tokens) AS BIGINT) AS tokens, CAST(sum(cost_cents) AS BIGINT) AS cost_cents
    FROM call_log GROUP BY GROUPING SETS ((), (purpose), (model), (provider))""")
def usage_rollup(spark, sf):
    """Totals, and by purpose, by model and by provider, in one scan."""
    log = call_log(table(spark, sf, "events"))
    keys = ["purpose", "model", "provider"]
    sets = log.groupingSets([[], [F.col("purpose")], [F.col("model")], [F.col("provider")]], *keys)
    out = sets.agg(F.grouping_id().alias("level"), F.count("*").alias("calls"), F.count_if("cached").alias("n_cached"), F.count_if("failed").alias("n_failed"), F.sum("tokens").alias("tokens"), F.sum("cost_cents").alias("cost_cents"))
    return out.select(*(F.coalesce(k, F.lit("")).alias(k) for k in keys), "level", "calls", "n_cached", "n_failed", "tokens", "cost_cents")


@query("failure_runs", """WITH e AS (SELECT user_id, event_id, ts, event_type IN ('error', 'click') AS failed, sum(CASE WHEN event_type NOT IN ('error', 'click') THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS island FROM events)
    SELECT user_id, CAST(island AS BIGINT) AS island, count(*) AS n, min(ts) AS first_ts, max(ts) AS last_ts, count(*) >= 3 AS opens, max(ts) + INTERVAL 60 SECOND AS open_until FROM e WHERE failed GROUP BY user_id, island""")
def failure_runs(spark, sf):
    """Runs of consecutive failures of each producer; from three on they open the breaker for 60 seconds."""
    rows = table(spark, sf, "events").select("user_id", "ts", "event_id", F.col("event_type").isin("error", "click").alias("failed"))
    placed = run_places(in_ranges(rows, "user_id", ["ts", "event_id"]), "user_id", ["ts", "event_id"])
    runs = placed.filter("failed").groupBy("user_id", "island").agg(F.count("*").alias("n"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))
    return runs.withColumn("opens", F.col("n") >= 3).withColumn("open_until", F.col("last_ts") + F.expr("interval 60 seconds"))


@query("stage_durations", """WITH e AS (SELECT user_id, event_type AS stage, epoch_us(lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id)) - epoch_us(ts) AS us FROM events) SELECT user_id, stage, count(us) AS n, CAST(coalesce(sum(us), 0) AS BIGINT) AS total_us FROM e GROUP BY ALL""")
def stage_durations(spark, sf):
    """Time from each event of a run to the next, by stage."""
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    rows = in_ranges(table(spark, sf, "events").select("user_id", "ts", "event_id", F.col("event_type").alias("stage")), "user_id", ["ts", "event_id"])
    us = following(rows, "user_id", ["ts", "event_id"], at).withColumn("us", F.col("next") - at)
    return us.groupBy("user_id", "stage").agg(F.count("us").alias("n"), F.coalesce(F.sum("us"), F.lit(0)).alias("total_us"))


@query("quota_windows", f"""WITH {LOG_SQL} SELECT time_bucket(INTERVAL 60 SECOND, ts) AS start, count(*) AS requests, CAST(sum(tokens) AS BIGINT) AS tokens, count(*) > 200 OR sum(tokens) > 200000 AS over FROM call_log GROUP BY 1""")
def quota_windows(spark, sf):
    return streams.quota_windows(call_log(table(spark, sf, "events")))


@query("run_sessions", """WITH e AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events), s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM e)
    SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 30 MINUTE AS stop, count(*) AS n FROM s GROUP BY user_id, k""")
def run_sessions(spark, sf):
    return streams.run_sessions(table(spark, sf, "events"))


#: Slices of equal time in which the streams below get the events.
SLICES = 5
SLICE_SQL = f"e AS (SELECT *, (epoch_us(ts) - min(epoch_us(ts)) OVER ()) * {SLICES} // (max(epoch_us(ts)) OVER () - min(epoch_us(ts)) OVER () + 1) AS batch FROM events)"


def slices(spark, sf):
    return streams.time_slices(table(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp")), SLICES)


#: The events are of one month, so lifetimes here are shorter than the 30 days that the operators start from.
LIFETIME, FORGET = "6 days", "4 days"
KEPT_SQL = f"""RECURSIVE kept AS (SELECT user_id, event_type, min(ts) AS ts FROM events GROUP BY ALL
    UNION ALL SELECT k.user_id, k.event_type, min(e.ts) AS ts FROM kept k JOIN events e ON e.user_id = k.user_id AND e.event_type = k.event_type AND e.ts >= k.ts + INTERVAL {LIFETIME} GROUP BY k.user_id, k.event_type, k.ts)"""


@query("stream_dedup", f"WITH {KEPT_SQL} SELECT user_id, event_type, ts FROM kept")
def stream_dedup(spark, sf):
    """What a cache of (user, type) with a lifetime lets through, as a stream in several batches."""
    found = streams.first_arrivals(spark, slices(spark, sf), ["user_id", "event_type"], LIFETIME)
    return found.select("user_id", "event_type", F.col("ts").cast("timestamp_ntz").alias("ts"))


@query("expiring_arrivals", f"WITH {KEPT_SQL} SELECT user_id, event_type, ts FROM kept")
def expiring_arrivals(spark, sf):
    """The same of the whole table at once."""
    found = streams.arrivals_by_rounds(table(spark, sf, "events"), ["user_id", "event_type"], LIFETIME)
    return found.select("user_id", "event_type", F.col("ts").cast("timestamp_ntz").alias("ts"))


@query("stream_cost", f"WITH {LOG_SQL} SELECT purpose, count(*) AS calls, CAST(sum(cost_cents) AS BIGINT) AS cost_cents FROM call_log GROUP BY purpose")
def stream_cost(spark, sf):
    return streams.finish(spark, streams.running_cost(call_log(streams.events(spark, sf))), "complete")


@query("stream_quota", f"""WITH {LOG_SQL} SELECT time_bucket(INTERVAL 60 SECOND, ts) AS start, count(*) AS requests, CAST(sum(tokens) AS BIGINT) AS tokens, count(*) > 200 OR sum(tokens) > 200000 AS over FROM call_log GROUP BY 1""")
def stream_quota(spark, sf):
    return streams.finish(spark, streams.quota_windows(call_log(streams.events(spark, sf))), "complete").withColumn("start", F.col("start").cast("timestamp_ntz"))


@query("stream_novelty", f"""WITH {SLICE_SQL}, k AS (SELECT user_id AS topic, event_type AS key, batch, min(ts) AS first, max(ts) AS last FROM e WHERE event_type IS NOT NULL GROUP BY ALL),
    w AS (SELECT *, max(last) OVER (PARTITION BY topic, key ORDER BY batch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS was FROM k),
    n AS (SELECT topic, CAST(batch AS BIGINT) AS batch, count(*) FILTER (was IS NULL OR first >= was + INTERVAL {FORGET}) AS n_new FROM w GROUP BY ALL), f AS (SELECT *, n_new < 3 AND row_number() OVER (PARTITION BY topic ORDER BY batch) > 1 AS few FROM n)
    SELECT topic, batch, n_new, CAST(sum(n_new) OVER t AS BIGINT) AS n_seen, bool_or(few) OVER t AS stopped FROM f WINDOW t AS (PARTITION BY topic ORDER BY batch)""")
def stream_novelty(spark, sf):
    """Types of event that are new to a user, batch by batch; a type not seen for some days counts as new again."""
    return streams.novelty(spark, slices(spark, sf), "user_id", "event_type", timeout=FORGET)


@query("stream_breaker", """WITH e AS (SELECT user_id, event_id, ts, event_type IN ('error', 'click') AS failed, sum(CASE WHEN event_type NOT IN ('error', 'click') THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS island FROM events),
    p AS (SELECT *, row_number() OVER (PARTITION BY user_id, island ORDER BY ts, event_id) AS place FROM e WHERE failed) SELECT user_id, ts AS opened_at, ts + INTERVAL 60 SECOND AS open_until FROM p WHERE place = 3""")
def stream_breaker(spark, sf):
    """Breakers that open over a stream in several batches; streaks go on from batch to batch."""
    rows = [s.withColumn("failed", F.col("event_type").isin("error", "click")) for s in slices(spark, sf)]
    found = streams.breaker(spark, rows, need=3)
    return found.select("user_id", *(F.col(c).cast("timestamp_ntz").alias(c) for c in ("opened_at", "open_until")))


@query("quota_sliding", f"""WITH {LOG_SQL}, w AS (SELECT time_bucket(INTERVAL 10 SECOND, ts) - k * INTERVAL 10 SECOND AS start, tokens FROM call_log, (SELECT unnest(range(6)) AS k))
    SELECT start, count(*) AS requests, CAST(sum(tokens) AS BIGINT) AS tokens, count(*) > 200 OR sum(tokens) > 200000 AS over FROM w GROUP BY 1""")
def quota_sliding(spark, sf):
    """Requests and tokens of the last 60 seconds, every 10 seconds."""
    return streams.quota_windows(call_log(table(spark, sf, "events")), slide="10 seconds")
