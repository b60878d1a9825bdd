import random
from collections import Counter
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from quarry.operators.runs import following, in_ranges, run_places
from quarry.plans.usage import stream_breaker
from quarry.streaming.streams import arrivals_by_rounds, breaker, first_arrivals, in_shares, novelty, time_slices
from tests.conftest import SF

DAY0 = datetime(2024, 1, 1)


def log(n=3000, users=6, seed=3):
    """A log of which user 0 has about a third."""
    rnd = random.Random(seed)
    return [(k, DAY0 + timedelta(seconds=rnd.randrange(40) + 7 * k), rnd.choice([0, rnd.randrange(users), rnd.randrange(users), None]), rnd.random() < 0.6) for k in range(n)]


def frame(spark, rows):
    return spark.createDataFrame(rows, "event_id long, ts timestamp, user_id long, failed boolean")


def by_user(rows):
    out = {}
    for r in sorted(rows, key=lambda r: (r[1], r[0])):
        out.setdefault(r[2], []).append(r)
    return out


def test_runs_of_a_hot_producer_are_folded_from_ranges(spark):
    rows = log()
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    ranged = in_ranges(frame(spark, rows).repartition(3), "user_id", ["ts", "event_id"])
    began = spark.createDataFrame([(0, 7), (2, 1), (99, 3)], "user_id long, streak long")
    placed = {r.event_id: r for r in run_places(ranged, "user_id", ["ts", "event_id"], began=began).collect()}
    after = {r.event_id: r.next for r in following(ranged, "user_id", ["ts", "event_id"], F.col("ts")).collect()}
    held = Counter((r.user_id, r.range) for r in ranged.collect())
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    own = by_user(rows)
    assert len(own[0]) > len(rows) / 3.5 and max(held.values()) < len(own[0]) / 3
    assert len(placed) == len(after) == len(rows)
    for user, events in own.items():
        streak, island = {0: 7, 2: 1}.get(user, 0), 0
        for k, (event, _, _, failed) in enumerate(events):
            island, streak = island + (not failed), streak + 1 if failed else 0
            assert (placed[event].island, placed[event].place) == (island, streak)
            assert after[event] == (events[k + 1][1] if k + 1 < len(events) else None)


def test_breaker_goes_on_from_batch_to_batch(spark):
    rows = log(900)
    opened = Counter()
    for user, events in by_user(rows).items():
        streak = 0
        for _, ts, _, failed in events:
            streak = streak + 1 if failed else 0
            if streak == 4:
                opened[user, ts, ts + timedelta(seconds=60)] += 1
    # slices in the order of each producer's log
    parts = [frame(spark, sorted(rows, key=lambda r: (r[1], r[0]))[a : a + 225]) for a in range(0, 900, 225)]
    found = breaker(spark, parts, need=4).collect()
    assert Counter((r.user_id, r.opened_at, r.open_until) for r in found) == opened and len({r.slice for r in found}) == 4


def test_breaker_query_equals_a_plain_loop(spark):
    events = [r for r in spark.read.parquet(f"{SF}/events.parquet").orderBy("user_id", "ts", "event_id").collect()]
    opened, streak, user = 0, 0, None
    for e in events:
        streak = 0 if e.user_id != user else streak
        user = e.user_id
        streak = streak + 1 if e.event_type in ("error", "click") else 0
        opened += streak == 3
    assert stream_breaker(spark, SF).count() == opened


def rows_in_state(progress):
    """Entries that are left when each start of a query ends."""
    return [sum(o.numRowsTotal for o in reports[-1].stateOperators) for reports in progress]


def visits(seed=5, days=150, keys=8):
    rnd = random.Random(seed)
    rows = [(DAY0 + timedelta(days=rnd.random() * days), rnd.choice("ab"), rnd.randrange(keys)) for _ in range(160)]
    return [r for r in rows if r[2] or r[0] < DAY0 + timedelta(days=20)]


def test_cached_arrivals_come_back_when_they_have_run_out(spark):
    rows = visits()
    events = spark.createDataFrame(rows, "ts timestamp, topic string, key long")
    progress = []
    found = sorted((r.topic, r.key, r.ts) for r in first_arrivals(spark, time_slices(events, 6), ["topic", "key"], "30 days", progress=progress).collect())
    want, kept = [], {}
    for ts, topic, key in sorted(rows):
        if (topic, key) not in kept or ts >= kept[topic, key] + timedelta(days=30):
            kept[topic, key] = ts
            want.append((topic, key, ts))
    assert found == sorted(want) and max(Counter(x[:2] for x in found).values()) > 2
    assert found == sorted((r.topic, r.key, r.ts) for r in arrivals_by_rounds(events, ["topic", "key"], "30 days").collect())
    state = rows_in_state(progress)
    assert len(progress) == 6 and any(b < a for a, b in zip(state, state[1:], strict=False))


def test_late_rows_are_dropped(spark):
    parts = [[(DAY0 + timedelta(days=d), "a", d)] for d in (1, 50, 2)]
    slices = [spark.createDataFrame(p, "ts timestamp, topic string, key long") for p in parts]
    assert sorted(r.key for r in first_arrivals(spark, slices, ["topic", "key"], "30 days").collect()) == [1, 50]


def test_novelty_forgets(spark):
    rows = visits(9)
    rows.append((DAY0 + timedelta(days=3), "a", None))
    events = spark.createDataFrame(rows, "ts timestamp, topic string, key long")
    slices, progress = time_slices(events, 5), []
    found = {(r.topic, r.batch): (r.n_new, r.n_seen, r.stopped) for r in novelty(spark, slices, "topic", "key", need=6, timeout="40 days", progress=progress, shares=3).collect()}
    seen, total, stopped, begun = {}, Counter(), set(), set()
    for k, part in enumerate(slices):
        own = sorted((r.ts, r.topic, r.key) for r in part.filter("key is not null").collect())
        for topic in sorted({t for _, t, _ in own}):
            first = {}
            for ts, t, key in own:
                if t == topic:
                    first.setdefault(key, ts)
            new = sum((topic, key) not in seen or ts >= seen[topic, key] + timedelta(days=40) for key, ts in first.items())
            total[topic] += new
            if topic in begun and new < 6:
                stopped.add(topic)
            begun.add(topic)
            assert found.pop((topic, k)) == (new, total[topic], topic in stopped)
        seen.update({(t, key): ts for ts, t, key in own})
    assert not found and stopped and len({total[t] for t in "ab"} | {8}) > 1
    state = rows_in_state(progress)
    assert any(b < a for a, b in zip(state, state[1:], strict=False))


def test_many_keys_share_a_group_of_state(spark):
    """A group of Python's for each topic or key takes milliseconds, however few rows it has; shares bound their number. Null topics and keys are kept apart."""
    rows = [(DAY0 + timedelta(days=d), None if u == 0 else (1 << 60) + u, f"k{u % 3}") for u in range(400) for d in (0, 1, 9)]
    parts = time_slices(spark.createDataFrame(rows, "ts timestamp, topic long, key string"), 3)
    groups = in_shares(parts[0], ["topic", "key"], 5, "1 hour").agg(F.count("*").alias("n")).collect()
    assert len(groups) == 5 and sum(g.n for g in groups) == 800
    found = {(r.topic, r.batch): r.n_new for r in novelty(spark, parts, "topic", "key", timeout="4 days", shares=5).collect()}
    assert found == {(t, b): 1 for t in {r[1] for r in rows} for b in (0, 2)}
    kept = first_arrivals(spark, parts, ["topic", "key"], "4 days", shares=5).collect()
    assert Counter((r.topic, r.key, r.ts) for r in kept) == Counter((t, k, ts) for ts, t, k in rows if ts != DAY0 + timedelta(days=1))
