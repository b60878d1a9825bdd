import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry.llm.ordered import in_order
from quarry.llm.prefix_trie import SpillingQueue, prefix_trie
from quarry.llm.queries import op11_prefix_trie, oracle_sql
from quarry.storage import materialise
from tests.conftest import SF
from tests.oracle import compare


def brute(rows):
    """Rows of the trie of (conv_id, turn, role, text), node by node."""
    turns = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            digest = hashlib.md5((hashlib.md5(role.encode()).hexdigest() + hashlib.md5(text.encode()).hexdigest()).encode()).hexdigest()
            turns[c].append((turn is not None, turn or 0, digest, (role, text)))
    turns = {c: [x[-1] for x in sorted(t)] for c, t in turns.items()}
    rebuilt = {}
    for c, own in turns.items():
        h = zlib.crc32(str(c).encode()) % 9
        rebuilt[c] = (*turns.get(c - c % 5, [])[:h], *own[h:])
    members = defaultdict(list)
    for c, t in rebuilt.items():
        for d in range(len(t) + 1):
            members[t[:d]].append(c)
    children = defaultdict(int)
    for t in members:
        if t:
            children[t[:-1]] += 1
    leaves, saved = defaultdict(int), defaultdict(int)
    for t, m in members.items():
        own = (len(m) - 1) * len(t[-1][1].encode()) if t else 0
        for d in range(len(t) + 1):
            saved[t[:d]] += own
            leaves[t[:d]] += not children[t]
    return sorted(
        (min(m), len(t), min(members[t[:-1]]) if t else -1, len(m), children[t], leaves[t], saved[t], hashlib.sha256(",".join(str(c) for c in sorted(m) if rebuilt[c] == t).encode()).hexdigest())
        for t, m in members.items()
    )


def got(df):
    return sorted(tuple(-1 if x is None else x for x in r) for r in df.collect())


def conversations(n=90, seed=2):
    rnd = random.Random(seed)
    rows = []
    for c in range(n):
        for t in range(rnd.choice([0, 1, 2, 5, 9, 14])):
            rows.append((c, t if rnd.random() < 0.9 else rnd.choice([None, 3]), rnd.choice(["user", "assistant", None]), rnd.choice(["a", "bé", "", None, "long text"])))
    rows += [(7, 2, "user", "same")] * 4 + [(None, 0, "user", "nobody"), (10**12, None, None, None)]
    rows += [(200, t, "user", f"t{t}") for t in range(60)] + [(201, t, "user", f"t{t}") for t in range(60)] + [(k, t, "user", f"t{t}") for k in (1300, 1305, 2600) for t in range(40)]
    return rows


def frame(spark, rows):
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "1 as depth", "'x' as key", "2 as position", "3 as conv")


@pytest.mark.parametrize(("convs", "levels", "room"), [(1 << 20, 1 << 20, 1 << 14), (7, 4, 3), (1, 2, 2)])
def test_trie_equals_brute_force(spark, convs, levels, room):
    rows = conversations()
    assert got(prefix_trie(frame(spark, rows).repartition(5), shard_convs=convs, shard_levels=levels, queue_room=room)) == brute(rows)


def test_trie_of_little(spark):
    assert prefix_trie(frame(spark, [(1, 0, "user", "a")]).limit(0)).count() == 0
    rows = [(3, 0, None, None)]  # its own turns are fewer than what its base should give, and there is no base
    assert got(prefix_trie(frame(spark, rows))) == brute(rows)
    rows = [(5, None, "x", "y")] * 3 + [(6, 1, "x", "y")]
    assert got(prefix_trie(frame(spark, rows))) == brute(rows)


def test_queue_spills_and_keeps_the_order():
    rnd = random.Random(4)
    queue, plain = SpillingQueue(10), []
    queue.BLOCK = 3
    taken = []
    for key in range(300):
        for _ in range(rnd.randrange(4)):
            item = (key + rnd.randrange(50), rnd.randrange(9))
            queue.push(item)
            plain.append(item)
        taken += queue.pop((key,))
    assert queue.opened > 5
    assert sorted(taken) == sorted(x for x in plain if x[0] < 300) and [x[0] for x in taken] == sorted(x[0] for x in taken)


def test_places_and_running_xors(spark):
    rng = np.random.default_rng(1)
    rows = [(int(g), int(o), int(x)) for g, o, x in zip(rng.choice([1, 1, 1, 2, -3], 3000), rng.integers(0, 10**6, 3000), rng.integers(-(2**62), 2**62, 3000), strict=True)]
    spark.conf.set("spark.sql.shuffle.partitions", "13")
    df = materialise(spark.createDataFrame(rows, "g long, o long, x long"), "rows")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    found = in_order(df, "g", ["o"], ["x"]).collect()
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    want = defaultdict(list)
    for g, o, x in sorted(rows):
        want[g].append((o, x))
    for g, own in want.items():
        mine = sorted((r.position, r.o, r.x) for r in found if r.g == g)
        assert [p for p, *_ in mine] == list(range(len(own))) and [o for _, o, _ in mine] == [o for o, _ in own]
        assert mine[-1][2] == int(np.bitwise_xor.reduce([x for _, x in own]))
    assert len(found) == 3000


def test_the_query_equals_brute_force_and_its_sql(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert got(op11_prefix_trie(spark, SF)) == brute(rows)
    assert compare(spark, SF, op11_prefix_trie, oracle_sql()["op11_prefix_trie"]) is None


def test_long_conversation_is_spread(spark):
    rows = spark.range(5000).select(F.when(F.col("id") < 4000, 5).otherwise(F.col("id")).alias("conv_id"), F.col("id").alias("turn"), F.lit("user").alias("role"), F.lit("t").alias("text"))
    found = {r.depth: r for r in prefix_trie(rows, shard_levels=100).filter("conv_id = 5").collect()}
    assert found[4000].n_children == 0 and found[4000].n_leaves == 1 and found[1].n_convs == 1001
