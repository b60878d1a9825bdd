import math
import random

import numpy as np
from pyspark.sql import functions as F

from quarry.functions import design, signals, text
from quarry.operators import identity, rank, retrieve, verify
from quarry.operators.calibrate import calibrate as fit
from quarry.operators.calibrate import discounted, objective, pack, spread
from quarry.operators.components import connected_components
from quarry.plans.evaluation import BOUNDS, calibrate, feedback_rounds
from quarry.plans.verification import judge_in_batches
from quarry.storage import broadcast_if_small, materialise
from tests.conftest import SF


def one(spark, column, **values):
    return spark.createDataFrame([tuple(values.values())], list(values)).select(column.alias("x")).first().x


def test_components_of_chains_loops_and_nulls(spark):
    edges = [(k, k + 1) for k in range(40)] + [(100, 102), (102, 101), (7, 7), (None, 3), (200, 200)]
    got = {r.id: r.component for r in connected_components(spark.createDataFrame(edges, "src long, dst long")).collect()}
    assert got == {**dict.fromkeys(range(41), 0), 100: 100, 101: 100, 102: 100}
    assert connected_components(spark.createDataFrame([], "src long, dst long")).count() == 0


def test_a_bridging_record_joins_two_groups_in_any_order(spark):
    rows = [(0, "http://x/10.1000/a", "A long enough title one"), (1, "http://y/b", "Another long enough title"), (2, "http://z/10.1000/A).", "another LONG enough: title!"), (3, "", "short")]
    for order in (rows, rows[::-1]):
        got = {r.ev_id: r.component for r in identity.duplicate_components(spark.createDataFrame(order, "ev_id long, url string, title string")).collect()}
        assert got == {0: 0, 1: 0, 2: 0, 3: 3}


def test_bm25_by_hand(spark):
    docs = spark.createDataFrame([(1, "alpha beta beta"), (2, "alpha gamma"), (3, "")], "ev_id long, doc_text string")
    topics = spark.createDataFrame([(9, "beta alpha")], "topic_id long, text string")
    got = {r.id: r.score for r in retrieve.bm25(docs, retrieve.query_terms(topics)).collect()}
    idf = lambda df: math.log(1 + (3 - df + 0.5) / (df + 0.5))
    gain = lambda f, n: f * 2.2 / (f + 1.2 * (0.25 + 0.75 * n / (5 / 3)))
    one_, two = idf(2) * gain(1, 3) + idf(1) * gain(2, 3), idf(2) * gain(1, 2)
    assert got.keys() == {1, 2} and abs(got[1] - 1) < 1e-12 and abs(got[2] - two / one_) < 1e-12
    scoped = spark.createDataFrame([(1, "alpha beta", 9), (2, "alpha", 8)], "ev_id long, doc_text string, pool long")
    assert [(r.topic_id, r.id) for r in retrieve.bm25(scoped, retrieve.query_terms(topics), scope="pool").collect()] == [(9, 1)]


def test_mmr_equals_a_plain_loop(spark):
    rng = np.random.default_rng(1)
    rows = [(t, k, k, float(rng.integers(0, 50)) / 50, None if k % 7 == 0 else [float(x) for x in rng.normal(size=6)]) for t in range(3) for k in range(t * 100, t * 100 + 25)]
    got = rank.mmr(spark.createDataFrame(rows, "topic_id long, ev_id long, arrival long, score double, embedding array<float>")).collect()
    for t in range(3):
        left = sorted((r for r in rows if r[0] == t), key=lambda r: (-r[3], r[2]))
        unit = {r[1]: None if r[4] is None else np.float32(r[4]).astype(float) / np.linalg.norm(np.float32(r[4]).astype(float)) for r in left}
        order = []
        while left:
            def value(r):
                if not order or unit[r[1]] is None:
                    return r[3]
                near = max([0.0, *(float(unit[r[1]] @ unit[p]) for p in order if unit[p] is not None)])
                return 0.72 * r[3] - 0.28 * near
            best = max(left, key=lambda r: (value(r), -r[2]))
            order.append(best[1])
            left.remove(best)
        assert [r.ev_id for r in sorted((r for r in got if r.topic_id == t), key=lambda r: r.place)] == order


def test_verdict_folding_cases(spark):
    rows = [
        (1, 0, "error", None, None, "typed"), (2, 0, "says_nothing", 0.96, None, "typed"), (2, 1, "error", None, None, "typed"), (3, 0, "contradicts", 0.86, None, "typed"), (3, 1, "supports", 0.9, None, "typed"),
        (4, 0, "supports", 0.6, None, "typed"), (4, 1, "supports", 0.6, None, "prompted"), (4, 2, "error", None, None, "typed"), (5, 0, "supports", 0.3, {"supports": 0.3, "contradicts": 0.3}, "typed"), (6, 0, "supports", 0.2, {"supports": 0.1, "contradicts": 0.89}, "other"),
    ]
    got = {r.claim: (r.flag, r.weak, list(r.citations)) for r in verify.fold_verdicts(spark.createDataFrame(rows, "claim long, source_index int, relation string, confidence double, probabilities map<string,double>, backend string"), ["claim"]).collect()}
    assert got == {1: ("", False, [0]), 2: ("unaddressed", True, [0, 1]), 3: ("contradicted", True, [0, 1]), 4: ("", False, [0, 2]), 5: ("", True, [0]), 6: ("contradicted", True, [0])}


def test_judging_isolates_failures(spark):
    def judge(texts):
        if "bad" in texts:
            raise ValueError("no")
        return [2.0 for _ in texts]

    rows = spark.createDataFrame([(k, "bad" if k == 4 else "x") for k in range(12)], "id long, input string").coalesce(1)
    got = {r.id: (r.score, r.error) for r in verify.judge_in_batches(rows, judge, 3).collect()}
    assert all(got[k] == ((None, "no") if k in (3, 4, 5) else (1.0, None)) for k in range(12))
    assert judge_in_batches(spark, SF).count() == 200


def test_text_functions(spark):
    assert one(spark, text.extract_doi(F.col("u")), u="see HTTPS://X/10.1000/AbC). ") == "10.1000/abc"
    assert one(spark, text.paper_id(F.col("u")), u="https://arxiv.org/abs/2401.1v3") == "ARXIV:2401.1"
    assert one(spark, text.tokenize(F.col("t")), t="The Anti-PD-1 of 2020, ß x") == ["anti-pd-1"]
    assert one(spark, text.sections(F.col("t")), t="pre\n## A\nx\n## B\n") == ["pre\n", "## A\nx\n", "## B\n"]
    assert one(spark, text.citation_chunks(F.col("t")), t="One [1][2]. [3] two") == ["One [1][2].", "two"]
    assert one(spark, text.quote_grounded(F.col("c"), F.col("q")), c="A  b\nC", q="B c") is True
    assert one(spark, design.normalise(F.col("d")), d=" Randomized-Controlled trial ") == "rct"
    assert abs(one(spark, signals.recency(F.col("d"), 2025), d="x 2017-1") - 0.5) < 1e-12


def test_tokens_of_digits_and_hyphens(spark):
    assert one(spark, text.tokenize(F.col("t")), t="12-3 45 a1 1a -12 12- 0-- é12ß34 x_99_ab 7 77 7a7 1-the of-2 99\n100") == ["12-3", "a1", "1a", "12-", "0--", "ab", "7a7", "1-the", "of-2"]


def test_rank_sums_and_floor(spark):
    hits = spark.createDataFrame([(1, "a", 0), (1, "a", 2), (1, "b", 1), (1, "", 0)], "topic_id long, key string, rank int")
    assert {r.key: round(r.rrf, 9) for r in retrieve.reciprocal_rank_fusion(hits).collect()} == {"a": round(1 / 60 + 1 / 62, 9), "b": round(1 / 61, 9)}
    rows = spark.createDataFrame([(1, 0.1, 5), (1, 0.1, 4), (2, 0.45, 1), (2, 0.2, 2)], "topic_id long, relevance double, arrival long")
    assert {(r.topic_id, r.arrival) for r in rank.relevance_floor(rows).collect()} == {(1, 4), (2, 1)}


def test_storage(spark):
    rows = spark.createDataFrame([(k, None if k % 2 else "x") for k in range(10)], "a long, b string")
    again = materialise(rows)
    assert again.schema == rows.schema and again.count() == 10
    big = broadcast_if_small(rows, 5)
    assert big is rows and broadcast_if_small(rows, 10) is not rows


def test_calibration_and_feedback_run(spark):
    rows = calibrate(spark, SF, step=0.1, passes=2, starts=2).collect()
    assert len(rows) == 10 and all(0 <= r.base_ndcg <= r.train_ndcg <= 1 for r in rows)
    assert all(BOUNDS[r.name][0] <= r.weight <= BOUNDS[r.name][1] for r in rows)
    rounds = feedback_rounds(spark, SF).collect()
    assert {r["round"] for r in rounds} == {1, 2} and all(r.kept for r in rounds)


def test_objective_equals_a_plain_loop(spark):
    rnd = random.Random(5)
    pools = [(t, a, rnd.choice([0, 0, 1, 2]) if t else 0, rnd.choice([0.0, 0.5, 1.0]), None if a == 3 else rnd.random()) for t in range(9) for a in range(rnd.choice([1, 4, 30]))]
    packed = pack(spark.createDataFrame(pools, "topic_id long, arrival long, grade int, a double, b double"), ["a", "b"], 5)
    vectors = np.array([[0.5, 0.1], [0.0, 0.0], [-0.3, 1.0]])
    sums, topics = objective(packed, vectors, 5)
    assert topics.sum() == 9
    for v, (wa, wb) in enumerate(vectors):
        want = 0.0
        for t in range(9):
            rows = sorted((r for r in pools if r[0] == t), key=lambda r: (-round(wa * r[3] + wb * (r[4] or 0.0), 9), r[1]))
            dcg = sum((2 ** r[2] - 1) / math.log2(k + 2) for k, r in enumerate(rows[:10]))
            ideal = sum((2**g - 1) / math.log2(k + 2) for k, g in enumerate(sorted((r[2] for r in rows), reverse=True)[:10]))
            want += dcg / ideal if ideal else 0.0
        assert abs(sums[:, v].sum() - want) < 1e-9
    nothing = spark.createDataFrame([], "topic_id long, arrival long, grade int, a double")
    assert fit(nothing, {"a": 0.2}, {"a": (0.0, 0.5)}, starts=1) == ({"a": 0.2}, {"base": 0.0, "train": 0.0, "held": 0.0})


def test_pools_are_scored_by_many_tasks(spark):
    """All topics were a task of one file, whatever their number."""
    pools = spark.range(60).selectExpr("id div 6 as topic_id", "id as arrival", "cast(id % 2 as int) as grade", "id / 60 as a")
    assert spread(pack(pools, ["a"], 5)).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism > 1


def test_places_are_counted_as_sorted():
    rng = np.random.default_rng(2)
    for n in (1, 5, 40):
        score = rng.choice([0.0, 0.25, 0.5, np.nan], (20, n))
        for share in (0.1, 1.0):
            gain = np.where(rng.random(n) < share, 3.0, 0.0)
            first = [sorted(range(n), key=lambda k: (np.isnan(s[k]), -s[k] if s[k] == s[k] else 0, k))[:10] for s in score]
            want = [sum(gain[k] / math.log2(r + 2) for r, k in enumerate(f)) for f in first]
            assert np.allclose(discounted(score, gain, 10), want, rtol=0, atol=1e-12)


def test_order_of_arrival_does_not_matter(spark):
    rnd = random.Random(4)
    rows = [(k, f"http://h/{k % 7}", f"title number {k % 5} of many") for k in range(30)]
    want = None
    for _ in range(2):
        rnd.shuffle(rows)
        got = sorted((r.ev_id, r.component) for r in identity.duplicate_components(spark.createDataFrame(rows, "ev_id long, url string, title string")).collect())
        want = want or got
        assert got == want
