"""The index, hops, patterns, nested output and metrics on small rows."""

import json
import math
import random
import re
from urllib.parse import unquote

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from quarry.functions import metrics
from quarry.operators import findings, retrieve
from quarry.operators.hops import expand_hops
from quarry.operators.identity import host_filter
from quarry.operators.index import build_index, extend_index, search_index, skipped_blocks, term_weights
from quarry.plans.ranking import edges
from quarry.storage import shared_dir
from tests.conftest import SF
from quarry.operators.patterns import match_patterns, redact_known
from quarry.operators.verify import judge_in_batches
from quarry.functions.signals import terms_held


def corpus(spark, n=240, seed=1):
    """Texts of two vocabularies, which share a word that nearly all have."""
    rnd = random.Random(seed)
    words = [[f"{c}word{k}" for k in range(40)] for c in "xy"]
    rows = [(k, " ".join(rnd.choices(words[k % 2], k=rnd.randrange(3, 30)) + ["common"] * rnd.randrange(3)), "ab"[k % 3 == 0]) for k in range(n)]
    return spark.createDataFrame([*rows, (n, "", "a"), (n + 1, None, "b")], "ev_id long, doc_text string, part string")


def asked(spark, seed=2):
    rnd = random.Random(seed)
    return spark.createDataFrame([(t, f"{'xy'[t % 2]}word{rnd.randrange(40)}", 1 + k % 2) for t in range(8) for k in range(4)] + [(t, "common", 1) for t in range(8)] + [(9, "nowhere", 1)], "topic_id long, term string, qtf long").groupBy("topic_id", "term").agg(F.sum("qtf").alias("qtf"))


@pytest.mark.parametrize(("block", "first", "k"), [(64, 4, 10), (5, 1, 3), (1, 2, 7)])
def test_index_finds_what_a_full_scan_finds(spark, block, first, k):
    docs, queries = corpus(spark), asked(spark)
    index = extend_index(build_index(docs.filter("ev_id < 150"), block_docs=block), docs.filter("ev_id >= 150"), block_docs=block)
    full = retrieve.bm25(docs, queries).withColumn("score", F.round("score", 6))
    want = {(r.topic_id, r.id, r.score, r["rank"]) for r in retrieve.top_per_group(full, ["topic_id"], [F.desc("score"), "id"], k).collect()}
    assert {(r.topic_id, r.id, r.score, r["rank"]) for r in search_index(index, queries, k, first_blocks=first).collect()} == want and len(want) > 7 * k - 1
    met = skipped_blocks(index, queries, k, first).first()
    assert 0 < met.skipped < met.blocks or block == 64 or first * block < k  # without k early hits there is no floor


def test_row_groups_of_an_index_hold_few_entries(spark):
    """A file was one row group, of which Spark's reader fills its arrays with up to 4 096 blocks at once: over a GB for a task, where texts are whole and files large."""
    words = F.transform(F.sequence(F.lit(1), F.lit(400)), lambda k: F.concat(F.lit("w"), F.pmod(F.xxhash64("id", k), F.lit(50_000))))
    index = build_index(spark.range(4000, numPartitions=1).select(F.col("id").alias("ev_id"), F.array_join(words, " ").alias("doc_text")))
    groups = []
    for file in index.table(spark, "blocks").inputFiles():
        meta = pq.ParquetFile(unquote(file.removeprefix("file:"))).metadata
        groups += [sum(meta.row_group(g).column(c).num_values for c in range(meta.num_columns)) for g in range(meta.num_row_groups)]
    assert len(groups) > 1 and max(groups) < 3_000_000 < sum(groups)
    asked = spark.createDataFrame([(0, f"w{k}", 1) for k in (7, 8, 70_000)], "topic_id long, term string, qtf long")
    held = spark.range(4000).select(F.explode(F.array_distinct(words)).alias("term")).filter("term in ('w7', 'w8')").groupBy("term").count()
    assert {(r.term, r.df) for r in term_weights(index, asked).collect()} == {(r.term, r["count"]) for r in held.collect()}


def test_search_gives_on_a_few_rows_of_each_task(spark, monkeypatch):
    """Scores of all pairs of topic and document were shuffled and written before the k best were taken, copies of one text too."""
    from quarry.operators import index as I

    written, keep = {}, I.materialise
    monkeypatch.setattr(I, "materialise", lambda df, name="stage", **kw: written.setdefault(name, keep(df, name, **kw)))
    docs = spark.range(4000).select((4000 - F.col("id")).alias("ev_id"), F.concat_ws(" ", F.lit("yword1 yword2"), F.when(F.col("id") % 4 == 0, F.concat(F.lit("w"), "id"))).alias("doc_text"))
    queries = spark.createDataFrame([(t, f"yword{1 + t % 2}", 1) for t in range(6)], "topic_id long, term string, qtf int")
    index = build_index(docs)
    got = search_index(index, queries, 5).collect()
    copies = [r.ev_id for r in docs.filter("doc_text = 'yword1 yword2'").orderBy("ev_id").limit(5).collect()]
    assert all(sorted(r.id for r in got if r.topic_id == t) == copies for t in range(6))
    assert sum(df.count() for df in written.values()) < 6 * 5 * 12 and index.path.startswith(shared_dir(spark))


def test_ranked_documents_make_no_row_of_each_pair(spark, monkeypatch):
    """Tokens, counts and scores of all pairs of topic and document were written before the best were taken."""
    from quarry.operators import index as I
    from quarry.plans import retrieval as P

    written, keep = [], I.materialise
    for module in (I, P, retrieve):
        monkeypatch.setattr(module, "materialise", lambda df, name="stage", **kw: (written.append(kept := keep(df, name, **kw)), kept)[1])
    docs = P.evidence(spark, SF).select("ev_id", retrieve.document_text(F.col("title"), F.col("content"), F.col("snippet"), P.WINDOW).alias("doc_text"))
    terms = retrieve.query_terms(P.topics(spark, SF), F.col("must_include"))
    full = retrieve.top_per_group(retrieve.bm25(docs, terms).withColumn("score", F.round("score", 6)), ["topic_id"], [F.desc("score"), "id"], 2)
    want = {(r.topic_id, r.id, r.score, r["rank"]) for r in full.collect()}
    pairs, written[:] = written[-1].count(), []
    assert {(r.topic_id, r.id, r.score, r["rank"]) for r in P.ranked_documents(spark, SF, 2).collect()} == want and want
    assert all("tokens" not in df.columns for df in written) and written[-1].count() < pairs / 2


def test_weights_of_terms_are_found_once(spark, monkeypatch):
    """A search read the heads of all blocks again for weights that its caller had, and its own twice."""
    from quarry.operators import index as I

    docs, queries = corpus(spark), asked(spark)
    index = build_index(docs)
    weights, want = term_weights(index, queries), search_index(index, queries, 5).collect()
    monkeypatch.setattr(I, "term_weights", None)
    assert sorted(search_index(index, queries, 5, weights=weights).collect()) == sorted(want) and want


def test_signals_find_weights_once(spark, monkeypatch):
    """The heads of all blocks were read three times: twice by the search, and again for the shares of terms."""
    from quarry.operators import index as I
    from quarry.plans import pool

    made, weights, own = [], I.term_weights, getattr(I, "_weights", None)
    monkeypatch.setattr(I, "term_weights", lambda *a, **kw: (made.append("search"), weights(*a, **kw))[1])
    monkeypatch.setattr(pool, "term_weights", lambda *a, **kw: (made.append("pool"), weights(*a, **kw))[1])
    monkeypatch.setattr(I, "_weights", lambda *a: (made.append("read"), own(*a))[1], raising=False)
    assert pool.build_signals(spark, SF).count() > 0 and made == ["pool"]


def test_nearest_vectors_of_odd_rows_and_copies(spark, monkeypatch):
    """Ranks equal those of all pairs, of which only few reach the JVM."""
    rnd, met = random.Random(6), []
    vectors = [[rnd.gauss(0, 1) for _ in range(8)] for _ in range(2000)]
    rows = [(k, vectors[k] if k % 3 else vectors[0]) for k in range(2000)] + [(2000, None), (2001, [0.0] * 8), (2002, [1.0] * 5), (2003, [None, *[1.0] * 7]), (2004, [])]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    q = v.filter("vec_id % 100 = 0 or vec_id > 1999").select(F.col("vec_id").alias("query_id"), "embedding")
    cosine, keep = retrieve.cosine, retrieve.top_per_group
    pairs = q.select("query_id", F.col("embedding").alias("q")).crossJoin(v).filter("query_id <> vec_id").select("query_id", F.col("vec_id").alias("id"), cosine(F.col("embedding"), F.col("q")).alias("cosine"))
    want = {(r.query_id, r["rank"], r.id) for r in keep(pairs, ["query_id"], [F.desc("cosine"), "id"], 7).collect()}
    monkeypatch.setattr(retrieve, "top_per_group", lambda df, *a: (met.append(df.count()), keep(df, *a))[1])
    assert {(r.query_id, r["rank"], r.id) for r in retrieve.cosine_top(v, q, 7, block=6).collect()} == want and len(want) == 7 * 25
    assert sum(met) < pairs.count() / 4


def test_index_ranks_within_parts(spark):
    docs, queries = corpus(spark), asked(spark)
    index = build_index(docs, part="part", block_docs=4)
    full = retrieve.bm25(docs, queries).withColumn("score", F.round("score", 6)).join(docs.select(F.col("ev_id").alias("id"), "part"), "id")
    want = {(r.topic_id, r.part, r.id, r.score) for r in retrieve.top_per_group(full, ["topic_id", "part"], [F.desc("score"), "id"], 5).collect()}
    assert {(r.topic_id, r.part, r.id, r.score) for r in search_index(index, queries, 5, by_part=True, first_blocks=1).collect()} == want
    weights = {r.term: r.df for r in term_weights(index, queries.select("term")).collect()}
    assert "nowhere" not in weights and weights["common"] == docs.filter("contains(doc_text, 'common')").count()


def test_hops_keep_the_shortest_way(spark):
    edges = spark.createDataFrame([(1, 2), (1, 3), (1, 4), (2, 5), (3, 5), (5, 1), (5, 6), (6, 7), (4, 4), (None, 9), (1, 2), (3, 10), (3, 11), (3, 12), (3, 13)], "src long, dst long")
    seeds = spark.createDataFrame([(0, 1), (0, 1), (1, 6), (2, None)], "topic_id long, id long")
    got = {(r.topic_id, r.id): (r.hop, r.parent) for r in expand_hops(edges, seeds, 3, per_record=3).collect()}
    assert got == {(0, 1): (0, None), (0, 2): (1, 1), (0, 3): (1, 1), (0, 4): (1, 1), (0, 5): (2, 2), (0, 10): (2, 3), (0, 11): (2, 3), (0, 6): (3, 5), (1, 6): (0, None), (1, 7): (1, 6)}
    assert {(r.topic_id, r.id) for r in expand_hops(edges, seeds, 5, per_record=9, per_hop=1).collect()} == {(0, 1), (0, 2), (0, 5), (0, 6), (0, 7), (1, 6), (1, 7)}


def test_hops_ask_for_the_edges_of_their_frontier(spark):
    """All edges were made and written first."""
    edges = spark.createDataFrame([(1, 2), (1, 3), (1, 4), (2, 5), (3, 5), (5, 1), (5, 6), (6, 7), (4, 4), (3, 10), (3, 11), (3, 12), (8, 9)], "src long, dst long")
    seeds = spark.createDataFrame([(0, 1), (1, 6)], "topic_id long, id long")
    got = {(r.topic_id, r.id): (r.hop, r.parent) for r in expand_hops(edges, seeds, 3, per_record=3).collect()}
    asked = []
    given = expand_hops(lambda ids: (asked.append({r.id for r in ids.collect()}), edges.join(ids.withColumnRenamed("id", "src"), "src", "left_semi"))[1], seeds, 3, per_record=3).collect()
    assert {(r.topic_id, r.id): (r.hop, r.parent) for r in given} == got and asked == [{1, 6}, {2, 3, 4, 7}, {5, 10, 11}]


def test_edges_of_given_parts_equal_those_of_all(spark):
    every = edges(spark, SF)
    parts = spark.range(0, 30, 7)
    want = {tuple(r) for r in every.join(parts.withColumnRenamed("id", "src"), "src", "left_semi").select("src", "dst", "kind").collect()}
    assert {tuple(r) for r in edges(spark, SF, parts).collect()} == want and want


@pytest.mark.parametrize("share", [1 << 20, 60])
def test_patterns_are_found_as_one_by_one(spark, share):
    rnd = random.Random(3)
    texts = [(k, "".join(rnd.choice(["ab", "a", " ", "b-c", "_", "É", "aba ", "\n"]) for _ in range(rnd.randrange(30)))) for k in range(60)] + [(60, None), (61, "")]
    terms = ["ab", "a b", "É", "b-c", "aba", "a", " AB ", "aa", "", None, "ba a"]
    got = {(r.id, r.pattern_id): (r.n, r.first) for r in match_patterns(spark.createDataFrame(texts, "id long, text string"), spark.createDataFrame(list(enumerate(terms)), "pattern_id int, term string"), share_bytes=share).collect()}
    want = {}
    for k, text in texts:
        for p, term in enumerate(terms):
            low, t = (text or "").lower(), (term or "").strip().lower()
            if t:
                hits = [i for i in range(len(low)) if low.startswith(t, i) and (" " in t or not (i and re.match(r"[^\W]", low[i - 1]) or re.match(r"[^\W]", low[i + len(t) : i + len(t) + 1])))]
                if hits:
                    want[k, p] = len(hits), hits[0]
    assert got == want and len(want) > 100


def test_many_patterns_in_one_pass(spark):
    patterns = spark.range(100_000).select(F.col("id").alias("pattern_id"), F.concat(F.lit("term"), "id").alias("term"))
    texts = spark.range(300).select("id", F.concat_ws(" ", F.concat(F.lit("Term"), F.col("id") * 7), F.lit("and other terms"), F.concat(F.lit("xterm"), "id")).alias("text"))
    assert {(r.id, r.pattern_id) for r in match_patterns(texts, patterns).collect()} == {(k, 7 * k) for k in range(300)}


def test_known_values_go_leftmost_and_longest(spark):
    rows = spark.createDataFrame([(1, "abcd abx xyz"), (2, "AB ab"), (3, None), (4, "")], "id long, text string")
    values = spark.createDataFrame([("ab",), ("abc",), ("xyz",), ("cd",), (None,), ("",)], "value string")
    assert [r.text for r in redact_known(rows, values).orderBy("id").collect()] == ["[redacted]d [redacted]x [redacted]", "AB [redacted]", None, ""]
    assert [r.text for r in redact_known(rows, values.limit(0)).orderBy("id").collect()] == ["abcd abx xyz", "AB ab", None, ""]


def test_terms_of_a_row(spark):
    rows = [("Covid-19 and aspirin, ASPIRIN", ["covid-19", "Aspirin", "spirin", "and aspirin", " ", "aspirin", "19"]), (None, ["a"]), ("a", [])]
    got = [r.n for r in spark.createDataFrame(rows, "text string, terms array<string>").select(terms_held(F.col("text"), F.col("terms")).alias("n")).collect()]
    assert got == [5, 0, 0]


def test_outputs_are_read_leniently(spark):
    raw = [
        json.dumps({"relevance": "1.7", "directness": "DIRECT", "findings": [{"statement": " a ", "quote": "In  the\ntext", "direction": "Weakly_supports", "confidence": 0.5}, {"statement": ""}, {"statement": "b", "quote": "elsewhere", "confidence": "NaN"}, {"statement": "c"}, {"statement": "d"}], "pico": {"intervention": "x", "outcome": " "}}),
        json.dumps({"relevance": None, "findings": [], "summary": " s ", "pico": {"intervention": "x", "population": "y"}}), '{"relevance": 0.5, "findings": [', "", None, json.dumps({"relevance": 0.4, "findings": "none", "summary": "kept"}),
    ]
    rows = spark.createDataFrame([(k, r, "It is in the text.") for k, r in enumerate(raw)], "id int, raw string, content string")
    got = {r.id: r for r in findings.parse_output(rows).withColumn("block", findings.block_of(F.col("findings"), F.col("summary"))).collect()}
    first = got[0]
    assert (first.relevance, first.directness, first.pico, first.corrupt) == (1.0, "direct", None, None)
    assert [(f.statement, f.quote, f.direction, f.label, f.confidence) for f in first.findings] == [("a", "In  the\ntext", "weakly_supports", "SUPPORT", 0.5), ("b", None, "no_evidence", "NOINFO", 0.0), ("c", None, "no_evidence", "NOINFO", 0.0)]
    assert first.block == '- a "In  the\ntext" [SUPPORT]\n- b [NOINFO]\n- c [NOINFO]'
    assert (got[1].relevance, got[1].summary, got[1].pico.population, got[1].block) == (0.0, "s", "y", "s")
    assert all(got[k].corrupt is not None and not got[k].findings and got[k].directness == "background" for k in (2, 4, 5))
    assert (got[5].relevance, got[5].summary) == (0.4, "kept")


def test_ndcg_both_ways(spark):
    rnd = random.Random(4)
    rows = [(t, p, rnd.choice([0, 0, 1, 2, None]) if t else 0) for t in range(6) for p in range(rnd.choice([1, 5, 30]))]
    rnd.shuffle(rows)
    df = spark.createDataFrame(rows, "topic_id long, place int, grade int")
    native = {r.topic_id: r.x for r in df.groupBy("topic_id").agg(metrics.in_order(F.col("place"), F.col("grade")).alias("g")).select("topic_id", metrics.ndcg(F.col("g")).alias("x")).collect()}
    name = metrics.register_metrics(spark, 10)
    grouped = {r.topic_id: r.x for r in spark.sql(f"SELECT topic_id, {name}(place, grade) AS x FROM {{df}} GROUP BY topic_id", df=df).collect()}
    for t in range(6):
        own = [g or 0 for _, _, g in sorted(r for r in rows if r[0] == t)]
        gain = lambda gs: sum((2**g - 1) / math.log2(k + 2) for k, g in enumerate(gs[:10]))
        want = gain(own) / gain(sorted(own, reverse=True)) if any(own) else 0.0
        assert abs(native[t] - want) < 1e-12 and abs(grouped[t] - want) < 1e-12


def test_hosts_meet_domains_by_equality(spark):
    rows = spark.createDataFrame([(1, "https://a.b.org/x"), (2, "http://xb.org"), (3, "b.org"), (4, None), (5, "https://www.b.org:80/")], "id long, url string")
    domains = spark.createDataFrame([("b.org",), ("b.org",), ("c.org",)], "domain string")
    listed = {r.id for r in host_filter(rows, domains, keep_listed=True).collect()}
    assert listed == {1, 5} and {r.id for r in host_filter(rows, domains).collect()} == {2, 3, 4}


@pytest.mark.parametrize("parts", [1, 7])
def test_chunks_follow_ids(spark, parts):
    sizes = []

    def judge(texts):
        if "bad" in texts:
            raise ValueError("bad chunk")
        return [len(texts) / 10] * len(texts)

    rows = [(k, "bad" if k == 17 else f"t{k}") for k in range(50)] + [(3, "again")] * 12 + [(None, f"n{k}") for k in range(20)]
    got = judge_in_batches(spark.createDataFrame(rows, "id long, input string").repartition(parts), judge, size=10).collect()
    assert len(got) == len(rows) and sorted(r.id for r in got if r.error) == list(range(10, 20))
    assert all(r.score == 1.0 for r in got if r.id is not None and r.id >= 20) and all(r.score == 0.1 for r in got if r.id is None)
    # ten of the 22 rows of the first range, ten more, and what is left
    assert sorted(r.score for r in got if r.id is not None and r.id < 10) == [0.2] * 2 + [1.0] * 20 and not sizes


def test_hops_without_cuts_reach_all(spark):
    """Every neighbour is followed, none but the smallest before; parents and hops are those of a plain search."""
    rnd = random.Random(8)
    edges = [(rnd.randrange(60), rnd.randrange(60)) for _ in range(150)] + [(5, k) for k in range(20, 45)] + [(7, 7), (None, 3), (3, None)]
    seeds = [(t, rnd.randrange(60)) for t in range(9) for _ in range(2)] + [(9, 5), (9, 5), (10, None)]
    want = {}
    for topic in {t for t, s in seeds if s is not None}:
        reached = {s: (0, None) for t, s in seeds if t == topic}
        for hop in (1, 2, 3):
            new = {}
            for a, b in edges:
                if a in reached and reached[a][0] == hop - 1 and b is not None and b not in reached:
                    new[b] = min(new.get(b, a), a)
            reached |= {b: (hop, a) for b, a in new.items()}
        want |= {(topic, k): v for k, v in reached.items()}
    got = expand_hops(spark.createDataFrame(edges, "src long, dst long"), spark.createDataFrame(seeds, "topic_id long, id long"), 3, per_record=None)
    assert {(r.topic_id, r.id): (r.hop, r.parent) for r in got.collect()} == want and got.count() == len(want)
    assert sum(t == 9 and v == (1, 5) for (t, _), v in want.items()) >= 25
