"""Queries of signals, grading, cuts and merges."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quarry.functions import design as D
from quarry.functions import signals as S
from quarry.functions.text import tokenize
from quarry.operators import rank as R
from quarry.operators import register as G
from quarry.operators.hops import expand_hops
from quarry.operators.retrieve import dot, top_per_group
from quarry.plans.pool import SIGNALS, signals
from quarry.plans.registry import query
from quarry.plans.retrieval import DOI_SQL, PAPER_SQL, tokens_sql
from quarry.sources.tables import EVIDENCE, PROVIDERS, evidence, table
from quarry.storage import broadcast_if_small, materialise

AS_OF = 2025
CURVES_SQL = f"""CASE WHEN citation_count <= 0 THEN 0.0 ELSE least(1.0, ln(1 + citation_count) / ln(1001)) END::DOUBLE AS citation,
    coalesce(pow(0.5, greatest(0, {AS_OF} - CAST(nullif(regexp_extract(publication_date, '((?:19|20)[0-9]{{2}})', 1), '') AS INTEGER)) / 8.0), 0.5)::DOUBLE AS recency,
    CASE reliability_tier WHEN 1 THEN 1.0 WHEN 2 THEN 0.6 ELSE 0.2 END::DOUBLE AS tier"""


def curves(df):
    return df.withColumn("citation", S.citation(F.col("citation_count"))).withColumn("recency", S.recency(F.col("publication_date"), AS_OF)).withColumn("tier", S.tier(F.col("reliability_tier")))


@query("signal_curves", f"WITH {EVIDENCE} SELECT ev_id, round(citation, 6) AS citation, round(recency, 6) AS recency, tier FROM (SELECT ev_id, {CURVES_SQL} FROM evidence)")
def signal_curves(spark, sf):
    return curves(evidence(spark, sf)).select("ev_id", F.round("citation", 6).alias("citation"), F.round("recency", 6).alias("recency"), "tier")


_HITS = "len(list_filter({0}, lambda t: CASE WHEN t LIKE '% %' THEN contains(low, t) ELSE regexp_matches(low, '(^|[^\\p{{L}}\\p{{N}}_])' || t || '($|[^\\p{{L}}\\p{{N}}_])') END))"


@query("concept_offtopic", f"""WITH {EVIDENCE}, t AS (SELECT ev_id, lower(content) AS low, {tokens_sql('title')} AS w FROM evidence), v AS (SELECT ev_id, low, list_distinct_ordered, n FROM (SELECT ev_id, low, list_filter(w, lambda x, i: list_position(w, x) = i) AS u FROM t) s, LATERAL (SELECT u[1:2] || ['zzz', 'of the'] AS list_distinct_ordered, u[3:4] || ['in the'] AS n))
    SELECT ev_id, round({_HITS.format('list_distinct_ordered')} / len(list_distinct_ordered), 6) AS concept, least(1.0, {_HITS.format('n')} / 2.0)::DOUBLE AS offtopic FROM v""")
def concept_offtopic(spark, sf):
    words = F.array_distinct(tokenize(F.col("title")))
    concepts, negatives = F.concat(F.slice(words, 1, 2), F.array(F.lit("zzz"), F.lit("of the"))), F.concat(F.slice(words, 3, 2), F.array(F.lit("in the")))
    return evidence(spark, sf).select("ev_id", F.round(S.concept_share(F.col("content"), concepts), 6).alias("concept"), S.offtopic(F.col("content"), negatives).alias("offtopic"))


#: A wording for each branch of the reading, put into titles by document id, and one that names no design.
WORDINGS = (
    "a network meta", "Scoping Review", "practice guidelines", "double-blind phase iii trial", "open label trial crossover study", "longitudinal study", "nested case", "survey among", "case series", "murine cell line", "overview of", "medrxiv preprint rct", "plain",
)


def worded_title():
    return F.concat_ws(" ", "title", F.element_at(F.array(*map(F.lit, WORDINGS)), (1 + F.col("ev_id") % len(WORDINGS)).cast("int")))


def _graded(spark, sf):
    text = D.scan_text(worded_title(), F.col("content"), F.col("snippet"))
    rows = evidence(spark, sf).withColumn("design", D.detect(F.col("source_type"), F.col("publication_types"), text)).withColumn("preprint", D.is_preprint(F.col("source_type"), text))
    return rows.withColumn("score", F.round(D.score(F.col("design"), F.col("preprint")), 6)).withColumn("label", D.label(F.col("design"), F.col("preprint")))


def _case(key: str, values: dict) -> str:
    quote = lambda v: f"'{v}'" if isinstance(v, str) else repr(v)
    return f"CASE {key} " + " ".join(f"WHEN '{k}' THEN {quote(v)}" for k, v in values.items()) + " END"


_SCORES = {k: v for k, (v, _) in D.DESIGNS.items()}
GRADED_SQL = f"""{EVIDENCE}, worded AS (SELECT *, substr(title || ' ' || {list(WORDINGS)}[1 + ev_id % {len(WORDINGS)}] || '. ' || CASE WHEN content <> '' THEN content ELSE snippet END, 1, 700) AS scan FROM evidence),
    read AS (SELECT *, source_type = 'biorxiv' OR regexp_matches(scan, '(?i){D.PREPRINT}') AS preprint, coalesce({_case('source_type', D.PROVIDER_DESIGNS)},
        (SELECT arg_max(d, s) FROM (SELECT d, {_case('d', _SCORES)} AS s FROM (SELECT {_case('lower(p)', D.TYPE_DESIGNS)} AS d FROM unnest(publication_types) u(p))) WHERE d IS NOT NULL),
        CASE {' '.join(f"WHEN regexp_matches(scan, '(?i){p}') THEN '{d}'" for d, p in D.PATTERNS)} END, 'unknown') AS design FROM worded),
    graded AS (SELECT *, round({_case('design', _SCORES)}::DOUBLE * CASE WHEN preprint THEN 0.75 ELSE 1 END, 6) AS score,
        CASE WHEN preprint AND name <> '' THEN name || ' (preprint)' WHEN preprint THEN 'preprint' ELSE name END AS label FROM (SELECT *, {_case('design', {k: v for k, (_, v) in D.DESIGNS.items()})} AS name FROM read))"""


@query("grade_design", f"WITH {GRADED_SQL} SELECT ev_id, design, preprint, score, label FROM graded")
def grade_design(spark, sf):
    return _graded(spark, sf).select("ev_id", "design", "preprint", "score", "label")


READINGS = ("Randomized Controlled Trial", "meta-analysis (preprint)", "unknown", "gibberish", "Case-Control Study")


@query("article_design", f"""WITH {GRADED_SQL} SELECT ev_id, CASE ev_id % 5 WHEN 0 THEN 'rct' WHEN 1 THEN 'meta_analysis' WHEN 4 THEN 'case_control' ELSE design END AS design FROM graded""")
def article_design(spark, sf):
    """What a reader called a record in prose, where that names a design, else the record's own design."""
    read = F.element_at(F.array(*map(F.lit, READINGS)), (1 + F.col("ev_id") % len(READINGS)).cast("int"))
    text = D.scan_text(worded_title(), F.col("content"), F.col("snippet"))
    return evidence(spark, sf).select("ev_id", D.of_article(read, F.col("source_type"), F.col("publication_types"), text).alias("design"))


@query("evidence_profile", f"""WITH {GRADED_SQL} SELECT topic_id, label, count(*) AS n, CAST(sum(CASE WHEN reliability_tier = 1 AND NOT preprint THEN 1 ELSE 0 END) AS BIGINT) AS n_high, CAST(sum(CASE WHEN preprint THEN 1 ELSE 0 END) AS BIGINT) AS n_preprint FROM graded GROUP BY ALL""")
def evidence_profile(spark, sf):
    high = (F.col("reliability_tier") == 1) & ~F.col("preprint")
    return _graded(spark, sf).groupBy("topic_id", "label").agg(F.count("*").alias("n"), F.count_if(high).alias("n_high"), F.count_if("preprint").alias("n_preprint"))


#: Designs that make a body of evidence strong, unless they are preprints.
HIGH_TIER = ("meta_analysis", "systematic_review", "guideline", "rct")


@query("evidence_shares", f"""WITH {GRADED_SQL}, n AS (SELECT topic_id, coalesce(nullif(name, ''), 'unclassified') AS label, count(*) AS n, count(*) FILTER (design IN {HIGH_TIER} AND NOT preprint) AS high, count(*) FILTER (preprint) AS pre FROM (SELECT *, {_case('design', {k: v for k, (_, v) in D.DESIGNS.items()})} AS name FROM read) GROUP BY ALL)
    SELECT topic_id, label, n, round_even(sum(high) OVER t / sum(n) OVER t, 2) AS high_tier_share, round_even(sum(pre) OVER t / sum(n) OVER t, 2) AS preprint_share, CAST(row_number() OVER (PARTITION BY topic_id ORDER BY n DESC, label) AS INTEGER) AS place FROM n WINDOW t AS (PARTITION BY topic_id)""")
def evidence_shares(spark, sf):
    """Designs of a topic's records by how many there are, and the shares of strong designs and of preprints; a topic has few designs."""
    names = F.create_map(*(x for k, (_, v) in D.DESIGNS.items() for x in (F.lit(k), F.lit(v))))
    label = F.coalesce(F.nullif(names[F.col("design")], F.lit("")), F.lit("unclassified"))
    per = _graded(spark, sf).groupBy("topic_id", label.alias("label")).agg(F.count("*").alias("n"), F.count_if(F.col("design").isin(*HIGH_TIER) & ~F.col("preprint")).alias("high"), F.count_if("preprint").alias("pre"))
    topic = Window.partitionBy("topic_id")
    share = lambda c: F.bround(F.sum(c).over(topic) / F.sum("n").over(topic), 2)
    return per.select("topic_id", "label", "n", share("high").alias("high_tier_share"), share("pre").alias("preprint_share"), F.row_number().over(topic.orderBy(F.desc("n"), "label")).alias("place"))


SCORED_SQL = f"""{SIGNALS}, s AS (SELECT *, {CURVES_SQL} FROM signals)"""


@query("prior_shortlist", f"WITH {SCORED_SQL} SELECT topic_id, ev_id, score, rank FROM (SELECT *, CAST(row_number() OVER (PARTITION BY topic_id ORDER BY score DESC, arrival) AS INTEGER) AS rank FROM (SELECT *, round({S.weighted_sql(S.PRIOR_WEIGHTS)}, 6) AS score FROM s)) WHERE rank <= 36")
def prior_shortlist(spark, sf, max_sources: int = 15):
    rows = curves(signals(spark, sf)).withColumn("score", F.round(S.weighted(S.PRIOR_WEIGHTS), 6))
    return top_per_group(rows, ["topic_id"], [F.desc("score"), "arrival"], 2 * max_sources + 6).select("topic_id", "ev_id", "score", "rank")


FINAL_SQL = f"""{SCORED_SQL}, f AS (SELECT *, round({S.weighted_sql(S.FINAL_WEIGHTS)} - CASE WHEN source_type = 'wikipedia' THEN 0.25 ELSE 0 END, 6) AS score
    FROM (SELECT * REPLACE (CASE WHEN ev_id % 4 = 0 THEN 0.82 ELSE evidence END AS evidence) FROM s))"""


def _final(spark, sf):
    rows = curves(signals(spark, sf)).withColumn("own", F.when(F.col("ev_id") % 4 == 0, 0.82).otherwise(0.0))
    evidence_level = F.when(F.col("own") > 0, F.col("own")).otherwise(F.col("evidence"))
    penalty = F.when(F.col("source_type") == "wikipedia", 0.25).otherwise(0.0)
    return rows.withColumn("score", F.round(S.weighted(S.FINAL_WEIGHTS, {"evidence": evidence_level}) - penalty, 6))


@query("final_score", f"WITH {FINAL_SQL} SELECT topic_id, ev_id, score FROM f")
def final_score(spark, sf):
    return _final(spark, sf).select("topic_id", "ev_id", "score")


@query("pool_cut", f"""WITH {SCORED_SQL}, a AS (SELECT *, CAST(row_number() OVER (PARTITION BY topic_id ORDER BY round(citation + tier + evidence, 6) DESC, arrival) AS INTEGER) AS authority_rank FROM s),
    c AS (SELECT *, CAST(row_number() OVER (PARTITION BY topic_id ORDER BY cosine DESC, arrival) AS INTEGER) AS cosine_rank FROM a WHERE authority_rank <= 60) SELECT topic_id, ev_id, authority_rank, cosine_rank FROM c WHERE cosine_rank <= 30""")
def pool_cut(spark, sf):
    rows = curves(signals(spark, sf)).withColumn("authority", F.round(F.col("citation") + F.col("tier") + F.col("evidence"), 6))
    return R.pool_cut(rows, 60, 30).select("topic_id", "ev_id", "authority_rank", "cosine_rank")


@query("order_without_vectors", f"WITH {SIGNALS} SELECT topic_id, ev_id, CAST(row_number() OVER (PARTITION BY topic_id ORDER BY relevance DESC, reliability_tier, arrival) AS INTEGER) AS rank FROM signals")
def order_without_vectors(spark, sf):
    """A topic's order where nothing has a vector: by score, then tier, then arrival."""
    order = Window.partitionBy("topic_id").orderBy(F.desc("relevance"), "reliability_tier", "arrival")
    return signals(spark, sf).select("topic_id", "ev_id", F.row_number().over(order).alias("rank"))


@query("relevance_floor", f"""WITH {SIGNALS}, x AS (SELECT topic_id, ev_id, arrival, CASE WHEN topic_id % 3 = 0 THEN relevance * 0.4 ELSE relevance END AS relevance FROM signals),
    m AS (SELECT *, max(relevance) OVER (PARTITION BY topic_id) AS top, row_number() OVER (PARTITION BY topic_id ORDER BY relevance DESC, arrival) AS r FROM x)
    SELECT topic_id, ev_id, round(relevance, 6) AS relevance FROM m WHERE relevance >= 0.45 OR (top < 0.45 AND r = 1)""")
def relevance_floor(spark, sf):
    rows = signals(spark, sf).select("topic_id", "ev_id", "arrival", F.when(F.col("topic_id") % 3 == 0, F.col("relevance") * 0.4).otherwise(F.col("relevance")).alias("relevance"))
    return R.relevance_floor(rows).select("topic_id", "ev_id", F.round("relevance", 6).alias("relevance"))


@query("source_cap", f"""WITH {FINAL_SQL}, d AS (SELECT *, source_type = 'wikipedia' AND row_number() OVER (PARTITION BY topic_id, source_type ORDER BY score DESC, arrival) > 1 AS deferred FROM f)
    SELECT topic_id, ev_id, place FROM (SELECT *, CAST(row_number() OVER (PARTITION BY topic_id ORDER BY deferred, score DESC, arrival) AS INTEGER) AS place FROM d) WHERE place <= 80""")
def source_cap(spark, sf):
    return R.source_cap(_final(spark, sf), "wikipedia", 80, [F.desc("score"), "arrival"]).select("topic_id", "ev_id", "place")


@query("mmr_select")
def mmr_select(spark, sf):
    vectors = table(spark, sf, "embeddings").select(F.col("vec_id").alias("ev_id"), "embedding")
    rows = _final(spark, sf).select("topic_id", "ev_id", "arrival", "score").join(vectors, "ev_id", "left")
    return R.mmr(rows)


@query("mmr_first_two", f"""WITH {FINAL_SQL}, v AS (SELECT f.topic_id, f.ev_id, f.arrival, f.score, CAST(embedding AS DOUBLE[]) AS e FROM f LEFT JOIN embeddings ON vec_id = f.ev_id),
    one AS (SELECT *, row_number() OVER (PARTITION BY topic_id ORDER BY score DESC, arrival) AS r FROM v), short AS (SELECT * FROM one WHERE r <= 66), top AS (SELECT topic_id, ev_id, e FROM one WHERE r = 1),
    two AS (SELECT s.topic_id, s.ev_id, s.arrival, round(CASE WHEN s.e IS NULL THEN s.score ELSE 0.72 * s.score - 0.28 * greatest(0, coalesce(list_dot_product(s.e, t.e) / (sqrt(list_dot_product(s.e, s.e)) * sqrt(list_dot_product(t.e, t.e))), 0)) END, 6) AS value
        FROM short s JOIN top t ON s.topic_id = t.topic_id AND s.ev_id <> t.ev_id)
    SELECT topic_id, first, second FROM (SELECT topic_id, t.ev_id AS first, w.ev_id AS second, row_number() OVER (PARTITION BY topic_id ORDER BY value DESC, w.arrival) AS r FROM two w JOIN top t USING (topic_id)) WHERE r = 1""")
def mmr_first_two(spark, sf):
    """The first two picks of ``mmr`` in native functions, for SQL to check."""
    vectors = table(spark, sf, "embeddings").select(F.col("vec_id").alias("ev_id"), F.transform("embedding", lambda x: x.cast("double")).alias("e"))
    rows = _final(spark, sf).select("topic_id", "ev_id", "arrival", "score").join(vectors, "ev_id", "left")
    short = top_per_group(rows, ["topic_id"], [F.desc("score"), "arrival"], 66, "r")
    top = short.filter("r = 1").select("topic_id", F.col("ev_id").alias("first"), F.col("e").alias("first_e"))
    near = F.coalesce(dot(F.col("e"), F.col("first_e")) / (F.sqrt(dot(F.col("e"), F.col("e"))) * F.sqrt(dot(F.col("first_e"), F.col("first_e")))), F.lit(0.0))
    value = F.when(F.col("e").isNull(), F.col("score")).otherwise(0.72 * F.col("score") - 0.28 * F.greatest(F.lit(0.0), near))
    rest = short.filter("r > 1").join(top, "topic_id").withColumn("value", F.round(value, 6))
    return top_per_group(rest, ["topic_id"], [F.desc("value"), "arrival"], 1, "n").select("topic_id", "first", F.col("ev_id").alias("second"))


#: Classes of studies by their words, the best first.
STUDY_SQL = """CASE WHEN contains(low, 'systematic review') OR contains(low, 'meta-analys') THEN 0 WHEN contains(low, 'randomized controlled') OR contains(low, 'rct') THEN 1 WHEN contains(low, 'guideline') OR contains(low, 'practice recommendation') THEN 2
    WHEN contains(low, 'cohort') OR contains(low, 'prospective') THEN 3 WHEN contains(low, 'review') THEN 4 ELSE 5 END"""


@query("rule_priority", f"""WITH {EVIDENCE}, t AS (SELECT topic_id, ev_id, arrival, lower(title || ' ' || {list(WORDINGS)}[1 + ev_id % {len(WORDINGS)}]) AS low FROM evidence)
    SELECT topic_id, ev_id, quality, CAST(row_number() OVER (PARTITION BY topic_id ORDER BY quality, arrival) AS INTEGER) AS place FROM (SELECT *, {STUDY_SQL} AS quality FROM t)""")
def rule_priority(spark, sf):
    low, rule = F.lower(worded_title()), F.lit(5)
    #: What makes a record of each class, the best class first.
    classes = (("systematic review", "meta-analys"), ("randomized controlled", "rct"), ("guideline", "practice recommendation"), ("cohort", "prospective"), ("review",))
    for k, words in reversed(list(enumerate(classes))):
        found = F.lit(False)
        for w in words:
            found = found | F.contains(F.col("low"), F.lit(w))
        rule = F.when(found, k).otherwise(rule)
    rows = evidence(spark, sf).select("topic_id", "ev_id", "arrival", low.alias("low")).withColumn("quality", rule)
    return top_per_group(rows, ["topic_id"], ["quality", "arrival"], 1 << 30, "place").select("topic_id", "ev_id", "quality", "place")


@query("tier_gate", f"""WITH {EVIDENCE}, h AS (SELECT topic_id, ev_id, ev_id % 4 + 1 AS tier_no, source_type IN ('pubmed', 'europe_pmc', 'biorxiv', 'clinicaltrials') AND citation_count % 9 = 0 AS usable FROM evidence),
    n AS (SELECT topic_id, tier_no, count(*) FILTER (usable) AS n FROM h GROUP BY ALL), b AS (SELECT *, coalesce(sum(n) OVER (PARTITION BY topic_id ORDER BY tier_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM n)
    SELECT topic_id, ev_id, tier_no FROM h JOIN b USING (topic_id, tier_no) WHERE before < 3""")
def tier_gate(spark, sf):
    usable = F.col("source_type").isin("pubmed", "europe_pmc", "biorxiv", "clinicaltrials") & (F.col("citation_count") % 9 == 0)
    return R.tier_gate(evidence(spark, sf).select("topic_id", "ev_id", (F.col("ev_id") % 4 + 1).alias("tier_no"), usable.alias("usable"))).select("topic_id", "ev_id", "tier_no")


@query("round_saturation", f"""WITH {SIGNALS}, x AS (SELECT topic_id, ev_id % 5 + 1 AS round, (ev_id * 7) % 41 AS key, cosine FROM signals), f AS (SELECT topic_id, key, min(round) AS round, bool_or(cosine >= 0.3) AS relevant FROM x GROUP BY ALL),
    n AS (SELECT topic_id, round, (SELECT count(*) FROM f WHERE f.topic_id = d.topic_id AND f.round = d.round AND relevant) AS n_new FROM (SELECT DISTINCT topic_id, round FROM x) d)
    SELECT topic_id, round, n_new, NOT coalesce(bool_or(round > 1 AND n_new < 3) OVER (PARTITION BY topic_id ORDER BY round ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS kept FROM n""")
def round_saturation(spark, sf):
    rows = signals(spark, sf).select("topic_id", (F.col("ev_id") % 5 + 1).alias("round"), ((F.col("ev_id") * 7) % 41).alias("key"), "cosine")
    return R.round_saturation(rows)


@query("slot_merge", f"""WITH {EVIDENCE}, x AS (SELECT topic_id, ev_id % 3 + 1 AS list_no, ev_id AS rank, 'k' || ((ev_id * 13) % 37) AS key, topic_id % 2 = 0 AS review FROM evidence),
    b0 AS (SELECT topic_id, key, min({{'l': list_no, 'r': rank}}) AS a, bool_or(review) AS review FROM x WHERE list_no < 3 GROUP BY ALL), b1 AS (SELECT *, row_number() OVER (PARTITION BY topic_id ORDER BY a) AS n FROM b0),
    b AS (SELECT *, count(*) OVER (PARTITION BY topic_id) AS m FROM b1 WHERE n <= 20), g AS (SELECT topic_id, key, 0 AS l, n AS r FROM b WHERE n <= m - greatest(0, CASE WHEN review THEN 6 ELSE 0 END - (20 - m))),
    c AS (SELECT topic_id, key, 1 AS l, min(rank) AS r FROM x WHERE list_no = 3 AND NOT EXISTS (SELECT 1 FROM g WHERE g.topic_id = x.topic_id AND g.key = x.key) GROUP BY ALL)
    SELECT topic_id, key, place FROM (SELECT *, CAST(row_number() OVER (PARTITION BY topic_id ORDER BY l, r, key) AS INTEGER) AS place FROM (SELECT * FROM g UNION ALL SELECT * FROM c)) WHERE place <= 20""")
def slot_merge(spark, sf):
    rows = evidence(spark, sf).select("topic_id", (F.col("ev_id") % 3 + 1).alias("list_no"), F.col("ev_id").alias("rank"), F.concat(F.lit("k"), ((F.col("ev_id") * 13) % 37).cast("string")).alias("key"), (F.col("topic_id") % 2 == 0).alias("review"))
    return R.slot_merge(rows, 20)


EDGES_SQL = "edges AS (SELECT DISTINCT a.l_partkey AS src, b.l_partkey AS dst, CASE WHEN a.l_linenumber < b.l_linenumber THEN 'references' ELSE 'citations' END AS kind FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_linenumber <> b.l_linenumber)"


def edges(spark, sf, sources=None):
    """Parts of one order are neighbours; an order has at most 13 lines. With ``sources`` (a column ``id``), edges from these parts alone: pairs are made only of
    orders that hold one, from their lines."""
    lines = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    begun = lines
    if sources is not None:
        begun = lines.join(broadcast_if_small(sources.select(F.col("id").alias("l_partkey")).distinct(), 1_000_000), "l_partkey", "left_semi")
        lines = lines.join(broadcast_if_small(begun.select("l_orderkey").distinct(), 1_000_000), "l_orderkey", "left_semi")
    if sources is None:
        grouped = lines.groupBy("l_orderkey").agg(F.collect_list(F.struct("l_linenumber", "l_partkey")).alias("ls"))
        pairs = grouped.select("ls", F.explode("ls").alias("a")).select("a", F.explode("ls").alias("b"))
    else:
        one = lambda df, name: df.select("l_orderkey", F.struct("l_linenumber", "l_partkey").alias(name))
        pairs = one(begun, "a").join(one(lines, "b"), "l_orderkey")
    kind = F.when(F.col("a.l_linenumber") < F.col("b.l_linenumber"), "references").otherwise("citations")
    return pairs.filter("a.l_linenumber <> b.l_linenumber").select(F.col("a.l_partkey").alias("src"), F.col("b.l_partkey").alias("dst"), kind.alias("kind")).distinct()


@query("citation_expand", f"""WITH {EDGES_SQL}, seeds AS (SELECT p_partkey AS id FROM part WHERE p_size % 10 = 0),
    n AS (SELECT *, CAST(row_number() OVER (PARTITION BY src, kind ORDER BY dst) AS INTEGER) AS n FROM edges WHERE src IN (SELECT id FROM seeds) AND src <> dst) SELECT src, kind, dst, n FROM n WHERE n <= 6 AND dst NOT IN (SELECT id FROM seeds)""")
def citation_expand(spark, sf):
    seeds = table(spark, sf, "part").filter("p_size % 10 = 0").select(F.col("p_partkey").alias("id"))
    return R.citation_expand(edges(spark, sf, seeds), seeds)


_SEEDABLE_SQL = f"source_type IN {R.PAPER_PROVIDERS} AND {PAPER_SQL.format('url')} IS NOT NULL"


@query("seedable_papers", f"WITH {EVIDENCE} SELECT ev_id, {_SEEDABLE_SQL} AS seedable FROM evidence")
def seedable_papers(spark, sf):
    """Papers that a citation graph can know, by provider and url."""
    return evidence(spark, sf).select("ev_id", R.seedable(F.col("url"), F.col("source_type")).alias("seedable"))


SEEDS_SQL = f"""{SIGNALS}, pool AS (SELECT topic_id, ev_id, arrival, source_type, cosine * CASE WHEN topic_id % 4 = 3 THEN 0.2 ELSE 1 END AS cosine FROM signals),
    near AS (SELECT *, row_number() OVER (PARTITION BY topic_id ORDER BY cosine DESC, arrival) AS seed_rank, max(cosine) OVER (PARTITION BY topic_id) AS best FROM pool),
    seeds AS (SELECT topic_id, ev_id, seed_rank, url, source_type FROM near JOIN (SELECT ev_id, url FROM evidence) USING (ev_id) WHERE seed_rank <= 4 AND (cosine >= 0.3 OR best < 0.3))"""

#: Kinds of edges, in the order in which their finds count.
EDGE_KINDS = ("recommendations", "references", "citations", "related")
CITED_SQL = f"""{SEEDS_SQL}, {EDGES_SQL}, pairs AS (SELECT DISTINCT src, dst FROM edges WHERE src <> dst), kinds AS (SELECT src, dst, kind FROM edges WHERE src <> dst UNION ALL SELECT src, dst, 'recommendations' FROM pairs WHERE (src + dst) % 5 = 0 UNION ALL SELECT src, dst, 'related' FROM pairs WHERE (src + dst) % 3 = 0),
    followed AS (SELECT topic_id, ev_id AS src, seed_rank, {DOI_SQL.format('url')} IS NOT NULL AS has_doi FROM seeds WHERE {_SEEDABLE_SQL}),
    lead AS (SELECT topic_id, min(seed_rank) AS lead_rank FROM followed WHERE has_doi GROUP BY topic_id),
    met AS (SELECT f.topic_id, f.src, f.seed_rank, kind, list_position({list(EDGE_KINDS)}, kind) AS kind_no, dst, lower(regexp_replace(url, '/+$', '')) AS key FROM followed f JOIN kinds USING (src) JOIN (SELECT ev_id, url FROM evidence) e ON e.ev_id = dst LEFT JOIN lead USING (topic_id) WHERE kind <> 'related' OR seed_rank = lead_rank),
    cut AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY topic_id, src, kind ORDER BY dst) AS n FROM met) WHERE n <= 6),
    fresh AS (SELECT *, row_number() OVER (PARTITION BY topic_id, key ORDER BY seed_rank, kind_no, n) AS again FROM cut c WHERE NOT EXISTS (SELECT 1 FROM seeds s WHERE s.topic_id = c.topic_id AND lower(regexp_replace(s.url, '/+$', '')) = c.key))"""


@query("expand_from_seeds", f"WITH {CITED_SQL} SELECT topic_id, src AS seed, kind, dst AS ev_id, CAST(row_number() OVER (PARTITION BY topic_id ORDER BY seed_rank, kind_no, n) AS INTEGER) AS place FROM fresh WHERE again = 1")
def expand_from_seeds(spark, sf):
    """Records that each topic gains from its nearest papers: recommended, cited by them, citing them, related to the first with a DOI."""
    records = evidence(spark, sf).select("ev_id", "url")
    far = F.col("cosine") * F.when(F.col("topic_id") % 4 == 3, 0.2).otherwise(1.0)
    pool = signals(spark, sf).select("topic_id", "ev_id", "arrival", "source_type", far.alias("cosine"))
    chosen = materialise(R.choose_seeds(pool), "seeds")
    seeds = materialise(chosen.join(records.join(broadcast_if_small(chosen.select("ev_id").distinct(), 1_000_000), "ev_id", "left_semi"), "ev_id"), "seeds")
    cites = materialise(edges(spark, sf, seeds.select(F.col("ev_id").alias("id"))).filter("src <> dst"), "cites")
    records = records.join(broadcast_if_small(cites.select(F.col("dst").alias("ev_id")).distinct(), 1_000_000), "ev_id", "left_semi")
    pairs, s = cites.select("src", "dst").distinct(), F.col("src") + F.col("dst")
    drawn = pairs.withColumn("kind", F.explode(F.array_compact(F.array(F.when(s % 5 == 0, "recommendations"), F.when(s % 3 == 0, "related")))))
    kinds = cites.select("src", "dst", "kind").unionByName(drawn).withColumn("kind_no", F.array_position(F.array(*map(F.lit, EDGE_KINDS)), F.col("kind")))
    return R.expand_seeds(seeds, kinds, records)


#: Neighbours of a record that a hop follows, and records of a hop that a topic keeps.
PER_RECORD, PER_HOP = 3, 40


def _hops_sql(hops: int, cut: bool = True) -> str:
    """Hop by hop, as each leaves out what all before it have reached; without ``cut`` it keeps all it reaches."""
    ctes = ["h0 AS (SELECT DISTINCT topic_id, ev_id AS id, 0 AS hop, CAST(NULL AS BIGINT) AS parent FROM seeds)"]
    for k in range(1, hops + 1):
        before = " UNION ALL ".join(f"SELECT topic_id, id FROM h{j}" for j in range(k))
        met = f"m{k} AS (SELECT h.topic_id, p.src, p.dst FROM h{k - 1} h JOIN hop_pairs p ON p.src = h.id WHERE NOT EXISTS (SELECT 1 FROM ({before}) b WHERE b.topic_id = h.topic_id AND b.id = p.dst))"
        if not cut:
            ctes.append(f"{met}, h{k} AS (SELECT topic_id, dst AS id, {k} AS hop, min(src) AS parent FROM m{k} GROUP BY ALL)")
            continue
        ctes.append(f"""{met},
            c{k} AS (SELECT topic_id, dst AS id, min(src) AS parent FROM (SELECT *, row_number() OVER (PARTITION BY topic_id, src ORDER BY dst) AS n FROM m{k}) WHERE n <= {PER_RECORD} GROUP BY ALL),
            h{k} AS (SELECT topic_id, id, {k} AS hop, parent FROM (SELECT *, row_number() OVER (PARTITION BY topic_id ORDER BY id) AS n FROM c{k}) WHERE n <= {PER_HOP})""")
    union = " UNION ALL ".join(f"SELECT * FROM h{k}" for k in range(hops + 1))
    return f"WITH {SEEDS_SQL}, {EDGES_SQL}, hop_pairs AS (SELECT DISTINCT src, dst FROM edges WHERE src <> dst), {', '.join(ctes)} {union}"


def _hops(spark, sf, hops, per_record: int | None = PER_RECORD, per_hop: int | None = PER_HOP):
    far = F.col("cosine") * F.when(F.col("topic_id") % 4 == 3, 0.2).otherwise(1.0)
    seeds = R.choose_seeds(signals(spark, sf).select("topic_id", "ev_id", "arrival", far.alias("cosine"))).select("topic_id", F.col("ev_id").alias("id"))
    return expand_hops(lambda ids: edges(spark, sf, ids), seeds, hops, per_record, per_hop)


@query("two_hops", _hops_sql(2))
def two_hops(spark, sf):
    """Records within two citations of a topic's nearest, with the hop and the record that led there."""
    return _hops(spark, sf, 2)


@query("three_hops", _hops_sql(3))
def three_hops(spark, sf):
    return _hops(spark, sf, 3)


@query("three_hops_whole", _hops_sql(3, cut=False))
def three_hops_whole(spark, sf):
    """All records within three citations of a topic's nearest: ``three_hops`` without its cuts by record and by hop."""
    return _hops(spark, sf, 3, per_record=None, per_hop=None)


@query("newest_per_group", """WITH g AS (SELECT user_id, event_type, min(event_id) AS first FROM events GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY first) AS g FROM g),
    e AS (SELECT e.user_id, e.event_type, event_id, row_number() OVER (PARTITION BY e.user_id, e.event_type ORDER BY ts DESC, event_id) AS n FROM events e JOIN r ON r.user_id = e.user_id AND r.event_type = e.event_type WHERE g <= 3) SELECT user_id, event_type, event_id, CAST(n AS INTEGER) AS n FROM e WHERE n <= 2""")
def newest_per_group(spark, sf):
    """The newest two points of the first three groups of each user, groups by first appearance."""
    events = table(spark, sf, "events")
    firsts = events.groupBy("user_id", "event_type").agg(F.min("event_id").alias("first"))
    groups = top_per_group(firsts, ["user_id"], ["first"], 3, "g").select("user_id", "event_type")
    return top_per_group(events.join(groups, ["user_id", "event_type"]), ["user_id", "event_type"], [F.desc("ts"), "event_id"], 2, "n").select("user_id", "event_type", "event_id", "n")


@query("top_terms", "SELECT event_type AS term, count(*) AS n, CAST(row_number() OVER (ORDER BY count(*) DESC, event_type) AS INTEGER) AS rank FROM events GROUP BY event_type ORDER BY rank LIMIT 20")
def top_terms(spark, sf):
    counts = table(spark, sf, "events").groupBy(F.col("event_type").alias("term")).agg(F.count("*").alias("n"))
    ranked = counts.orderBy(F.desc("n"), "term").limit(20).groupBy().agg(F.sort_array(F.collect_list(F.struct((-F.col("n")).alias("m"), "term"))).alias("all"))
    return ranked.select(F.posexplode("all").alias("at", "x")).select(F.col("x.term").alias("term"), (-F.col("x.m")).alias("n"), (F.col("at") + 1).cast("int").alias("rank"))


#: Providers by the type of a topic, literature that every medical topic gets, and the words that open a gated provider.
TYPE_PROVIDERS = {
    "contraindication": ("openfda", "dailymed", "rxnav"), "drug_interaction": ("openfda", "dailymed", "rxnav"), "dosage": ("dailymed", "ema"), "drug": ("dailymed", "ema"), "drug_classification": ("ema", "rxnav"),
    "adverse_effect": ("openfda", "dailymed"), "mechanism_of_action": ("open_targets", "chembl"), "epidemiology": ("who_gho",), "statistic": ("who_gho",),
}
LITERATURE = ("pubmed", "europe_pmc", "clinicaltrials")
GATES = {
    "who_gho": (
        "prevalence", "prevalent", "incidence", "mortality", "morbidity", "epidemiology", "epidemiological", "how common", "how widespread", "how many people", "frequency of", "number of cases", "per 100,000", "per capita", "global burden", "death rate", "case rate",
        "prevalenza", "incidenza", "mortalità", "diffusione", "quanto è comune", "quanto è diffus", "quante persone", "colpisce quante persone", "tasso di incidenza", "tasso di mortalità",
    ),
    "ema": (
        "approv", "authoriz", "authoris", "regulatory", "marketing authorisation", "marketing authorization", "label", "ema", "european medicines agency", "withdrawn", "recall", "epar", "centrally authorised", "orphan drug", "orphan medicine", "biosimilar",
        "conditional marketing", "revoked", "suspended marketing", "autorizzazione", "approvazione", "immissione in commercio", "farmaco orfano",
    ),
    "openfda": (
        "side effect", "side-effect", "adverse event", "adverse effect", "adverse reaction", "safety signal", "black box", "boxed warning", "recall", "faers", "reported cases of", "case reports of",
        "effetto collaterale", "effetti collaterali", "evento avverso", "eventi avversi", "reazione avversa", "reazioni avverse",
    ),
    "rxnav": (
        "interact", "interaction", "contraindicat", "combined with", "co-administer", "coadminister", "concomitant", "taken with", "drug class", "classified as", "classification of", "interazione", "controindicat", "somministrato insieme", "classe farmacologica", "classificazione",
    ),
}
GATE_NEEDS_SUBJECT = ("ema", "openfda", "rxnav")
_PROVIDER_LIST = list(PROVIDERS)


@query("provider_routing", f"""WITH t AS (SELECT item_id AS topic_id, {list(TYPE_PROVIDERS)}[1 + item_id % 9] AS topic_type, item_id % 7 = 6 AS other, lower(text) || CASE item_id % 4 WHEN 0 THEN ' prevalence and label' WHEN 1 THEN ' side effect recall' WHEN 2 THEN ' they interact' ELSE '' END AS text,
    CASE WHEN item_id % 5 = 0 THEN '' ELSE 'x' END AS subject, CASE WHEN item_id % 3 = 0 THEN ['biorxiv', 'wikipedia', 'nowhere'] ELSE ['ema'] END AS brief FROM benchmark),
    c AS (SELECT *, CASE WHEN other THEN brief || ['wikipedia'] ELSE {list(LITERATURE)} || list_filter(brief, lambda p: p <> 'wikipedia') || CASE topic_type {' '.join(f"WHEN '{k}' THEN {list(v)}" for k, v in TYPE_PROVIDERS.items())} END END AS chosen FROM t)
    SELECT topic_id, array_to_string(list_filter({_PROVIDER_LIST}, lambda p: list_contains(chosen, p) AND (other OR {' AND '.join(f"(p <> '{g}' OR ({' OR '.join(f'''contains(text, '{w}')''' for w in words)}){' AND subject <> ' + chr(39) * 2 if g in GATE_NEEDS_SUBJECT else ''})" for g, words in GATES.items())})), ',') AS providers FROM c""")
def provider_routing(spark, sf):
    """Providers of every topic by rules: literature, the topic's type and the brief, without gated providers whose words are missing."""
    k = F.col("item_id")
    tail = F.when(k % 4 == 0, " prevalence and label").when(k % 4 == 1, " side effect recall").when(k % 4 == 2, " they interact").otherwise("")
    t = table(spark, sf, "benchmark").select(
        k.alias("topic_id"), F.element_at(F.array(*map(F.lit, TYPE_PROVIDERS)), (1 + k % 9).cast("int")).alias("topic_type"), (k % 7 == 6).alias("other"), F.concat(F.lower("text"), tail).alias("text"),
        F.when(k % 5 == 0, "").otherwise("x").alias("subject"), F.when(k % 3 == 0, F.array(*map(F.lit, ("biorxiv", "wikipedia", "nowhere")))).otherwise(F.array(F.lit("ema"))).alias("brief"),
    )
    lists = F.create_map(*(x for name, ps in TYPE_PROVIDERS.items() for x in (F.lit(name), F.array(*map(F.lit, ps)))))
    medical = F.concat(F.array(*map(F.lit, LITERATURE)), F.filter("brief", lambda p: p != "wikipedia"), lists[F.col("topic_type")])
    chosen = F.when(F.col("other"), F.concat("brief", F.array(F.lit("wikipedia")))).otherwise(medical)

    def opened(p):
        ok = F.lit(True)
        for gate, words in GATES.items():
            said = F.exists(F.array(*map(F.lit, words)), lambda w: F.contains(F.col("text"), w))
            ok = ok & ((p != gate) | (said & (F.col("subject") != "") if gate in GATE_NEEDS_SUBJECT else said))
        return ok

    every = F.array(*map(F.lit, PROVIDERS))
    return t.withColumn("chosen", chosen).select("topic_id", F.array_join(F.filter(every, lambda p: F.array_contains("chosen", p) & (F.col("other") | opened(p))), ",").alias("providers"))


@query("register_match", """WITH q AS (SELECT item_id, list_filter(string_split(lower(text), ' '), lambda w: length(w) >= 2)[1:3] AS terms FROM benchmark), p AS (SELECT p_partkey, lower(p_name) AS name, string_split(lower(p_name), ' ') AS words, lower(p_type) AS kind, lower(p_brand) AS brand, p_size % 2 = 0 AS authorised FROM part),
    s AS (SELECT p_partkey, t.term, CASE WHEN name = term THEN 6.0 WHEN len(list_filter(words, lambda w: starts_with(w, term))) > 0 THEN 3.0 ELSE 0 END + CASE WHEN starts_with(kind, term) THEN 4.0 ELSE 0 END + CASE WHEN starts_with(brand, term) THEN 1.5 ELSE 0 END AS score, authorised
        FROM p, (SELECT DISTINCT substr(p_name, 1, 3) AS term FROM part WHERE p_partkey % 50 = 0) t) SELECT p_partkey, lower(term) AS term, CAST(score * CASE WHEN authorised THEN 1 ELSE 0.6 END AS DOUBLE) AS score FROM s WHERE score * CASE WHEN authorised THEN 1 ELSE 0.6 END >= 0.4""")
def register_match(spark, sf):
    """Weighted field match by left-anchored word prefixes: prefixes of register words meet the terms by equality."""
    part = table(spark, sf, "part")
    terms = part.filter("p_partkey % 50 = 0").select(F.substring("p_name", 1, 3).alias("term")).distinct()
    fields = part.select(
        "p_partkey", (F.col("p_size") % 2 == 0).alias("authorised"),
        F.explode(F.array(*(F.struct(F.lit(f).alias("field"), F.lower(c).alias("value")) for f, c in (("name", F.col("p_name")), ("kind", F.col("p_type")), ("brand", F.col("p_brand")))))).alias("x"),
    ).select("p_partkey", "authorised", "x.*")
    words = F.when(F.col("field") == "name", F.split("value", " ")).otherwise(F.array("value"))
    prefixes = fields.select("p_partkey", "authorised", "field", "value", F.explode(words).alias("word")).select("*", F.explode(F.transform(F.sequence(F.lit(1), F.least(F.length("word"), F.lit(12))), lambda n: F.substring("word", 1, n))).alias("term"))
    met = prefixes.join(broadcast_if_small(terms, 100_000), "term").groupBy("p_partkey", "authorised", "term", "field").agg(F.max(F.col("value") == F.col("term")).alias("whole"))
    weight = F.when(F.col("field") == "kind", 4.0).when(F.col("field") == "brand", 1.5).when(F.col("whole"), 6.0).otherwise(3.0)
    total = met.groupBy("p_partkey", "authorised", "term").agg(F.sum(weight).alias("s"))
    return total.select("p_partkey", "term", F.when(F.col("authorised"), F.col("s")).otherwise(F.col("s") * 0.6).alias("score")).filter("score >= 0.4")


REGISTER_SQL = rf"""{EVIDENCE}, register AS (SELECT ev_id AS id, split_part(title, ' ', 1) AS name, split_part(title, ' ', 2) || '-' || split_part(title, ' ', 3) AS substance, 'L' || lpad((ev_id % 100)::VARCHAR, 2, '0') || 'AC07' AS code, substr(title, 20) AS area, snippet AS indication,
        ev_id % 4 <> 0 AS authorised, ev_id % 3 = 0 AS reference, nullif(publication_date, '') AS updated FROM evidence),
    asked AS (SELECT item_id AS query_id, list_filter(regexp_extract_all(lower(substr(text, 1, 60) || ' L' || lpad((item_id % 100)::VARCHAR, 2, '0')), '[a-z0-9]+'), lambda w: length(w) >= 3 AND NOT list_contains({list(G.REGISTER_STOPWORDS)}, w)) AS t FROM benchmark),
    one AS (SELECT query_id, len(t) AS n, unnest(t) AS term FROM asked), terms AS (SELECT query_id, n, term, count(*) AS times FROM one GROUP BY ALL), wanted AS (SELECT DISTINCT term FROM terms),
    words AS (SELECT DISTINCT id, weight, unnest(string_split_regex(lower(value), '{G.WORD_BREAK}')) AS word FROM (SELECT id, unnest([{', '.join(f"{{'weight': {w}::DOUBLE, 'value': {f}}}" for f, w in G.FIELD_WEIGHTS.items())}], recursive := true) FROM register)),
    hits AS (SELECT DISTINCT id, weight, term FROM (SELECT DISTINCT word, term FROM (SELECT DISTINCT word FROM words) v JOIN wanted ON substr(word, 1, 3) = substr(term, 1, 3) AND starts_with(word, term)) JOIN words USING (word)
        UNION ALL SELECT id, {G.WHOLE_NAME} - 3.0, term FROM register JOIN wanted ON lower(name) = term UNION ALL SELECT id, {G.CODE}, term FROM wanted JOIN register ON contains(lower(code), term) WHERE regexp_full_match(term, '{G.CODE_PATTERN}')),
    scored AS (SELECT query_id, id, sum(weight * times)::DOUBLE / n * CASE WHEN authorised THEN 1.0 ELSE {G.UNAUTHORISED} END::DOUBLE AS score, authorised, reference, updated FROM hits JOIN terms USING (term) JOIN register USING (id) GROUP BY query_id, id, n, authorised, reference, updated)"""


@query("register_search", f"WITH {REGISTER_SQL} SELECT query_id, id, score, CAST(place AS INTEGER) AS place FROM (SELECT query_id, id, round(score, 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 6) DESC, authorised DESC, reference DESC, updated DESC NULLS LAST, id) AS place FROM scored WHERE score >= {G.FLOOR}) WHERE place <= 3")
def register_search(spark, sf):
    """The three best records of a register for each benchmark item and a code, by all the fields' weights."""
    word = lambda k: F.split_part("title", F.lit(" "), F.lit(k))
    code = lambda c: F.concat(F.lit("L"), F.lpad((c % 100).cast("string"), 2, "0"))
    k = F.col("ev_id")
    register = evidence(spark, sf).select(
        k.alias("id"), word(1).alias("name"), F.concat(word(2), F.lit("-"), word(3)).alias("substance"), F.concat(code(k), F.lit("AC07")).alias("code"), F.substring("title", 20, 200).alias("area"), F.col("snippet").alias("indication"),
        (k % 4 != 0).alias("authorised"), (k % 3 == 0).alias("reference"), F.nullif("publication_date", F.lit("")).alias("updated"))
    asked = table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), F.concat(F.substring("text", 1, 60), F.lit(" "), code(F.col("item_id"))).alias("text"))
    return G.register_search(asked, register)


#: Texts of trials in each state; the scores of results, status, phase and enrolment below are fixed values.
TRIAL_WORDS = ("Completed, has posted results. Phase 3. Enrollment: 1500", "Active. phase4 Enrollment: 150", "Recruiting phase 2 Enrollment: 20", "withdrawn", "completed phase 3 and phase 4")


@query("trial_priority", f"""WITH {EVIDENCE}, t AS (SELECT topic_id, ev_id, arrival, {list(TRIAL_WORDS)}[1 + ev_id % 5] AS c FROM evidence), s AS (SELECT *, CASE WHEN contains(lower(c), 'has posted results') THEN 100 ELSE 0 END + CASE WHEN contains(lower(c), 'completed') THEN 50 WHEN contains(lower(c), 'active') THEN 30 WHEN contains(lower(c), 'recruiting') THEN 20 ELSE 0 END
    + CASE WHEN regexp_matches(lower(c), 'phase ?3') THEN 15 WHEN regexp_matches(lower(c), 'phase ?4') THEN 12 WHEN regexp_matches(lower(c), 'phase ?2') THEN 8 ELSE 0 END + CASE WHEN n > 1000 THEN 20 WHEN n > 100 THEN 10 ELSE 0 END AS score FROM (SELECT *, coalesce(TRY_CAST(regexp_extract(c, 'Enrollment: (\\d+)', 1) AS BIGINT), 0) AS n FROM t))
    SELECT topic_id, ev_id, score, CAST(r AS INTEGER) AS place FROM (SELECT *, row_number() OVER (PARTITION BY topic_id ORDER BY score DESC, arrival) AS r FROM s) WHERE r <= 20""")
def trial_priority(spark, sf):
    """The first twenty trials of a topic by results, status, phase and enrolment, as their text states them."""
    rows = evidence(spark, sf).select("topic_id", "ev_id", "arrival", F.element_at(F.array(*map(F.lit, TRIAL_WORDS)), (1 + F.col("ev_id") % 5).cast("int")).alias("c"))
    score = D.trial_score(F.col("c"))
    return top_per_group(rows.withColumn("score", score), ["topic_id"], [F.desc("score"), "arrival"], 20, "place").select("topic_id", "ev_id", "score", "place")
