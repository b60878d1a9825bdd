"""The candidate pool of every topic, with the signals that the library's own operators give it."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions import design as D
from quarry.functions.text import tokenize, url_key
from quarry.operators import retrieve
from quarry.operators.index import Index, build_index, search_index, term_weights
from quarry.plans.retrieval import BM25_SQL, WINDOW, topics
from quarry.sources.tables import EVIDENCE, evidence, table
from quarry.storage import broadcast_if_small, materialise, written_once

#: Hits of a provider that a topic's pool takes, and leading hits whose vectors stand for the topic.
HITS, LEADERS = 14, 3


def window_text(window: int | None = WINDOW) -> Column:
    """What lexical scores look at: the first ``window`` characters of a record, or with None its whole text."""
    return retrieve.document_text(F.col("title"), F.col("content"), F.col("snippet"), window)


def pool_index(records: DataFrame) -> Index:
    """An index of the records' windows in which no block holds two providers."""
    return build_index(records.select("ev_id", "source_type", window_text().alias("doc_text")), part="source_type")


def topic_vectors(hits: DataFrame, vectors: DataFrame, leaders: int = LEADERS) -> DataFrame:
    """topic_id, centre: the mean vector of a topic's ``leaders`` best hits that have one, component by component."""
    best = retrieve.top_per_group(hits.join(vectors, "id"), ["topic_id"], [F.desc("score"), "id"], leaders, "lead")
    parts = best.select("topic_id", F.posexplode("v").alias("at", "x")).groupBy("topic_id", "at").agg(F.avg("x").alias("x"))
    return parts.groupBy("topic_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("at", "x"))), lambda p: p["x"]).alias("centre"))


def covered(hits: DataFrame, records: DataFrame, terms: DataFrame) -> DataFrame:
    """topic_id, id, kind, n, weight: how many ``terms`` (topic_id, kind, term, idf) of its topic a hit's window holds, and their weight.

    ``records`` are those of the hits, whose windows are split once; hits meet their terms by equality.
    """
    windows = records.select(F.col("ev_id").alias("id"), F.explode(F.array_distinct(tokenize(window_text()))).alias("term"))
    held = windows.join(broadcast_if_small(terms.select("term").distinct(), 1_000_000), "term", "left_semi")
    met = hits.select("topic_id", "id").join(held, "id").join(broadcast_if_small(terms, 1_000_000), ["topic_id", "term"])
    return met.groupBy("topic_id", "id", "kind").agg(F.count("*").alias("n"), F.sum("idf").alias("weight"))


def signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``build_signals`` as a table that a session writes once for each folder of tables, since many queries begin with it."""
    folder = hashlib.sha256(sf_dir.encode()).hexdigest()[:16]
    return written_once(spark, f"signals-{folder}", lambda: build_signals(spark, sf_dir))


def build_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A wide row for each candidate of a topic: the best HITS records of every provider for its terms, with what ranks them.

    * bm25: BM25 over the topic's best. rrf: reciprocal rank fusion of the providers' lists on the records' urls, over the topic's best.
    * cosine: of the record's vector with the mean vector of the topic's leading hits; 0 without a vector.
    * evidence: the grade of the record's design.
    * concept: share of the topic's first three terms that the window holds. offtopic: of the next topic's first terms, those the window holds, two being enough.
    * rerank: share of the topic's terms by weight, relevance: by number. These stand in for judgements of a model.
    """
    records = evidence(spark, sf_dir).drop("topic_id")
    asked = materialise(retrieve.query_terms(topics(spark, sf_dir), F.col("must_include")), "asked")
    index = pool_index(records)
    idf = materialise(term_weights(index, asked), "idf")
    hits = materialise(search_index(index, asked, HITS, by_part=True, weights=idf), "hits")
    # of all records only those of hits are read, graded and split again
    records = materialise(records.join(broadcast_if_small(hits.select(F.col("id").alias("ev_id")).distinct(), 1_000_000), "ev_id", "left_semi"), "records")

    must = topics(spark, sf_dir).select("topic_id", F.explode("must_include").alias("term"))
    other = must.withColumn("topic_id", F.col("topic_id") - 1).join(asked.select("topic_id").distinct(), "topic_id", "left_semi").join(asked, ["topic_id", "term"], "left_anti")
    kinds = (("all", asked.select("topic_id", "term")), ("must", must), ("other", other))
    terms = None
    for kind, rows in kinds:
        part = rows.select("topic_id", F.lit(kind).alias("kind"), "term")
        terms = part if terms is None else terms.union(part)
    terms = materialise(terms.join(broadcast_if_small(idf, 1_000_000), "term", "left").select("topic_id", "kind", "term", F.coalesce("idf", F.lit(0.0)).alias("idf")), "terms")
    whole = terms.groupBy("topic_id").pivot("kind", [k for k, _ in kinds]).agg(F.count("term").alias("n"), F.sum("idf").alias("weight"))
    found = covered(hits, records, terms).groupBy("topic_id", "id").pivot("kind", [k for k, _ in kinds]).agg(F.first("n").alias("n"), F.first("weight").alias("weight"))
    share = lambda a, b: F.coalesce(F.try_divide(F.col(f"held.{a}"), F.col(f"whole.{b}")), F.lit(0.0))

    listed = hits.join(records.select(F.col("ev_id").alias("id"), url_key(F.col("url")).alias("key")), "id").select("topic_id", "id", "key", (F.col("rank") - 1).alias("rank"))
    fused = retrieve.reciprocal_rank_fusion(listed)
    best = fused.groupBy("topic_id").agg(F.max("rrf").alias("best"))
    fused = listed.select("topic_id", "id", "key").join(fused, ["topic_id", "key"]).join(best, "topic_id").select("topic_id", "id", (F.col("rrf") / F.col("best")).alias("rrf"))
    vectors = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.transform("embedding", lambda x: x.cast("double")).alias("v"))
    near = hits.select("topic_id", "id").join(vectors, "id").join(broadcast_if_small(topic_vectors(hits, vectors), 100_000, 16 + 8 * F.size("centre")), "topic_id")
    near = near.select("topic_id", "id", retrieve.cosine(F.col("v"), F.col("centre")).alias("cosine"))

    text = D.scan_text(F.col("title"), F.col("content"), F.col("snippet"))
    grade = D.score(D.detect(F.col("source_type"), F.col("publication_types"), text), D.is_preprint(F.col("source_type"), text))
    known = records.select(F.col("ev_id").alias("id"), "arrival", "source_type", "reliability_tier", "citation_count", "publication_date", grade.alias("evidence"))
    rows = hits.select("topic_id", "id", "score").join(known, "id").join(fused, ["topic_id", "id"], "left").join(near, ["topic_id", "id"], "left")
    rows = rows.alias("r").join(found.alias("held"), ["topic_id", "id"], "left").join(whole.alias("whole"), "topic_id", "left")
    six = lambda c, name: F.round(F.coalesce(c, F.lit(0.0)), 6).alias(name)
    return rows.select(
        "topic_id", F.col("id").alias("ev_id"), "arrival", "source_type", "reliability_tier", "citation_count", "publication_date", six(F.col("cosine"), "cosine"), six(F.col("score"), "bm25"), six(F.col("rrf"), "rrf"),
        six(F.col("evidence"), "evidence"), six(share("must_n", "must_n"), "concept"), six(F.least(F.lit(1.0), F.coalesce(F.col("held.other_n"), F.lit(0)) / 2.0), "offtopic"),
        six(share("all_weight", "all_weight"), "rerank"), six(share("all_n", "all_n"), "relevance"),
    )


_QUOTE = "'{}'".format


def _case(key: str, values: dict) -> str:
    quote = lambda v: _QUOTE(v) if isinstance(v, str) else repr(v)
    return f"CASE {key} " + " ".join(f"WHEN '{k}' THEN {quote(v)}" for k, v in values.items()) + " END"


_SCORES = {k: v for k, (v, _) in D.DESIGNS.items()}
SIGNALS = f"""{EVIDENCE}, signals AS (WITH {BM25_SQL}, must AS (SELECT topic_id, unnest((list_filter(t, lambda x, i: list_position(t, x) = i))[1:3]) AS term FROM q0), neg AS (SELECT topic_id - 1 AS topic_id, term FROM must WHERE topic_id - 1 IN (SELECT topic_id FROM q) EXCEPT SELECT topic_id, term FROM q),
    hits AS (SELECT * FROM (SELECT r.topic_id, r.id, r.score, e.source_type, lower(regexp_replace(e.url, '/+$', '')) AS key, row_number() OVER (PARTITION BY r.topic_id, e.source_type ORDER BY r.score DESC, r.id) AS place FROM ranked r JOIN evidence e ON e.ev_id = r.id) WHERE place <= {HITS}),
    fused AS (SELECT topic_id, key, sum(1.0 / (60 + place - 1)) AS rrf FROM hits GROUP BY ALL), best_rrf AS (SELECT topic_id, max(rrf) AS best FROM fused GROUP BY 1),
    idf AS (SELECT term, ln(1.0 + (n - df + 0.5) / (df + 0.5)) AS idf FROM df, facts),
    kinds AS (SELECT topic_id, 'all' AS kind, term FROM q UNION ALL SELECT topic_id, 'must', term FROM must UNION ALL SELECT topic_id, 'other', term FROM neg), terms AS (SELECT topic_id, kind, term, coalesce(idf, 0) AS idf FROM kinds LEFT JOIN idf USING (term)),
    whole AS (SELECT topic_id, count(*) FILTER (kind = 'all') AS n, sum(idf) FILTER (kind = 'all') AS w, count(*) FILTER (kind = 'must') AS m FROM terms GROUP BY 1),
    held AS (SELECT h.topic_id, h.id, count(*) FILTER (kind = 'all') AS n, sum(idf) FILTER (kind = 'all') AS w, count(*) FILTER (kind = 'must') AS m, count(*) FILTER (kind = 'other') AS o FROM hits h JOIN terms t ON t.topic_id = h.topic_id JOIN tf ON tf.doc_id = h.id AND tf.term = t.term GROUP BY ALL),
    vec AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings), leaders AS (SELECT topic_id, v FROM (SELECT h.topic_id, v, row_number() OVER (PARTITION BY h.topic_id ORDER BY h.score DESC, h.id) AS lead FROM hits h JOIN vec USING (id)) WHERE lead <= {LEADERS}),
    centres AS (SELECT topic_id, list(x ORDER BY dim) AS centre FROM (SELECT topic_id, dim, avg(x) AS x FROM (SELECT topic_id, unnest(v) AS x, generate_subscripts(v, 1) AS dim FROM leaders) GROUP BY ALL) GROUP BY 1),
    near AS (SELECT h.topic_id, h.id, coalesce(list_dot_product(v, centre) / nullif(sqrt(list_dot_product(v, v)) * sqrt(list_dot_product(centre, centre)), 0), 0) AS cosine FROM hits h JOIN vec USING (id) JOIN centres c ON c.topic_id = h.topic_id),
    scan AS (SELECT *, substr(title || '. ' || CASE WHEN content <> '' THEN content ELSE snippet END, 1, 700) AS scan FROM evidence),
    grades AS (SELECT ev_id, {_case('design', _SCORES)}::DOUBLE * CASE WHEN preprint THEN 0.75 ELSE 1 END AS grade FROM (SELECT ev_id, source_type = 'biorxiv' OR regexp_matches(scan, '(?i){D.PREPRINT}') AS preprint, coalesce({_case('source_type', D.PROVIDER_DESIGNS)},
        (SELECT arg_max(d, s) FROM (SELECT d, {_case('d', _SCORES)} AS s FROM (SELECT {_case('lower(p)', D.TYPE_DESIGNS)} AS d FROM unnest(publication_types) u(p))) WHERE d IS NOT NULL),
        CASE {' '.join(f"WHEN regexp_matches(scan, '(?i){p}') THEN '{d}'" for d, p in D.PATTERNS)} END, 'unknown') AS design FROM scan))
    SELECT h.topic_id, e.ev_id, e.arrival, e.source_type, e.reliability_tier, e.citation_count, e.publication_date, round(coalesce(near.cosine, 0), 6) AS cosine, round(h.score, 6) AS bm25, round(f.rrf / b.best, 6) AS rrf, round(g.grade, 6) AS evidence,
        round(coalesce(d.m / w.m, 0), 6) AS concept, round(least(1.0, coalesce(d.o, 0) / 2.0), 6)::DOUBLE AS offtopic, round(coalesce(d.w / nullif(w.w, 0), 0), 6) AS rerank, round(coalesce(d.n / w.n, 0), 6) AS relevance
        FROM hits h JOIN evidence e ON e.ev_id = h.id JOIN grades g ON g.ev_id = h.id JOIN fused f ON f.topic_id = h.topic_id AND f.key = h.key JOIN best_rrf b ON b.topic_id = h.topic_id JOIN whole w ON w.topic_id = h.topic_id
        LEFT JOIN held d ON d.topic_id = h.topic_id AND d.id = h.id LEFT JOIN near ON near.topic_id = h.topic_id AND near.id = h.id)"""
