"""Queries of tokens, identity, retrieval and fusion."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quarry.functions import text as T
from quarry.operators import identity, retrieve
from quarry.operators.index import build_index, search_index
from quarry.plans.registry import query
from quarry.sources.tables import EVIDENCE, evidence, table
from quarry.storage import materialise

_STOP = ", ".join(f"'{w}'" for w in T.STOPWORDS)


def tokens_sql(text: str) -> str:
    return rf"list_filter(regexp_extract_all(lower(coalesce({text}, '')), '{T.TOKEN}'), lambda t: NOT list_contains([{_STOP}], t) AND NOT regexp_full_match(t, '[0-9]+'))"


DOI_SQL = r"nullif(lower(regexp_replace(regexp_extract({0}, '(?i)10\.\d{{4,9}}/[^\s?#]+'), '[).]+$', '')), '')"
NAME_SQL = r"trim(regexp_replace(regexp_replace(lower(title), '[^\p{L}\p{N}_\s]', ' ', 'g'), '\s+', ' ', 'g'))"


@query("tokenize_stats", f"SELECT doc_id, len(t) AS n_tokens, len(list_distinct(t)) AS n_terms, coalesce(t[1], '') AS first_term FROM (SELECT doc_id, {tokens_sql('text')} AS t FROM documents)")
def tokenize_stats(spark, sf):
    t = table(spark, sf, "documents").select("doc_id", T.tokenize(F.col("text")).alias("t"))
    return t.select("doc_id", F.size("t").cast("long").alias("n_tokens"), F.size(F.array_distinct("t")).cast("long").alias("n_terms"), F.coalesce(F.try_element_at("t", F.lit(1)), F.lit("")).alias("first_term"))


@query("identity_key", f"WITH {EVIDENCE} SELECT ev_id, coalesce('doi:' || {DOI_SQL.format('url')}, CASE WHEN length({NAME_SQL}) >= 15 THEN 'title:' || {NAME_SQL} END, 'url:' || lower(regexp_replace(url, '/+$', ''))) AS key FROM evidence")
def identity_key(spark, sf):
    return evidence(spark, sf).select("ev_id", T.identity_key(F.col("url"), F.col("title")).alias("key"))


PAPER_SQL = rf"""coalesce(nullif(regexp_extract(lower({{0}}), 'semanticscholar\.org/paper/([0-9a-f]{{{{40}}}})', 1), ''), 'ARXIV:' || nullif(regexp_extract(lower({{0}}), 'arxiv\.org/abs/([\w.\-]+?)(?:v\d+)?/?$', 1), ''),
    'PMID:' || nullif(regexp_extract(lower({{0}}), '(?:pubmed\.ncbi\.nlm\.nih\.gov|/med/)/?(\d{{{{4,9}}}})', 1), ''), 'DOI:' || {DOI_SQL.replace("{0}", "lower({0})")})"""


@query("paper_id", f"""WITH {EVIDENCE}, u AS (SELECT ev_id, CASE ev_id % 5 WHEN 0 THEN 'https://www.semanticscholar.org/paper/' || repeat('0a', 20) WHEN 1 THEN 'https://arxiv.org/abs/2401.' || (10000 + ev_id) || 'v2' ELSE url END AS url FROM evidence)
    SELECT ev_id, {PAPER_SQL.format('url')} AS paper_id FROM u""")
def paper_id(spark, sf):
    url = F.when(F.col("ev_id") % 5 == 0, F.lit("https://www.semanticscholar.org/paper/" + "0a" * 20)).when(F.col("ev_id") % 5 == 1, F.concat(F.lit("https://arxiv.org/abs/2401."), (10000 + F.col("ev_id")).cast("string"), F.lit("v2"))).otherwise(F.col("url"))
    return evidence(spark, sf).select("ev_id", T.paper_id(url).alias("paper_id"))


KEYS_SQL = f"""keys AS (SELECT ev_id, unnest(CASE WHEN len(found) > 0 THEN found ELSE ['url:' || lower(regexp_replace(url, '/+$', ''))] END) AS key FROM
    (SELECT ev_id, url, list_filter(['doi:' || {DOI_SQL.format('url')}, CASE WHEN length({NAME_SQL}) >= 15 THEN 'title:' || {NAME_SQL} END], lambda k: k IS NOT NULL) AS found FROM evidence)),
    heads AS (SELECT key, min(ev_id) AS head FROM keys GROUP BY key), links AS (SELECT DISTINCT ev_id AS a, head AS b FROM keys JOIN heads USING (key)),
    both_ways AS (SELECT a, b FROM links UNION SELECT b, a FROM links), reach AS (SELECT ev_id AS id, ev_id AS seen FROM evidence UNION SELECT r.id, b FROM reach r JOIN both_ways ON a = r.seen),
    components AS (SELECT id AS ev_id, min(seen) AS component FROM reach GROUP BY id)"""


@query("dup_components", f"WITH RECURSIVE {EVIDENCE}, {KEYS_SQL} SELECT ev_id, component FROM components")
def dup_components(spark, sf):
    return identity.duplicate_components(evidence(spark, sf))


MERGE_SQL = """SELECT component, count(*) AS n_records, max(citation_count) AS citation_count, coalesce(arg_min(publication_date, arrival) FILTER (publication_date <> ''), '') AS publication_date,
    arg_max(content, length(content) * 10000000 - arrival) AS content, min(reliability_tier) AS reliability_tier, arg_min(title, arrival) AS title, arg_min(url, arrival) AS url, arg_min(source_type, arrival) AS source_type"""


@query("dedup_merge", f"WITH RECURSIVE {EVIDENCE}, {KEYS_SQL} {MERGE_SQL} FROM evidence JOIN components USING (ev_id) GROUP BY component")
def dedup_merge(spark, sf):
    rows = evidence(spark, sf)
    return identity.merge_entities(rows, identity.duplicate_components(rows))


@query("pool_union", f"""WITH {EVIDENCE}, rounds AS (SELECT * FROM evidence WHERE ev_id % 3 <> 0 UNION ALL SELECT * FROM evidence WHERE ev_id % 2 = 0)
    SELECT topic_id, lower(regexp_replace(url, '/+$', '')) AS url_key, min(arrival) AS arrival, arg_min(source_type, arrival) AS source_type, count(*) AS found FROM rounds GROUP BY 1, 2""")
def pool_union(spark, sf):
    rows = evidence(spark, sf)
    rounds = rows.filter("ev_id % 3 <> 0").unionByName(rows.filter("ev_id % 2 = 0"))
    return rounds.groupBy("topic_id", T.url_key(F.col("url")).alias("url_key")).agg(F.min("arrival").alias("arrival"), F.min_by("source_type", "arrival").alias("source_type"), F.count("*").alias("found"))


#: Hosts that are never evidence, and hosts that may be read in full.
BLOCKED = ("core.ac.uk", "researchgate.net", "academia.edu", "scribd.com", "slideshare.net")
FETCHABLE = (
    "en.wikipedia.org", "it.wikipedia.org", "ncbi.nlm.nih.gov", "europepmc.org", "dailymed.nlm.nih.gov", "who.int", "ema.europa.eu", "aifa.gov.it", "salute.gov.it", "epicentro.iss.it", "cochranelibrary.com", "cochrane.org", "nice.org.uk", "msdmanuals.com",
)
#: Hosts in the given pages, since they hold none of the above.
LOCAL_BLOCKED = ("example.net", "spam-farm.example")


def _domains(spark, names):
    return spark.createDataFrame([(n,) for n in names], "domain string")


HOST_SQL = "regexp_replace(lower(regexp_extract(url, '^[a-z]+://([^/:?#]+)', 1)), '^www\\.', '')"


def _listed_sql(names) -> str:
    return "(" + " OR ".join(f"{HOST_SQL} = '{n}' OR ends_with({HOST_SQL}, '.{n}')" for n in names) + ")"


@query("blocked_host_filter", f"SELECT page_id, url FROM pages WHERE NOT {_listed_sql(BLOCKED + LOCAL_BLOCKED)}")
def blocked_host_filter(spark, sf):
    return identity.host_filter(table(spark, sf, "pages").select("page_id", "url"), _domains(spark, BLOCKED + LOCAL_BLOCKED))


@query("allowlisted_host_filter", f"SELECT page_id, url FROM pages WHERE {_listed_sql((*FETCHABLE, 'example.org', 'example.com'))}")
def allowlisted_host_filter(spark, sf):
    return identity.host_filter(table(spark, sf, "pages").select("page_id", "url"), _domains(spark, (*FETCHABLE, "example.org", "example.com")), keep_listed=True)


@query("collector_merge", f"""WITH {EVIDENCE}, r AS (SELECT *, row_number() OVER (PARTITION BY topic_id, url ORDER BY arrival) AS n FROM (SELECT topic_id, arrival, source_type, CASE WHEN ev_id % 11 = 0 THEN 'https://www.researchgate.net/p/' || (ev_id % 13) ELSE url END AS url FROM evidence))
    SELECT topic_id, url, arrival, source_type FROM r WHERE n = 1 AND NOT {_listed_sql(BLOCKED)}""")
def collector_merge(spark, sf):
    url = F.when(F.col("ev_id") % 11 == 0, F.concat(F.lit("https://www.researchgate.net/p/"), (F.col("ev_id") % 13).cast("string"))).otherwise(F.col("url"))
    hits = evidence(spark, sf).select("topic_id", "arrival", "source_type", url.alias("url"))
    return identity.first_arrivals(identity.host_filter(hits, _domains(spark, BLOCKED)), ["topic_id", "url"])


#: Fixed value: characters of a document that lexical scores look at.
WINDOW = 1200


def topics(spark, sf):
    return table(spark, sf, "benchmark").select(F.col("item_id").alias("topic_id"), "text").withColumn("must_include", F.slice(F.array_distinct(T.tokenize(F.col("text"))), 1, 3))


def ranked_documents(spark, sf, k: int):
    """topic_id, id, score, rank: the ``k`` best windows of each topic, from an index of them, so that no pair of a topic and a document becomes a row unless it may be among these."""
    docs = evidence(spark, sf).select("ev_id", retrieve.document_text(F.col("title"), F.col("content"), F.col("snippet"), WINDOW).alias("doc_text"))
    asked = materialise(retrieve.query_terms(topics(spark, sf), F.col("must_include")), "asked")
    return search_index(build_index(docs), asked, k).select("topic_id", "id", "score", "rank")


#: A document's text for lexical scores, all of it.
TEXT_SQL = "title || ' ' || title || ' ' || coalesce(nullif(content, ''), snippet, '')"


def bm25_sql(doc_text: str) -> str:
    return f"""{EVIDENCE}, q0 AS (SELECT item_id AS topic_id, {tokens_sql('text')} AS t FROM benchmark), q AS (SELECT topic_id, term, count(*) AS qtf FROM (SELECT topic_id, unnest(t || (list_filter(t, lambda x, i: list_position(t, x) = i))[1:3] || (list_filter(t, lambda x, i: list_position(t, x) = i))[1:3]) AS term FROM q0) GROUP BY ALL),
    d AS (SELECT doc_id, {tokens_sql('doc_text')} AS t FROM (SELECT ev_id AS doc_id, {doc_text} AS doc_text FROM evidence)), facts AS (SELECT count(*)::DOUBLE AS n, avg(len(t)) AS mean FROM d),
    tf AS (SELECT doc_id, length, term, count(*)::DOUBLE AS f FROM (SELECT doc_id, len(t) AS length, unnest(t) AS term FROM d) WHERE term IN (SELECT term FROM q) GROUP BY ALL),
    df AS (SELECT term, count(*)::DOUBLE AS df FROM tf GROUP BY term),
    raw AS (SELECT topic_id, doc_id AS id, sum(qtf * ln(1.0 + (n - df + 0.5) / (df + 0.5)) * f * 2.2::DOUBLE / (f + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * length / mean))) AS raw FROM tf JOIN df USING (term) JOIN q USING (term), facts GROUP BY ALL),
    ranked AS (SELECT topic_id, id, score, row_number() OVER (PARTITION BY topic_id ORDER BY score DESC, id) AS rank FROM (SELECT topic_id, id, round(raw / max(raw) OVER (PARTITION BY topic_id), 6) AS score FROM raw))"""


BM25_SQL = bm25_sql(f"substr({TEXT_SQL}, 1, {WINDOW})")


@query("bm25", f"WITH {BM25_SQL} SELECT topic_id, id, score, CAST(rank AS INTEGER) AS rank FROM ranked WHERE rank <= 10")
def bm25(spark, sf):
    return ranked_documents(spark, sf, 10)


#: Gold grades: a document is graded by how many of two runs of a benchmark item it holds, words 5 to 9 and 10 to 14.
STARTS = (5, 10)
#: A topic's pool before and after the cut.
POOL, CUT = 40, 20
QRELS_SQL = f"""b AS (SELECT item_id AS topic_id, string_split(text, ' ') AS w FROM benchmark), g AS (SELECT DISTINCT topic_id, array_to_string(w[s:s + 4], ' ') AS run FROM b, (SELECT unnest({list(STARTS)}) AS s) WHERE len(w) >= s + 4),
    runs AS (SELECT DISTINCT doc_id, unnest(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) AS run FROM (SELECT doc_id, string_split(text, ' ') AS w FROM documents) WHERE len(w) >= 5),
    ids AS (SELECT ev_id AS id, (url LIKE '%pubmed%' OR {DOI_SQL.format('url')} IS NOT NULL) AS gradable FROM evidence),
    qrels AS (SELECT topic_id, doc_id AS id, count(*) AS grade FROM g JOIN runs USING (run) JOIN ids ON id = doc_id WHERE gradable GROUP BY ALL)"""


def qrels(spark, sf):
    """topic_id, id, grade of the documents with a known paper id that hold runs of five words of a benchmark item.

    Runs are compared by 64-bit hashes, made where they are exploded; items are the small side.
    """
    words = F.split("text", " ")
    run = lambda at: F.xxhash64(*(F.get("w", at + j) for j in range(5)))
    items = table(spark, sf, "benchmark").select(F.col("item_id").alias("topic_id"), words.alias("w"))
    wanted = items.select("topic_id", F.explode(F.array(*(F.when(F.size("w") >= s + 4, run(F.lit(s - 1))) for s in STARTS))).alias("run")).filter("run is not null").distinct()
    docs = evidence(spark, sf).filter(T.paper_id(F.col("url")).isNotNull()).select("ev_id", F.split("content", " ").alias("w"))
    runs = docs.select("ev_id", "w", F.posexplode("w").alias("at", "first")).filter(F.col("at") + 5 <= F.size("w")).select("ev_id", run(F.col("at")).alias("run"))
    held = runs.join(retrieve.broadcast_if_small(wanted, 1_000_000), "run").select("topic_id", F.col("ev_id").alias("id"), "run").distinct()
    return held.groupBy("topic_id", "id").agg(F.count("*").alias("grade"))


METRICS_SQL = f"""{BM25_SQL}, {QRELS_SQL}, gold AS (SELECT topic_id, count(*) AS n_gold FROM qrels GROUP BY 1),
    ideal AS (SELECT topic_id, sum((2 ** grade - 1) / log2(r + 1)) AS best FROM (SELECT *, row_number() OVER (PARTITION BY topic_id ORDER BY grade DESC, id) AS r FROM qrels) WHERE r <= 10 GROUP BY 1),
    slots AS (SELECT r.topic_id, r.id, r.rank, i.gradable, coalesce(q.grade, 0) AS grade, sum(CASE WHEN i.gradable AND rank <= {CUT} THEN 1 ELSE 0 END) OVER (PARTITION BY r.topic_id ORDER BY rank) AS place FROM ranked r JOIN ids i ON i.id = r.id LEFT JOIN qrels q ON q.topic_id = r.topic_id AND q.id = r.id WHERE rank <= {POOL}),
    own AS (SELECT *, row_number() OVER (PARTITION BY topic_id ORDER BY grade DESC, id) AS r FROM slots WHERE gradable AND rank <= {CUT}), pool_ideal AS (SELECT topic_id, sum((2 ** grade - 1) / log2(r + 1)) AS best FROM own WHERE r <= 10 GROUP BY 1),
    m AS (SELECT topic_id, count(*) FILTER (rank <= {CUT}) AS n_ranked, count(*) FILTER (gradable AND rank <= {CUT}) AS n_gradable, count(*) FILTER (grade > 0) AS in_pool, count(*) FILTER (grade > 0 AND rank <= 10) AS h10, count(*) FILTER (grade > 0 AND rank <= 20) AS h20,
      min(rank) FILTER (grade > 0 AND rank <= {CUT}) AS first, count(*) FILTER (gradable AND place <= 10 AND rank <= {CUT} AND grade > 0) AS p10, coalesce(sum((2 ** grade - 1) / log2(place + 1)) FILTER (gradable AND place <= 10 AND rank <= {CUT}), 0) AS dcg FROM slots GROUP BY 1),
    metrics AS (SELECT topic_id, n_ranked, n_gradable, n_gold, round(n_gradable / n_ranked, 6) AS gradable_share, round(in_pool / n_gold, 6) AS pool_recall, round(least(n_gradable, n_gold) / n_gold, 6) AS pool_recall_ceiling, round(h10 / n_gold, 6) AS recall_at_10, round(h20 / n_gold, 6) AS recall_at_20,
      round(CASE WHEN n_gradable = 0 THEN 0 ELSE p10 / least(10, n_gradable) END, 6) AS precision_at_10, round(dcg / ideal.best, 6) AS ndcg_at_10, round(CASE WHEN coalesce(pool_ideal.best, 0) = 0 THEN 0 ELSE dcg / pool_ideal.best END, 6) AS ndcg_at_10_pool, round(coalesce(1 / first, 0), 6) AS mrr
      FROM gold JOIN m USING (topic_id) JOIN ideal USING (topic_id) LEFT JOIN pool_ideal USING (topic_id))"""


def topic_metrics(ranked: DataFrame, ids: DataFrame, gold: DataFrame, cut: int = CUT) -> DataFrame:
    """Ranked metrics of each topic that has gold and a pool.

    ``ranked`` (topic_id, id, rank from 1) is the pool before the cut, ``ids`` (id, gradable) says which slots can be judged, ``gold``
    (topic_id, id, grade) holds what is relevant. Precision and nDCG look at gradable slots only and divide by min(10, gradable); recall
    and MRR count every slot; nDCG's gain is 2 ** grade - 1, against the best of all gold and of the pool's own slots.
    """
    known = ids.join(retrieve.broadcast_if_small(ranked.select("id").distinct(), 1_000_000), "id", "left_semi")
    slots = ranked.join(known, "id").join(gold, ["topic_id", "id"], "left").select("topic_id", "id", "rank", "gradable", F.coalesce("grade", F.lit(0)).alias("grade"))
    kept = F.col("rank") <= cut
    own = F.col("gradable") & kept
    slots = slots.withColumn("place", F.sum(F.when(own, 1).otherwise(0)).over(Window.partitionBy("topic_id").orderBy("rank")))
    gain = lambda at: (F.pow(F.lit(2.0), F.col("grade")) - 1) / F.log2(F.col(at) + 1.0)
    best = lambda df, name: retrieve.top_per_group(df, ["topic_id"], [F.desc("grade"), "id"], 10, "r").groupBy("topic_id").agg(F.sum(gain("r")).alias(name))
    hit, top = F.col("grade") > 0, own & (F.col("place") <= 10)
    found = slots.groupBy("topic_id").agg(
        F.count_if(kept).alias("n_ranked"), F.count_if(own).alias("n_gradable"), F.count_if(hit).alias("in_pool"), F.count_if(hit & (F.col("rank") <= 10)).alias("h10"), F.count_if(hit & (F.col("rank") <= 20)).alias("h20"),
        F.min(F.when(hit & kept, F.col("rank"))).alias("first"), F.count_if(top & hit).alias("p10"), F.coalesce(F.sum(F.when(top, gain("place"))), F.lit(0.0)).alias("dcg"),
    )
    per = gold.groupBy("topic_id").agg(F.count("*").alias("n_gold")).join(found, "topic_id").join(best(gold, "best"), "topic_id").join(best(slots.filter(own), "own_best"), "topic_id", "left")
    n, judged = F.col("n_gold"), F.col("n_gradable")
    share = lambda a, b: F.round(F.coalesce(F.try_divide(a, b), F.lit(0.0)), 6)
    return per.select(
        "topic_id", "n_ranked", "n_gradable", "n_gold", share(judged, F.col("n_ranked")).alias("gradable_share"), share(F.col("in_pool"), n).alias("pool_recall"), share(F.least(judged, n), n).alias("pool_recall_ceiling"),
        share(F.col("h10"), n).alias("recall_at_10"), share(F.col("h20"), n).alias("recall_at_20"), share(F.col("p10"), F.least(F.lit(10), judged)).alias("precision_at_10"),
        share(F.col("dcg"), F.col("best")).alias("ndcg_at_10"), share(F.col("dcg"), F.col("own_best")).alias("ndcg_at_10_pool"), share(F.lit(1.0), F.col("first")).alias("mrr"),
    )


def _metrics(spark, sf):
    ids = evidence(spark, sf).select(F.col("ev_id").alias("id"), T.paper_id(F.col("url")).isNotNull().alias("gradable"))
    return topic_metrics(materialise(ranked_documents(spark, sf, POOL), "ranked"), ids, materialise(qrels(spark, sf), "qrels"))


@query("retrieval_metrics", f"WITH {METRICS_SQL} SELECT * FROM metrics")
def retrieval_metrics(spark, sf):
    return _metrics(spark, sf)


MEANS = ("pool_recall", "pool_recall_ceiling", "recall_at_10", "recall_at_20", "precision_at_10", "ndcg_at_10", "ndcg_at_10_pool", "mrr", "gradable_share")


@query("retrieval_summary", f"WITH {METRICS_SQL} SELECT count(*) AS n_topics, " + ", ".join(f"round(avg({m}), 5) AS mean_{m}" for m in MEANS) + ", round(coalesce(avg(pool_recall / pool_recall_ceiling) FILTER (pool_recall_ceiling > 0), 0), 5) AS mean_recall_vs_ceiling, count(*) FILTER (pool_recall = 0) AS zero_recall FROM metrics")
def retrieval_summary(spark, sf):
    """Means of the metrics over topics, topics whose pool holds no gold, and recall as a share of what the gradable slots allow."""
    ratio = F.avg(F.when(F.col("pool_recall_ceiling") > 0, F.col("pool_recall") / F.col("pool_recall_ceiling")))
    return _metrics(spark, sf).agg(
        F.count("*").alias("n_topics"), *(F.round(F.avg(m), 5).alias(f"mean_{m}") for m in MEANS), F.round(F.coalesce(ratio, F.lit(0.0)), 5).alias("mean_recall_vs_ceiling"), F.count_if(F.col("pool_recall") == 0).alias("zero_recall")
    )


@query("rrf", f"""WITH {EVIDENCE}, h AS (SELECT topic_id, citation_count % 40 AS key, row_number() OVER (PARTITION BY topic_id, source_type ORDER BY citation_count DESC, arrival) - 1 AS rank FROM evidence)
    SELECT topic_id, key, round(sum(1.0 / (60 + rank)), 6) AS rrf FROM h GROUP BY ALL""")
def rrf(spark, sf):
    order = Window.partitionBy("topic_id", "source_type").orderBy(F.desc("citation_count"), "arrival")
    hits = evidence(spark, sf).select("topic_id", (F.col("citation_count") % 40).alias("key"), (F.row_number().over(order) - 1).alias("rank"))
    return retrieve.reciprocal_rank_fusion(hits).withColumn("rrf", F.round("rrf", 6))


@query("minmax", f"""WITH {EVIDENCE} SELECT ev_id, round(CASE WHEN hi > lo THEN (citation_count - lo) / (hi - lo) ELSE 0 END, 6) AS scaled
    FROM (SELECT ev_id, citation_count, min(citation_count) OVER (PARTITION BY topic_id) AS lo, max(citation_count) OVER (PARTITION BY topic_id) AS hi FROM evidence)""")
def minmax(spark, sf):
    return retrieve.minmax(evidence(spark, sf).select("topic_id", "ev_id", "citation_count"), "citation_count").select("ev_id", F.round("scaled", 6).alias("scaled"))


@query("cosine_topk", """WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings), s AS (SELECT q.vec_id AS query_id, v.vec_id AS id, list_dot_product(q.e, v.e) / (sqrt(list_dot_product(q.e, q.e)) * sqrt(list_dot_product(v.e, v.e))) AS c FROM v q, v WHERE q.vec_id % 100 = 0 AND v.vec_id <> q.vec_id)
    SELECT query_id, id, round(c, 6) AS cosine, CAST(r AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY c DESC, id) AS r FROM s) WHERE r <= 10""")
def cosine_topk(spark, sf):
    v = table(spark, sf, "embeddings")
    queries = v.filter("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    return retrieve.cosine_top(v, queries, 10).select("query_id", "id", F.round("cosine", 6).alias("cosine"), "rank")


@query("per_provider_topn", f"""WITH {EVIDENCE} SELECT topic_id, source_type, ev_id, rank FROM (SELECT *, CAST(row_number() OVER (PARTITION BY topic_id, source_type ORDER BY citation_count DESC, arrival) AS INTEGER) AS rank FROM evidence) WHERE rank <= 8""")
def per_provider_topn(spark, sf):
    return retrieve.top_per_group(evidence(spark, sf), ["topic_id", "source_type"], [F.desc("citation_count"), "arrival"], 8).select("topic_id", "source_type", "ev_id", "rank")


