"""Queries that build what providers are asked, for every topic and provider."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.functions import queries as Q
from quarry.functions.text import tokenize
from quarry.operators.identity import host_filter
from quarry.operators.retrieve import top_per_group
from quarry.plans.ranking import GATE_NEEDS_SUBJECT, GATES, LITERATURE, TYPE_PROVIDERS
from quarry.plans.registry import query
from quarry.plans.retrieval import FETCHABLE, _domains, _listed_sql, tokens_sql
from quarry.plans.text_work import PAGES_SQL, page_text
from quarry.sources.tables import EVIDENCE, PROVIDERS, evidence, table

TYPES = ("dosage", "drug_interaction", "definition", "prevalence", "drug", "adverse_effect", "other")
ASKED_WORDS = ("what is the dose of ", "Side effects (", "mechanism: ")
KEYWORDS = ("antimicrobial", "therapy", "en")


def briefs(spark, sf):
    """A brief for each benchmark item, with fields that are stated, blank or missing in turn."""
    k, w = F.col("item_id"), tokenize(F.col("text"))
    word = lambda n: F.coalesce(F.try_element_at(w, F.lit(n)), F.lit(""))
    pico = F.struct(F.when(k % 3 == 0, "adults").alias("population"), F.when(k % 4 != 3, word(2)).alias("intervention"), F.lit(" ").alias("comparison"), F.when(k % 2 == 0, word(3)).alias("outcome"))
    mesh = F.when(k % 5 == 1, F.array(F.concat(F.lit('"'), word(1), F.lit('"[MeSH Terms] OR "'), word(2), F.lit('"[MeSH Terms]')), F.concat(F.lit('"'), word(1), F.lit('"[MeSH Terms]')))).otherwise(F.array(word(1)))
    given = F.when(k % 6 == 0, F.col("text")).when(k % 6 == 1, F.concat(word(1), F.lit("[tiab]"))).when(k % 6 == 2, F.lit(" the of "))
    return table(spark, sf, "benchmark").select(
        "item_id", "text", F.element_at(F.array(*map(F.lit, TYPES)), (1 + k % 7).cast("int")).alias("topic_type"), F.when(k % 4 == 0, "  ").otherwise(word(1)).alias("subject"), F.when(k % 3 == 1, word(4)).alias("value"), pico.alias("pico"), mesh.alias("alternatives"),
        given.alias("given"), F.when(k % 3 == 0, F.array(word(5), word(6))).otherwise(F.array().cast("array<string>")).alias("diseases"),
    )


_STOP = "[" + ", ".join(f"'{w}'" for w in Q.SEARCH_STOPWORDS) + "]"
_CHARS = Q.NOT_KEYWORD.replace("'", "''")


def _kw(most: int, least: int = 3, of: str = "q") -> str:
    return f"list_filter(string_split_regex(trim(regexp_replace({of}, '{_CHARS}', ' ', 'g')), '\\s+'), lambda w: length(w) >= {least} AND NOT list_contains({_STOP}, lower(w)))[1:{most}]"


def _case(key: str, values: dict) -> str:
    return f"CASE {key} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in values.items()) + " END"


_WORD = "coalesce(w[{0}], '')".format
BRIEFS_SQL = f"""t AS (SELECT item_id, text, {tokens_sql('text')} AS w FROM benchmark),
    briefs AS (SELECT item_id, text, {list(TYPES)}[1 + item_id % 7] AS topic_type, CASE WHEN item_id % 4 = 0 THEN '' ELSE {_WORD(1)} END AS subject, CASE WHEN item_id % 3 = 1 THEN {_WORD(4)} ELSE '' END AS value,
        CASE WHEN item_id % 3 = 0 THEN 'adults' ELSE '' END AS p, CASE WHEN item_id % 4 <> 3 THEN {_WORD(2)} ELSE '' END AS i, CASE WHEN item_id % 2 = 0 THEN {_WORD(3)} ELSE '' END AS o, CASE WHEN item_id % 5 = 1 THEN list_distinct_in_order ELSE [] END AS mesh,
        CASE item_id % 6 WHEN 0 THEN text WHEN 1 THEN {_WORD(1)} || '[tiab]' WHEN 2 THEN 'the of' ELSE '' END AS given, CASE WHEN item_id % 3 = 0 THEN [{_WORD(5)}, {_WORD(6)}] ELSE [] END AS diseases
        FROM (SELECT *, list_filter(CASE WHEN {_WORD(1)} = {_WORD(2)} THEN [{_WORD(1)}] ELSE [{_WORD(1)}, {_WORD(2)}] END, lambda x: x <> '') AS list_distinct_in_order FROM t)),
    asked AS (SELECT *, CASE WHEN trim(given) <> '' THEN trim(given) WHEN i <> '' AND (o <> '' OR p <> '') THEN substr(array_to_string(list_filter([p, i, o], lambda x: x <> ''), ' '), 1, 120)
        WHEN subject <> '' OR value <> '' THEN array_to_string(list_filter([subject, value], lambda x: x <> ''), ' ') ELSE substr(text, 1, 60) END AS q,
        CASE WHEN topic_type IN {Q.DRUG_TOPICS} AND subject <> '' THEN [subject] ELSE [] END AS drugs, {_case('topic_type', Q.TYPE_EVIDENCE)} AS kind FROM briefs),
    words AS (SELECT *, {_kw(4)}[1:3] AS few, {_kw(3)} AS three, {_kw(6)} AS six, regexp_matches(q, '{Q.TAGGED}') AS tagged FROM asked),
    blocks AS (SELECT *, array_to_string(list_filter([CASE WHEN len(drugs) > 0 THEN '("' || drugs[1] || '"[tiab])' END, CASE WHEN len(diseases) > 0 THEN '(' || array_to_string(list_transform(diseases[1:2], lambda d: '"' || d || '"[tiab]'), ' OR ') || ')' END], lambda x: x IS NOT NULL), ' AND ') AS block,
        array_to_string(list_transform(mesh[1:3], lambda m, n: '"' || m || CASE WHEN n = 1 THEN '"[Majr]' ELSE '"[MeSH Terms]' END), ' AND ') AS vocabulary FROM words),
    based AS (SELECT *, CASE WHEN tagged THEN q WHEN len(mesh) > 0 THEN CASE WHEN len(few) > 0 THEN '(' || vocabulary || ') AND (' || array_to_string(list_transform(few, lambda x: x || '[tiab]'), ' AND ') || ')' ELSE vocabulary END
        WHEN len(drugs) > 0 OR len(diseases) > 0 THEN CASE WHEN (len(drugs) > 0) <> (len(diseases) > 0) AND len(three) > 0 THEN '(' || block || ') AND (' || array_to_string(three, ' ') || '[tiab])' ELSE block END
        WHEN len(six) = 0 THEN q WHEN len(six) <= 3 THEN array_to_string(list_transform(six, lambda x: x || '[tiab]'), ' AND ') ELSE '(' || array_to_string(list_transform(six[1:3], lambda x: x || '[tiab]'), ' AND ') || ') AND (' || array_to_string(six[4:6], ' ') || ')' END AS base,
        NOT tagged AND len(mesh) = 0 AND len(drugs) = 0 AND len(diseases) = 0 AND len(six) = 0 AS bare FROM blocks)"""


def asked(spark, sf):
    rows = briefs(spark, sf)
    main = Q.main_query(F.col("given"), F.col("pico"), F.col("subject"), F.col("value"), F.col("text"))
    return rows.select("*", main.alias("q"), Q.vocabulary_terms(F.col("alternatives")).alias("mesh"), *(c.alias(n) for n, c in Q.topic_options(F.col("topic_type"), F.col("subject")).items()))


@query("literature_queries", f"""WITH {BRIEFS_SQL} SELECT item_id, q AS main, CASE WHEN kind IS NOT NULL AND NOT bare THEN '(' || base || ') AND ' || {_case('kind', Q.TYPE_FILTERS)} ELSE base END AS query, array_to_string(mesh, ',') AS mesh,
    topic_type IN {Q.FOUNDATIONAL} AS prefer_reviews, topic_type IN {Q.RECENT} AS recent_only FROM based""")
def literature_queries(spark, sf):
    """The boolean query of every topic with its options: vocabulary first, else blocks of drugs and diseases, else keywords."""
    rows = asked(spark, sf)
    text = Q.literature_query(F.col("q"), F.col("mesh"), F.col("drugs"), F.col("diseases"), F.col("kind"))
    return rows.select("item_id", F.col("q").alias("main"), text.alias("query"), F.array_join("mesh", ",").alias("mesh"), "prefer_reviews", "recent_only")


PLACES = ("pubmed", "ema", "dailymed")
_MORE = "list_filter(" + str(list(KEYWORDS)) + ", lambda k: NOT contains(lower(q), k))"


@query("register_queries", f"""WITH {BRIEFS_SQL}, n AS (SELECT item_id, subject, provider, q || CASE WHEN len({_MORE}) > 0 THEN ' ' || array_to_string({_MORE}, ' ') ELSE '' END AS q, {list(ASKED_WORDS)}[1 + item_id % 3] || q AS question FROM asked, (SELECT unnest({list(PLACES)}) AS provider))
    SELECT item_id, provider, CASE WHEN provider IN {Q.NAME_REGISTERS} AND subject <> '' AND NOT contains(lower(q), lower(subject)) THEN subject || ' ' || q ELSE q END AS query,
    array_to_string(list_filter(string_split_regex(trim(regexp_replace(regexp_replace(question, '(?i)\\b({Q.NOT_NAMES})\\b', ' ', 'g'), '["''()\\[\\]{{}}<>?!.,;:]', ' ', 'g')), '\\s+'), lambda x: length(x) > 2)[1:3], ' ') AS name FROM n""")
def register_queries(spark, sf):
    """What each provider is asked: the main query with what it lacks of the domain's keywords, the drug's name before it for registers, and the name that a question is about."""
    rows = asked(spark, sf).withColumn("provider", F.explode(F.array(*map(F.lit, PLACES))))
    question = F.concat(F.element_at(F.array(*map(F.lit, ASKED_WORDS)), (1 + F.col("item_id") % 3).cast("int")), "q")
    full = Q.with_keywords(F.col("q"), F.array(*map(F.lit, KEYWORDS)))
    return rows.select("item_id", "provider", Q.with_subject(full, F.col("provider"), F.col("subject")).alias("query"), Q.drug_name(question).alias("name"))


_URL_KEY = "lower(regexp_replace({0}, '/+$', ''))".format


@query("enrichment_by_url", f"""WITH {EVIDENCE}, {PAGES_SQL}, links AS (SELECT page_id, url FROM pages), e AS (SELECT e.topic_id, e.ev_id, CASE WHEN e.ev_id % 3 = 0 THEN substr(e.content, 1, 80) ELSE e.content END AS content, coalesce(l.url || '/', e.url) AS url FROM evidence e LEFT JOIN links l ON l.page_id = e.ev_id),
    fetched AS (SELECT {_URL_KEY('pages.url')} AS key, arg_max(text, length(text) * 1000000000 - page_id) AS text FROM pages JOIN page_text USING (page_id) WHERE text <> '' GROUP BY 1),
    n AS (SELECT *, row_number() OVER (PARTITION BY topic_id ORDER BY ev_id) AS r FROM e WHERE length(coalesce(content, '')) < 150 AND {_listed_sql((*FETCHABLE, 'example.org', 'example.com'))})
    SELECT e.ev_id, CAST(greatest(length(coalesce(e.content, '')), CASE WHEN n.r <= 6 THEN coalesce(length(f.text), 0) ELSE 0 END) AS BIGINT) AS n_chars, coalesce(n.r <= 6 AND length(f.text) > length(coalesce(e.content, '')), false) AS enriched
    FROM e LEFT JOIN n USING (ev_id) LEFT JOIN fetched f ON f.key = {_URL_KEY('e.url')}""")
def enrichment_by_url(spark, sf):
    """Of each topic's first six short records with a url that may be read, those whose page is longer take its text; pages are found by url, the longest of each."""
    url_key = lambda c: F.lower(F.regexp_replace(c, "/+$", ""))
    links = table(spark, sf, "pages").select(F.col("page_id").alias("ev_id"), F.concat("url", F.lit("/")).alias("link"))
    content = F.coalesce(F.when(F.col("ev_id") % 3 == 0, F.substring("content", 1, 80)).otherwise(F.col("content")), F.lit(""))
    e = evidence(spark, sf).select("topic_id", "ev_id", content.alias("content"), "url").join(links, "ev_id", "left").withColumn("url", F.coalesce("link", "url")).drop("link")
    may = host_filter(e.filter(F.length("content") < 150).select("topic_id", "ev_id", "url"), _domains(spark, (*FETCHABLE, "example.org", "example.com")), keep_listed=True)
    first = top_per_group(may, ["topic_id"], ["ev_id"], 6, "r").select("ev_id", url_key(F.col("url")).alias("key"))
    pages = table(spark, sf, "pages").select("page_id", url_key(F.col("url")).alias("key")).join(page_text(spark, sf), "page_id").filter("text <> ''")
    # lengths only: a url that very many pages have is aggregated before the shuffle
    fetched = pages.groupBy("key").agg(F.max(F.length("text")).alias("n"))
    met = e.select("ev_id", F.length("content").alias("own")).join(first.join(fetched, "key", "left").select("ev_id", "n"), "ev_id", "left")
    return met.select("ev_id", F.greatest("own", F.coalesce("n", F.lit(0))).cast("long").alias("n_chars"), F.coalesce(F.col("n") > F.col("own"), F.lit(False)).alias("enriched"))


@query("relaxed_query", f"""WITH {EVIDENCE}, t AS (SELECT item_id, list_filter(w, lambda x, i: list_position(w, x) = i) AS q FROM (SELECT item_id, {tokens_sql('text')} AS w FROM benchmark)), one AS (SELECT item_id, len(q) AS size, unnest(q) AS term, unnest(range(1, len(q) + 1)) AS pos FROM t),
    d AS (SELECT DISTINCT ev_id, unnest({tokens_sql('content')}) AS term FROM evidence), h AS (SELECT item_id, ev_id, count(*) AS n, any_value(size) AS size, count(*) FILTER (pos <= 2) AS lead FROM one JOIN d USING (term) GROUP BY item_id, ev_id),
    l AS (SELECT *, CASE WHEN n = size THEN 0 WHEN lead = least(2, size) THEN 1 ELSE 2 END AS level FROM h), b AS (SELECT *, min(level) OVER (PARTITION BY item_id) AS best FROM l)
    SELECT item_id, ev_id, level, CAST(r AS INTEGER) AS place FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY n DESC, ev_id) AS r FROM b WHERE level = best) WHERE r <= 10""")
def relaxed_query(spark, sf):
    """Ten records by terms in common with the whole query; only the strictest level with a hit counts: all terms, the first two, any."""
    q = table(spark, sf, "benchmark").select("item_id", F.array_distinct(tokenize(F.col("text"))).alias("q"))
    terms = q.select("item_id", F.size("q").alias("size"), F.posexplode("q").alias("at", "term"))
    texts = evidence(spark, sf).select("ev_id", F.explode(F.array_distinct(tokenize(F.col("content")))).alias("term"))
    hits = texts.join(terms, "term").groupBy("item_id", "ev_id", "size").agg(F.count("*").alias("n"), F.count_if(F.col("at") < 2).alias("lead"))
    level = F.when(F.col("n") == F.col("size"), 0).when(F.col("lead") == F.least(F.lit(2), F.col("size")), 1).otherwise(2)
    # ten of each level suffice to know the best level's ten; each partition is cut before the shuffle
    kept = top_per_group(hits.withColumn("level", level), ["item_id", "level"], [F.desc("n"), "ev_id"], 10, "place")
    best = kept.groupBy("item_id").agg(F.min("level").alias("level"))
    return kept.join(best, ["item_id", "level"]).select("item_id", "ev_id", "level", "place")


@query("reported_terms", f"""WITH d AS (SELECT unnest(list_distinct({tokens_sql('text')})) AS term FROM documents), n AS (SELECT term, count(*) AS n FROM d GROUP BY term ORDER BY n DESC, term LIMIT 20), r AS (SELECT *, row_number() OVER (ORDER BY n DESC, term) AS rank FROM n)
    SELECT term, n, CAST(rank AS INTEGER) AS rank, CAST((SELECT sum(n) FROM r WHERE rank <= 15) AS BIGINT) AS shown FROM r WHERE rank <= 15""")
def reported_terms(spark, sf):
    """The fifteen terms that most documents hold, of the first twenty, and the total over those that are shown."""
    terms = table(spark, sf, "documents").select(F.explode(F.array_distinct(tokenize(F.col("text")))).alias("term"))
    first = terms.groupBy("term").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "term").limit(20)
    listed = first.groupBy().agg(F.slice(F.sort_array(F.collect_list(F.struct((-F.col("n")).alias("m"), "term"))), 1, 15).alias("l"))  # twenty rows
    shown = F.aggregate("l", F.lit(0).cast("long"), lambda total, x: total - x["m"])
    return listed.select(F.posexplode("l").alias("at", "x"), shown.alias("shown")).select("x.term", (-F.col("x.m")).alias("n"), (F.col("at") + 1).cast("int").alias("rank"), "shown")


#: Domains and types of topic that are medical.
MEDICAL_DOMAINS = ("medicine", "veterinary_medicine")
MEDICAL_TYPES = ("drug", "dosage", "drug_classification", "mechanism_of_action", "contraindication", "drug_interaction", "adverse_effect", "diagnostic_criteria", "clinical_guideline", "reference_value", "epidemiology", "statistic")
DOMAINS = ("medicine", "law", "veterinary_medicine", "physics", "history")
ROUTED_TYPES = ("Dosage ", "definition", "drug_interaction", "epidemiology", "other", "adverse_effect", "drug")
TAILS = (" prevalence and label", " side effect recall", " they interact", "")
BRIEFED = (("biorxiv", "wikipedia", "nowhere"), ("ema", "who_gho"), ())
_PAIRS = lambda table_: "(VALUES " + ", ".join(f"('{a}', '{b}')" for a, bs in table_.items() for b in bs) + ")"


@query("domain_routing", f"""WITH t AS (SELECT item_id, {list(DOMAINS)}[1 + item_id % 5] AS domain, lower(trim({list(ROUTED_TYPES)}[1 + item_id % 7])) AS type, lower(text) || {list(TAILS)}[1 + item_id % 4] AS text, CASE WHEN item_id % 3 = 0 THEN '' ELSE 'x' END AS subject, {[list(b) for b in BRIEFED]}[1 + item_id % 3] AS brief FROM benchmark),
    m AS (SELECT *, domain IN {MEDICAL_DOMAINS} OR type IN {MEDICAL_TYPES} AS medical FROM t), rules(type, provider) AS {_PAIRS(TYPE_PROVIDERS)}, gates(provider, word) AS {_PAIRS(GATES)},
    c AS (SELECT item_id, unnest({list(LITERATURE)}) AS provider FROM m WHERE medical UNION SELECT item_id, 'wikipedia' FROM m WHERE NOT medical UNION SELECT item_id, provider FROM (SELECT item_id, medical, unnest(brief) AS provider FROM m) WHERE NOT medical OR provider <> 'wikipedia' UNION SELECT item_id, provider FROM m JOIN rules USING (type) WHERE medical),
    k AS (SELECT c.* FROM c JOIN m USING (item_id) WHERE NOT medical OR provider NOT IN (SELECT provider FROM gates) OR (EXISTS (SELECT 1 FROM gates g WHERE g.provider = c.provider AND contains(m.text, g.word)) AND (provider NOT IN {tuple(GATE_NEEDS_SUBJECT)} OR subject <> '')))
    SELECT item_id, string_agg(provider, ',' ORDER BY list_position({list(PROVIDERS)}, provider)) AS providers FROM k WHERE list_contains({list(PROVIDERS)}, provider) GROUP BY item_id""")
def domain_routing(spark, sf):
    """Providers of every topic by its domain, its type and the brief. Rules and gates are short constant tables that topics meet by equality."""
    k = F.col("item_id")
    nth = lambda values, n: F.element_at(F.array(*map(F.lit, values)), (1 + k % n).cast("int"))
    brief = F.element_at(F.array(*(F.array(*map(F.lit, b)) if b else F.array().cast("array<string>") for b in BRIEFED)), (1 + k % 3).cast("int"))
    t = table(spark, sf, "benchmark").select("item_id", nth(DOMAINS, 5).alias("domain"), F.lower(F.trim(nth(ROUTED_TYPES, 7))).alias("type"), F.concat(F.lower("text"), nth(TAILS, 4)).alias("text"), F.when(k % 3 == 0, "").otherwise("x").alias("subject"), brief.alias("brief"))
    t = t.withColumn("medical", F.col("domain").isin(*MEDICAL_DOMAINS) | F.col("type").isin(*MEDICAL_TYPES))
    rules = spark.createDataFrame([(kind, p) for kind, ps in TYPE_PROVIDERS.items() for p in ps], "type string, provider string")
    listed = spark.createDataFrame(list(enumerate(PROVIDERS)), "place int, provider string")
    own = F.when(F.col("medical"), F.concat(F.array(*map(F.lit, LITERATURE)), F.filter("brief", lambda p: p != "wikipedia"))).otherwise(F.array_append("brief", F.lit("wikipedia")))
    chosen = t.select("item_id", F.explode(own).alias("provider")).union(t.filter("medical").join(F.broadcast(rules), "type").select("item_id", "provider")).distinct()
    # which gated providers a topic's words open
    opened = F.array_compact(F.array(*(F.when(F.exists(F.array(*map(F.lit, words)), lambda w: F.contains(F.col("text"), w)) & (F.lit(g not in GATE_NEEDS_SUBJECT) | (F.col("subject") != "")), F.lit(g)) for g, words in GATES.items())))
    gated = chosen.join(t.select("item_id", "medical", opened.alias("opened")), "item_id")
    kept = gated.filter(~F.col("medical") | ~F.col("provider").isin(*GATES) | F.array_contains("opened", F.col("provider"))).join(F.broadcast(listed), "provider")
    return kept.groupBy("item_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("place", "provider"))), lambda x: x["provider"]), ",").alias("providers"))
