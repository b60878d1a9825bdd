"""Queries of text functions, pages, query building and small joins."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quarry.functions import text as T
from quarry.operators.retrieve import top_per_group
from quarry.operators.sections import density, trim_sections
from quarry.operators.patterns import match_patterns, redact_known
from quarry.plans.registry import query
from quarry.plans.retrieval import tokens_sql
from quarry.sources.dumps import run_pending
from quarry.sources.tables import EVIDENCE, evidence, table
from quarry.storage import shared_dir

#: What marks a page that only lists meanings, and the preprint servers with their DOI prefix.
DISAMBIGUATION = ("può riferirsi a:", "può indicare:", "may refer to:", "may also refer to:", "disambiguation")
SERVERS, PREPRINT_DOI = ("biorxiv", "medrxiv"), "10.1101/"


@query("disambiguation_filter", f"""WITH d AS (SELECT doc_id, CASE WHEN doc_id % 9 = 0 THEN 'It May refer to: ' || text ELSE text END AS text FROM documents) SELECT doc_id FROM d WHERE NOT ({' OR '.join(f"contains(lower(substr(text, 1, 200)), '{p}')" for p in DISAMBIGUATION)})""")
def disambiguation_filter(spark, sf):
    text = F.when(F.col("doc_id") % 9 == 0, F.concat(F.lit("It May refer to: "), "text")).otherwise(F.col("text"))
    start = F.lower(F.substring(text, 1, 200))
    found = F.lit(False)
    for p in DISAMBIGUATION:
        found = found | F.contains(start, F.lit(p))
    return table(spark, sf, "documents").filter(~found).select("doc_id")


@query("preprint_filter", f"""WITH {EVIDENCE}, x AS (SELECT ev_id, CASE WHEN ev_id % 8 = 0 THEN ' medRxiv ' ELSE source_type END AS server, CASE WHEN ev_id % 6 = 0 THEN '10.1101/' || ev_id ELSE '10.1000/' || ev_id END AS doi FROM evidence)
    SELECT ev_id FROM x WHERE lower(trim(server)) IN ('biorxiv', 'medrxiv') OR starts_with(doi, '10.1101/')""")
def preprint_filter(spark, sf):
    server = F.when(F.col("ev_id") % 8 == 0, " medRxiv ").otherwise(F.col("source_type"))
    doi = F.when(F.col("ev_id") % 6 == 0, F.concat(F.lit("10.1101/"), F.col("ev_id").cast("string"))).otherwise(F.concat(F.lit("10.1000/"), F.col("ev_id").cast("string")))
    return evidence(spark, sf).filter(F.lower(F.trim(server)).isin(*SERVERS) | F.startswith(doi, F.lit(PREPRINT_DOI))).select("ev_id")


PAGE_TEXT_SQL = "html"
for _tag in ("script", "style", "nav", "header", "footer"):
    PAGE_TEXT_SQL = f"regexp_replace({PAGE_TEXT_SQL}, '(?is)<{_tag}(?:\\s[^>]*)?>.*?</{_tag}>', ' ', 'g')"
PAGE_TEXT_SQL = f"regexp_replace({PAGE_TEXT_SQL}, '(?is)<h[1-6](?:\\s[^>]*)?>(.*?)</h[1-6]>', chr(1) || '\\1' || chr(2), 'g')"
PAGE_TEXT_SQL = f"regexp_replace(regexp_replace({PAGE_TEXT_SQL}, '<[^>]+>', ' ', 'g'), '\\s+', ' ', 'g')"
PAGE_TEXT_SQL = f"trim(regexp_replace({PAGE_TEXT_SQL}, chr(1) || '([^' || chr(1) || chr(2) || ']*)' || chr(2), chr(10) || '## \\1' || chr(10), 'g'))"
PAGES_SQL = f"page_text AS (SELECT page_id, url, CASE WHEN length(t) < 150 THEN '' ELSE substr(t, 1, 150000) END AS text FROM (SELECT page_id, url, {PAGE_TEXT_SQL} AS t FROM pages))"


def page_text(spark, sf):
    return table(spark, sf, "pages").select("page_id", "url", T.html_to_text(F.col("html")).alias("text"))


@query("html_to_text", f"WITH {PAGES_SQL} SELECT page_id, text, substr(sha256(text), 1, 16) AS content_hash FROM page_text")
def html_to_text(spark, sf):
    return page_text(spark, sf).select("page_id", "text", T.content_hash(F.col("text")).alias("content_hash"))


SECTIONS_SQL = rf"""{PAGES_SQL}, parts AS (SELECT page_id, list_filter(string_split(regexp_replace(text, '(?m)^(##[ \t]+\S)', chr(1) || '\1', 'g'), chr(1)), lambda p: p <> '') AS p FROM page_text),
    sections AS (SELECT page_id, unnest(range(0, len(p))) AS position, unnest(p) AS section FROM parts)"""


@query("split_sections", rf"WITH {SECTIONS_SQL} SELECT page_id, position, trim(regexp_extract(section, '^##[ \t]+([^\n]+)', 1)) AS name, CAST(length(section) AS BIGINT) AS n_chars FROM sections")
def split_sections(spark, sf):
    rows = page_text(spark, sf).select("page_id", F.posexplode(T.sections(F.col("text"))).alias("position", "section"))
    return rows.select("page_id", F.col("position").cast("long").alias("position"), T.section_name(F.col("section")).alias("name"), F.length("section").cast("long").alias("n_chars"))


HEADINGS = ("Results and Discussion", "2. Methods", "Funding", "Patients", "Background", "References")
_PRIORITY_SQL = "CASE " + " ".join(f"WHEN contains(low, '{w}') THEN NULL" for w in T.SKIPPED_SECTIONS) + " " + " ".join(f"WHEN contains(low, '{w}') THEN {k}" for k, w in enumerate(T.BIOMED_PRIORITY)) + f" ELSE {len(T.BIOMED_PRIORITY)} END"


@query("section_priority", rf"""WITH {SECTIONS_SQL}, n AS (SELECT page_id, position, lower({list(HEADINGS)}[1 + (page_id + position) % 6] || ' ' || trim(regexp_extract(section, '^##[ \t]+([^\n]+)', 1))) AS low FROM sections)
    SELECT page_id, position, CAST(CASE WHEN {' OR '.join(f"contains(low, '{w}')" for w in T.SKIPPED_SECTIONS)} THEN NULL ELSE {_PRIORITY_SQL} END AS INTEGER) AS priority FROM n""")
def section_priority(spark, sf):
    """Rank of each section of a page by what its heading says; null for boilerplate."""
    rows = page_text(spark, sf).select("page_id", F.posexplode(T.sections(F.col("text"))).alias("position", "section"))
    heading = F.concat(F.element_at(F.array(*map(F.lit, HEADINGS)), (1 + (F.col("page_id") + F.col("position")) % 6).cast("int")), F.lit(" "), T.section_name(F.col("section")))
    return rows.select("page_id", F.col("position").cast("long").alias("position"), T.section_priority(heading).alias("priority"))


@query("fair_share_trim", rf"""WITH {SECTIONS_SQL}, s AS (SELECT page_id, position, length(section) AS n, CASE WHEN position = 0 THEN -1 ELSE length(section) % 3 END AS priority, count(*) OVER (PARTITION BY page_id) AS k FROM sections),
    w AS (SELECT *, least(n, 600 // k) AS base, greatest(0, n - 600 // k) AS want, 600 - sum(least(n, 600 // k)) OVER (PARTITION BY page_id) AS slack FROM s),
    a AS (SELECT *, base + greatest(0, least(want, slack - coalesce(sum(want) OVER (PARTITION BY page_id ORDER BY priority, position ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))) AS granted FROM w) SELECT page_id, position, CAST(granted AS BIGINT) AS granted FROM a WHERE granted > 0""")
def fair_share_trim(spark, sf, budget: int = 600):
    """Characters granted to each section: an equal share, and what others leave in order of priority; all within the page's row."""
    n = lambda x: F.length(x).cast("long")
    parts = F.transform(T.sections(F.col("text")), lambda x, i: F.struct(F.when(i == 0, -1).otherwise(n(x) % 3).cast("long").alias("priority"), i.cast("long").alias("position"), n(x).alias("n")))
    pages = page_text(spark, sf).select("page_id", F.sort_array(parts).alias("parts")).filter(F.size("parts") > 0).withColumn("share", F.floor(F.lit(budget) / F.size("parts")))
    pages = pages.withColumn("slack", F.aggregate("parts", F.lit(budget).cast("long"), lambda rest, p: rest - F.least(p["n"], F.col("share"))))
    start = F.struct(F.lit(0).cast("long").alias("wanted"), F.array().cast("array<struct<position: bigint, granted: bigint>>").alias("out"))

    def grant(state, p):
        want = F.greatest(F.lit(0).cast("long"), p["n"] - F.col("share"))
        given = F.least(p["n"], F.col("share")) + F.greatest(F.lit(0).cast("long"), F.least(want, F.col("slack") - state["wanted"]))
        return F.struct((state["wanted"] + want).alias("wanted"), F.array_append(state["out"], F.struct(p["position"].alias("position"), given.alias("granted"))).alias("out"))

    grants = F.aggregate("parts", start, grant, lambda state: state["out"])
    return pages.select("page_id", F.explode(grants).alias("g")).select("page_id", "g.position", "g.granted").filter("granted > 0")


#: Sections of an encyclopaedia that never count.
WIKI_SKIPPED = ("voci correlate", "see also", "note", "references", "bibliography", "bibliografia", "collegamenti esterni", "external links", "altri progetti")

_HEADED = f"""headed AS (SELECT page_id, position, CASE WHEN starts_with(section, '## ') THEN '## ' || {list(HEADINGS)}[1 + (page_id + position) % 6] || substr(section, 3) ELSE section END AS section FROM sections)"""


def _trim_sql(budget: int, words: tuple[str, ...], rank: str) -> str:
    skipped = " OR ".join(f"contains(low, '{w}')" for w in words)
    return rf"""WITH {SECTIONS_SQL}, {_HEADED}, named AS (SELECT *, length(section) AS n, lower(trim(regexp_extract(section, '^##[ \t]+([^\n]+)', 1))) AS low, sum(length(section)) OVER (PARTITION BY page_id) AS total FROM headed),
    kept AS (SELECT *, position > 0 AS rest, {rank} AS rank, {budget} // count(*) OVER (PARTITION BY page_id) AS share FROM named WHERE position = 0 OR NOT ({skipped})),
    w AS (SELECT *, least(n, share) AS base, greatest(0, n - share) AS want, {budget} - sum(least(n, share)) OVER (PARTITION BY page_id) AS slack FROM kept),
    g AS (SELECT *, base + greatest(0, least(want, slack - coalesce(sum(want) OVER (PARTITION BY page_id ORDER BY rest, rank, position ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))) AS granted FROM w),
    cut AS (SELECT page_id, string_agg(substr(section, 1, granted::BIGINT), '' ORDER BY rest, rank, position) AS text FROM g GROUP BY page_id), whole AS (SELECT page_id, string_agg(section, '' ORDER BY position) AS text, any_value(total) AS total FROM named GROUP BY page_id)
    SELECT page_id, coalesce(CASE WHEN whole.total <= {budget} THEN whole.text ELSE cut.text END, '') AS text FROM page_text LEFT JOIN whole USING (page_id) LEFT JOIN cut USING (page_id)"""


def _headed(spark, sf):
    """Pages whose headings say what kind of section follows."""
    kind = lambda k: F.element_at(F.array(*map(F.lit, HEADINGS)), (1 + (F.col("page_id") + k) % 6).cast("int"))
    renamed = F.transform(T.sections(F.col("text")), lambda s, k: F.when(F.startswith(s, F.lit("## ")), F.concat(F.lit("## "), kind(k), F.substring(s, F.lit(3), F.length(s)))).otherwise(s))
    return page_text(spark, sf).select("page_id", F.array_join(renamed, "").alias("text"))


@query("trim_sections", _trim_sql(600, T.SKIPPED_SECTIONS, "CASE " + " ".join(f"WHEN contains(low, '{w}') THEN {k}" for k, w in enumerate(T.BIOMED_PRIORITY)) + f" ELSE {len(T.BIOMED_PRIORITY)} END"))
def trimmed_by_priority(spark, sf):
    """Pages cut to 600 characters by the priority of their sections."""
    return trim_sections(_headed(spark, sf), "text", 600)


@query("trim_by_density", _trim_sql(900, WIKI_SKIPPED, "-(len(regexp_extract_all(section, '[0-9]+')) * 0.5 + len(regexp_extract_all(section, '[0-9]{4}')) * 1.5 + least(n / 500, 3.0) + CASE WHEN n > 200 THEN 1.0 ELSE 0.3 END)::DOUBLE"))
def trimmed_by_density(spark, sf):
    """Pages cut to 900 characters by how many numbers, years and characters a section has."""
    return trim_sections(_headed(spark, sf), "text", 900, skip=WIKI_SKIPPED, score=density)


_MARK = r"((?:\[\d+\]\s*)+[.,;:!?]?)"
CHUNKS_SQL = rf"""lines AS (SELECT conv_id, turn, unnest(range(0, len(l))) AS line, unnest(l) AS text FROM (SELECT conv_id, turn, string_split(text, chr(10)) AS l FROM conversations)),
    marked AS (SELECT conv_id, turn, line, CASE WHEN line % 4 = 3 THEN text ELSE replace(text, '. ', ' [' || (turn + 1) || '][' || (line + 2) || ']. ') END AS text FROM lines),
    chunks AS (SELECT conv_id, turn, line, unnest(range(0, len(c))) AS position, unnest(c) AS chunk FROM (SELECT conv_id, turn, line, list_filter(list_transform(string_split(regexp_replace(text, '{_MARK}', '\1' || chr(1), 'g'), chr(1)), lambda p: trim(p)), lambda p: trim(regexp_replace(p, '{_MARK}', '', 'g')) <> '') AS c FROM marked))"""


def chunks_of_turns(spark, sf):
    """conv_id, turn, line, position, chunk, the numbers that it cites (marks), and its words without emphasis marks."""
    lines = table(spark, sf, "conversations").select("conv_id", "turn", F.posexplode(F.split("text", "\n")).alias("line", "text"))
    mark = F.concat(F.lit(" ["), (F.col("turn") + 1).cast("string"), F.lit("]["), (F.col("line") + 2).cast("string"), F.lit("]. "))
    text = F.when(F.col("line") % 4 == 3, F.col("text")).otherwise(F.replace("text", F.lit(". "), mark))
    chunks = lines.select("conv_id", "turn", F.col("line").cast("long").alias("line"), F.posexplode(T.citation_chunks(text)).alias("position", "chunk"))
    words = F.size(F.filter(F.split(F.translate("chunk", "*_", ""), " "), lambda w: w != ""))
    return chunks.select("conv_id", "turn", "line", F.col("position").cast("long").alias("position"), "chunk", T.cited(F.col("chunk")).alias("marks"), words.alias("words"))


@query("citation_chunks", rf"""WITH {CHUNKS_SQL} SELECT conv_id, turn, line, position, chunk, array_to_string(regexp_extract_all(chunk, '\[(\d+)\]', 1), ',') AS cited, len(regexp_extract_all(chunk, '\[\d+\]')) = 0 AND len(list_filter(string_split(translate(chunk, '*_', ''), ' '), lambda w: w <> '')) >= 6 AS uncited FROM chunks""")
def citation_chunks(spark, sf):
    """Chunks of prose by the citations that end them; an uncited one counts from six words."""
    return chunks_of_turns(spark, sf).select("conv_id", "turn", "line", "position", "chunk", F.array_join(F.col("marks").cast("array<string>"), ",").alias("cited"), ((F.size("marks") == 0) & (F.col("words") >= 6)).alias("uncited"))


_FOLD = r"lower(trim(regexp_replace({0}, '\s+', ' ', 'g')))"

#: Letters that a made-up quote has in upper case: engines fold the others differently.
_SMALL = "abcdefghijklmnopqrstuvwxyz"

QUOTES_SQL = f"""WITH q AS (SELECT doc_id, text, CASE doc_id % 4 WHEN 0 THEN translate(substr(text, 10, 60), '{_SMALL}', '{_SMALL.upper()}') WHEN 1 THEN replace(substr(text, 5, 80), ' ', '  ') WHEN 2 THEN 'not there at all' ELSE '' END AS quote FROM documents)
    SELECT doc_id, {_FOLD.format('quote')} <> '' AND contains({_FOLD.format('text')}, {_FOLD.format('quote')}) AS grounded FROM q"""


def _quotes(docs):
    k = F.col("doc_id")
    quote = F.when(k % 4 == 0, F.translate(F.substring("text", 10, 60), _SMALL, _SMALL.upper())).when(k % 4 == 1, F.replace(F.substring("text", 5, 80), F.lit(" "), F.lit("  "))).when(k % 4 == 2, "not there at all").otherwise("")
    return docs.select("doc_id", T.quote_grounded(F.col("text"), quote).alias("grounded"))


@query("quote_grounding_all", QUOTES_SQL)
@query("quote_grounding", QUOTES_SQL)
def quote_grounding(spark, sf):
    return _quotes(table(spark, sf, "documents"))


SECRET = (r"""(?i)(api[_-]?key=)[^&\s"']+""", r"""(token = ")[0-9a-f]+""")


@query("redact_secrets", r"""SELECT doc_id, t <> x AS changed, t AS text FROM (SELECT doc_id, x, regexp_replace(regexp_replace(replace(x, 'hunter2', '[redacted]'), '(?i)(api[_-]?key=)[^&\s"'']+', '\1[redacted]', 'g'), '(token = ")[0-9a-f]+', '\1[redacted]', 'g') AS t
    FROM (SELECT doc_id, CASE doc_id % 6 WHEN 0 THEN text || ' ?API_key=ab12&x=1' WHEN 1 THEN text || ' hunter2' ELSE text END AS x FROM documents))""")
def redact_secrets(spark, sf):
    k = F.col("doc_id")
    x = F.when(k % 6 == 0, F.concat("text", F.lit(" ?API_key=ab12&x=1"))).when(k % 6 == 1, F.concat("text", F.lit(" hunter2"))).otherwise(F.col("text"))
    rows = table(spark, sf, "documents").select("doc_id", x.alias("x")).withColumn("text", T.redact(F.col("x"), SECRET, ("hunter2",)))
    return rows.select("doc_id", (F.col("text") != F.col("x")).alias("changed"), "text")


@query("query_key", r"""SELECT item_id, sha256('pubmed:' || array_to_string(list_sort(list_filter(regexp_split_to_array(regexp_replace(lower(text), '[^\p{L}\p{N}_\s]', '', 'g'), '\s+'), lambda w: w <> '')), ' ')) AS key FROM benchmark""")
def query_key(spark, sf):
    return table(spark, sf, "benchmark").select("item_id", T.query_key(F.col("text"), F.lit("pubmed")).alias("key"))


@query("query_shaping", f"""WITH t AS (SELECT item_id, {tokens_sql('text')} AS w FROM benchmark) SELECT item_id, array_to_string(list_filter(w, lambda x: length(x) > 2)[1:8], ' ') AS strict, array_to_string(list_filter(w, lambda x: length(x) > 3)[1:4], ' ') AS broad FROM t""")
def query_shaping(spark, sf):
    """The first eight terms of over two characters, and the broadened form of four of over three."""
    w = T.tokenize(F.col("text"))
    form = lambda least, n: F.array_join(F.slice(F.filter(w, lambda x: F.length(x) > least), 1, n), " ")
    return table(spark, sf, "benchmark").select("item_id", form(2, 8).alias("strict"), form(3, 4).alias("broad"))


@query("boolean_query", f"""WITH t AS (SELECT item_id, {tokens_sql('text')}[1:4] AS w FROM benchmark) SELECT item_id, '(' || array_to_string(list_transform(w, lambda x: '"' || x || '"[Title/Abstract]'), ' AND ') || ')' || CASE WHEN item_id % 2 = 0 THEN ' AND Review[Publication Type]' ELSE '' END AS q,
    array_to_string(regexp_extract_all(array_to_string(list_transform(w, lambda x: '"' || x || '"[MeSH Terms]'), ' OR '), '"([^"]+)"\\[MeSH Terms\\]', 1), ',') AS mesh FROM t""")
def boolean_query(spark, sf):
    w = F.slice(T.tokenize(F.col("text")), 1, 4)
    tagged = lambda tag, by: F.array_join(F.transform(w, lambda x: F.concat(F.lit('"'), x, F.lit(f'"[{tag}]'))), by)
    q = F.concat(F.lit("("), tagged("Title/Abstract", " AND "), F.lit(")"), F.when(F.col("item_id") % 2 == 0, " AND Review[Publication Type]").otherwise(""))
    mesh = F.regexp_extract_all(tagged("MeSH Terms", " OR "), F.lit(r'"([^"]+)"\[MeSH Terms\]'), F.lit(1))
    return table(spark, sf, "benchmark").select("item_id", q.alias("q"), F.array_join(mesh, ",").alias("mesh"))


@query("query_plan", f"""WITH t AS (SELECT item_id, text, {tokens_sql('text')} AS w FROM benchmark), p AS (SELECT item_id, [text, array_to_string(w[1:3], ' '), array_to_string(w[1:3], ' '), array_to_string(w[2:4], ' ')] || [w[1], w[2]] || [w[1] || ' review', text] AS q FROM t)
    SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY i) AS INTEGER) AS position, query FROM (SELECT item_id, query, min(i) AS i FROM (SELECT item_id, unnest(q) AS query, unnest(range(0, len(q))) AS i FROM p) WHERE query IS NOT NULL AND query <> '' GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY i) <= 5""")
def query_plan(spark, sf):
    """The topic's own text first, then variants, hints and axes without repeats; at most five."""
    w = T.tokenize(F.col("text"))
    join = lambda a: F.array_join(F.slice(w, a, 3), " ")
    one = lambda k: F.try_element_at(w, F.lit(k))
    every = F.array(F.col("text"), join(1), join(1), join(2), one(1), one(2), F.concat(one(1), F.lit(" review")), F.col("text"))
    plan = F.slice(F.filter(F.array_distinct(F.array_compact(every)), lambda q: q != ""), 1, 5)
    return table(spark, sf, "benchmark").select("item_id", F.posexplode(plan).alias("at", "query")).select("item_id", (F.col("at") + 1).cast("int").alias("position"), "query")


@query("content_enrichment", f"""WITH {EVIDENCE}, {PAGES_SQL}, e AS (SELECT topic_id, ev_id, CASE WHEN ev_id % 5 = 0 THEN substr(content, 1, 80) ELSE content END AS content, ev_id AS page FROM evidence), n AS (SELECT *, row_number() OVER (PARTITION BY topic_id ORDER BY ev_id) AS r FROM e WHERE length(content) < 150)
    SELECT e.ev_id, CASE WHEN n.r <= 6 AND length(p.text) > length(e.content) THEN length(p.text) ELSE length(e.content) END::BIGINT AS n_chars, coalesce(n.r <= 6 AND length(p.text) > length(e.content), false) AS enriched FROM e LEFT JOIN n USING (ev_id) LEFT JOIN page_text p ON p.page_id = e.page""")
def content_enrichment(spark, sf):
    """Of each topic's first six records of under 150 characters, those whose fetched page is longer take its text."""
    e = evidence(spark, sf).select("topic_id", "ev_id", F.when(F.col("ev_id") % 5 == 0, F.substring("content", 1, 80)).otherwise(F.col("content")).alias("content"))
    short = top_per_group(e.filter(F.length("content") < 150).select("topic_id", "ev_id"), ["topic_id"], ["ev_id"], 6, "r").select("ev_id", "r")
    pages = page_text(spark, sf).select(F.col("page_id").alias("ev_id"), F.col("text").alias("fetched"))
    met = e.join(short, "ev_id", "left").join(pages, "ev_id", "left")
    longer = F.coalesce(F.col("r").isNotNull() & (F.length("fetched") > F.length("content")), F.lit(False))
    return met.select("ev_id", F.when(longer, F.length("fetched")).otherwise(F.length("content")).cast("long").alias("n_chars"), longer.alias("enriched"))


@query("resolve_name", """WITH names AS (SELECT c_custkey AS k, CASE WHEN c_custkey % 3 = 0 THEN 'nobody' ELSE lower('Brand#' || (10 + c_custkey % 50)) END AS name FROM customer), c AS (SELECT lower(p_brand) AS name, min(p_partkey) AS concept FROM part GROUP BY 1)
    SELECT k, names.name, coalesce(p_type, names.name) AS resolved, concept IS NOT NULL AS matched FROM names LEFT JOIN c USING (name) LEFT JOIN part ON p_partkey = concept""")
def resolve_name(spark, sf):
    """Name to concept to related name; what isn't known stays with matched false."""
    k = F.col("c_custkey")
    names = table(spark, sf, "customer").select(k.alias("k"), F.when(k % 3 == 0, "nobody").otherwise(F.lower(F.concat(F.lit("Brand#"), (10 + k % 50).cast("string")))).alias("name"))
    part = table(spark, sf, "part")
    concepts = part.groupBy(F.lower("p_brand").alias("name")).agg(F.min_by("p_type", "p_partkey").alias("kind"))
    return names.join(concepts, "name", "left").select("k", "name", F.coalesce("kind", "name").alias("resolved"), F.col("kind").isNotNull().alias("matched"))


@query("attach_children", """WITH r AS (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS n FROM orders)
    SELECT c_custkey, coalesce(string_agg(o_orderkey::VARCHAR, ',' ORDER BY n), '') AS children FROM customer LEFT JOIN (SELECT * FROM r WHERE n <= 5) ON o_custkey = c_custkey GROUP BY c_custkey""")
def attach_children(spark, sf):
    """Each parent with at most five children, the largest first."""
    top = top_per_group(table(spark, sf, "orders"), ["o_custkey"], [F.desc("o_totalprice"), "o_orderkey"], 5, "n")
    lists = top.groupBy("o_custkey").agg(F.sort_array(F.collect_list(F.struct("n", "o_orderkey"))).alias("c"))
    text = F.array_join(F.transform("c", lambda x: x["o_orderkey"].cast("string")), ",")
    return table(spark, sf, "customer").select("c_custkey").join(lists, F.col("c_custkey") == F.col("o_custkey"), "left").select("c_custkey", F.coalesce(text, F.lit("")).alias("children"))


@query("resumable_pending", "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def resumable_pending(spark, sf):
    """Rows that an earlier run hasn't finished."""
    return table(spark, sf, "documents").select("doc_id").join(table(spark, sf, "labels").select("doc_id"), "doc_id", "left_anti")


@query("resumable_run", "SELECT doc_id, CASE WHEN NOT contains(t, 'the the') AND t <> '' THEN length(t)::DOUBLE END AS value, CASE WHEN contains(t, 'the the') OR t = '' THEN 'unreadable' END AS error FROM (SELECT doc_id, coalesce(min(text), '') AS t FROM documents GROUP BY doc_id)")
def resumable_run(spark, sf):
    """Every text evaluated once over two runs into one folder; failures stay as rows, and the second run finds nothing left to do."""

    def measure(text):
        if not text or "the the" in text:
            raise ValueError("unreadable")
        return len(text)

    docs, path = table(spark, sf, "documents").select("doc_id", F.col("text").alias("input")), f"{shared_dir(spark)}/run-{uuid.uuid4().hex}"
    run_pending(docs, path, measure, "doc_id", parts=2)
    return run_pending(docs, path, measure, "doc_id")


@query("stratified_sample", """SELECT doc_id, lang FROM (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY md5('7:' || doc_id), doc_id) AS r FROM (SELECT min(doc_id) AS doc_id, lang FROM documents GROUP BY lang, text)) WHERE r <= 30""")
def stratified_sample(spark, sf):
    """Thirty of each stratum after dropping repeated bodies, by a seeded hash and so the same each time."""
    once = table(spark, sf, "documents").groupBy("lang", F.sha2("text", 256).alias("body")).agg(F.min("doc_id").alias("doc_id"))
    return top_per_group(once, ["lang"], [F.md5(F.concat(F.lit("7:"), F.col("doc_id").cast("string"))), "doc_id"], 30, "r").select("doc_id", "lang")


#: How many labelled documents a question must have, and how many questions of a type are drawn.
LABELLED, PER_TYPE = (3, 12), 20
#: Orders stand for questions here, their priority for the type, their customer for the body and their lines for labelled documents.
DRAWN_TYPES = ("1-URGENT", "2-HIGH")


@query("stratified_questions", f"""WITH n AS (SELECT l_orderkey, count(DISTINCT l_partkey) AS n FROM lineitem GROUP BY 1), q AS (SELECT min(o_orderkey) AS id, o_orderpriority AS type, o_custkey AS body FROM orders JOIN n ON l_orderkey = o_orderkey WHERE o_orderpriority IN {DRAWN_TYPES} AND n BETWEEN {LABELLED[0]} AND {LABELLED[1]} GROUP BY type, body),
    once AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY body ORDER BY id) AS again FROM q) WHERE again = 1) SELECT id, type FROM (SELECT *, row_number() OVER (PARTITION BY type ORDER BY md5('42:' || id), id) AS r FROM once) WHERE r <= {PER_TYPE}""")
def stratified_questions(spark, sf):
    """Questions of some types with three to twelve labelled documents, each body once, at most twenty of a type by a seeded hash."""
    labelled = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(F.countDistinct("l_partkey").alias("n")).filter(F.col("n").between(*LABELLED))
    asked = table(spark, sf, "orders").filter(F.col("o_orderpriority").isin(*DRAWN_TYPES)).select(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("type"), F.col("o_custkey").alias("body"))
    once = asked.join(labelled, "id").groupBy("body").agg(F.min(F.struct("id", "type")).alias("q")).select("q.id", "q.type")
    return top_per_group(once, ["type"], [F.md5(F.concat(F.lit("42:"), F.col("id").cast("string"))), "id"], PER_TYPE, "r").select("id", "type")


@query("disjoint_resample", """WITH once AS (SELECT min(doc_id) AS doc_id, lang FROM documents GROUP BY lang, text), used AS (SELECT doc_id FROM (SELECT doc_id, row_number() OVER (PARTITION BY lang ORDER BY md5('7:' || doc_id), doc_id) AS r FROM once) WHERE r <= 30)
    SELECT doc_id, lang FROM (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY md5('8:' || doc_id), doc_id) AS r FROM once WHERE doc_id NOT IN (SELECT doc_id FROM used)) WHERE r <= 30""")
def disjoint_resample(spark, sf):
    """Another thirty of each stratum, by another seed, of which none is in ``stratified_sample``."""
    once = table(spark, sf, "documents").groupBy("lang", F.sha2("text", 256).alias("body")).agg(F.min("doc_id").alias("doc_id"))
    rest = once.join(stratified_sample(spark, sf).select("doc_id"), "doc_id", "left_anti")
    return top_per_group(rest, ["lang"], [F.md5(F.concat(F.lit("8:"), F.col("doc_id").cast("string"))), "doc_id"], 30, "r").select("doc_id", "lang")


#: Words that don't count when a predicted element is held against gold.
OVERLAP_STOPWORDS = tuple("a an and are as at be been by for from had has have in into is it its of on or that the their this to was were with which who whom".split())


def overlap_tokens(text):
    """Distinct words of two letters or more, plurals folded: ``ies`` to ``y`` in words of over four letters, a last ``s`` off in words of over three."""
    words = F.filter(F.split(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), "[^a-z0-9]+", " "), " "), lambda w: (F.length(w) > 1) & ~w.isin(*OVERLAP_STOPWORDS))
    one = lambda w: F.when((F.length(w) > 4) & F.endswith(w, F.lit("ies")), F.regexp_replace(w, "ies$", "y")).when((F.length(w) > 3) & F.endswith(w, F.lit("s")), F.regexp_replace(w, "s$", "")).otherwise(w)
    return F.array_distinct(F.transform(words, one))


def _overlap_sql(text: str) -> str:
    stop = ", ".join(f"'{w}'" for w in OVERLAP_STOPWORDS)
    return f"""list_distinct(list_transform(list_filter(string_split(regexp_replace(lower(coalesce({text}, '')), '[^a-z0-9]+', ' ', 'g'), ' '), lambda w: length(w) > 1 AND NOT list_contains([{stop}], w)),
        lambda w: CASE WHEN length(w) > 4 AND ends_with(w, 'ies') THEN regexp_replace(w, 'ies$', 'y') WHEN length(w) > 3 AND ends_with(w, 's') THEN regexp_replace(w, 's$', '') ELSE w END))"""


OVERLAP_SQL = f"""{EVIDENCE}, t AS (SELECT ev_id, source_type, {_overlap_sql('title')} AS a, {_overlap_sql("substr(snippet, 40)")} AS b FROM evidence), o AS (SELECT ev_id, source_type, len(a) AS na, len(b) AS nb, len(list_intersect(a, b)) AS n FROM t),
    overlap AS (SELECT ev_id, source_type, na = 0 AS empty, nb AS n_gold, n > 0 AS hit, CASE WHEN na > 0 THEN n / na END AS precision, CASE WHEN nb > 0 THEN n / nb END AS recall, CASE WHEN n > 0 THEN 2 * (n / na) * (n / nb) / (n / na + n / nb) ELSE 0.0 END AS f1 FROM o)"""


def overlap(spark, sf):
    """A title as the prediction and the rest of the snippet as gold: ev_id, source_type, empty, n_gold, hit, precision, recall, f1."""
    rows = evidence(spark, sf).select("ev_id", "source_type", overlap_tokens(F.col("title")).alias("a"), overlap_tokens(F.substring("snippet", 40, 300)).alias("b")).withColumn("n", F.size(F.array_intersect("a", "b")))
    p, r = F.try_divide("n", F.size("a")), F.try_divide("n", F.size("b"))
    return rows.select("ev_id", "source_type", (F.size("a") == 0).alias("empty"), F.size("b").alias("n_gold"), (F.col("n") > 0).alias("hit"), p.alias("precision"), r.alias("recall"), F.when(F.col("n") > 0, 2 * p * r / (p + r)).otherwise(0.0).alias("f1"))


@query("token_overlap", f"WITH {OVERLAP_SQL} SELECT ev_id, hit, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1 FROM overlap")
def token_overlap(spark, sf):
    """Precision, recall and F1 of one text's folded words against another's; precision and recall are null where their side is empty."""
    return overlap(spark, sf).select("ev_id", "hit", *(F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")))


@query("overlap_report", f"""WITH {OVERLAP_SQL} SELECT source_type, count(*) AS n, round(avg(hit::INT), 6) AS hit_rate, round(coalesce(avg(precision), 0), 6) AS precision, round(coalesce(avg(recall), 0), 6) AS recall, round(avg(empty::INT), 6) AS empty_rate, round(avg(n_gold), 6) AS mean_gold
    FROM overlap GROUP BY source_type""")
def overlap_report(spark, sf):
    """Means of a block: precision over what was predicted, recall over what has gold, 0 where there is none."""
    mean = lambda c: F.round(F.coalesce(F.avg(c), F.lit(0.0)), 6)
    return overlap(spark, sf).groupBy("source_type").agg(
        F.count("*").alias("n"), mean(F.col("hit").cast("int")).alias("hit_rate"), mean("precision").alias("precision"), mean("recall").alias("recall"), mean(F.col("empty").cast("int")).alias("empty_rate"), mean("n_gold").alias("mean_gold"))


SPANS_SQL = """WITH w AS (SELECT doc_id, unnest(range(0, len(w))) AS position, unnest(w) AS word FROM (SELECT doc_id, string_split(text, ' ') AS w FROM documents)), m AS (SELECT *, length(word) >= 5 AS mark FROM w),
    g AS (SELECT *, position - row_number() OVER (PARTITION BY doc_id ORDER BY position) AS island FROM m WHERE mark) SELECT doc_id, min(position) AS start, string_agg(word, ' ' ORDER BY position) AS span FROM g GROUP BY doc_id, island"""


def spans(docs):
    """Runs of marked words, as text: where a run starts and ends is seen from a word's neighbours, within the document's row."""
    words = docs.select("doc_id", F.split("text", " ").alias("w")).filter(F.size("w") > 0)
    marked = lambda i: F.coalesce(F.length(F.get("w", i)) >= 5, F.lit(False))
    places = F.sequence(F.lit(0), F.size("w") - 1)
    first, last = F.filter(places, lambda i: marked(i) & ~marked(i - 1)), F.filter(places, lambda i: marked(i) & ~marked(i + 1))
    runs = F.zip_with(first, last, lambda a, b: F.struct(a.cast("long").alias("start"), F.array_join(F.slice("w", a + 1, b - a + 1), " ").alias("span")))
    return words.select("doc_id", F.explode(runs).alias("r")).select("doc_id", "r.start", "r.span")


@query("label_spans_all", SPANS_SQL)
@query("label_spans", SPANS_SQL)
def label_spans(spark, sf):
    return spans(table(spark, sf, "documents"))


@query("relaxed_match", f"""WITH {EVIDENCE}, t AS (SELECT item_id, {tokens_sql('text')}[1:3] AS q FROM benchmark), one AS (SELECT item_id, q, unnest(q) AS term FROM t), d AS (SELECT DISTINCT ev_id, unnest({tokens_sql('title')}) AS term FROM evidence),
    h AS (SELECT item_id, ev_id, count(DISTINCT term) AS n, len(any_value(list_distinct(q))) AS size FROM one JOIN d USING (term) GROUP BY item_id, ev_id), l AS (SELECT *, min(CASE WHEN n = size THEN 0 WHEN n >= 2 THEN 1 ELSE 2 END) OVER (PARTITION BY item_id) AS best, CASE WHEN n = size THEN 0 WHEN n >= 2 THEN 1 ELSE 2 END AS level FROM h)
    SELECT item_id, ev_id, level, CAST(r AS INTEGER) AS place FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY n DESC, ev_id) AS r FROM l WHERE level = best) WHERE r <= 10""")
def relaxed_match(spark, sf):
    """Ten titles by terms in common; only the strictest level with a hit counts: all terms, two, any."""
    q = table(spark, sf, "benchmark").select("item_id", F.array_distinct(F.slice(T.tokenize(F.col("text")), 1, 3)).alias("q"))
    terms = q.select("item_id", F.size("q").alias("size"), F.explode("q").alias("term"))
    titles = evidence(spark, sf).select("ev_id", F.explode(F.array_distinct(T.tokenize(F.col("title")))).alias("term"))
    hits = titles.join(terms, "term").groupBy("item_id", "ev_id", "size").agg(F.count("*").alias("n"))
    level = F.when(F.col("n") == F.col("size"), 0).when(F.col("n") >= 2, 1).otherwise(2)
    ranked = top_per_group(hits.withColumn("level", level), ["item_id"], ["level", F.desc("n"), "ev_id"], 10, "place")
    best = Window.partitionBy("item_id")
    return ranked.withColumn("best", F.min("level").over(best)).filter("level = best").select("item_id", "ev_id", "level", "place")


@query("sections_udtf", rf"WITH {SECTIONS_SQL} SELECT page_id, CAST(position AS INTEGER) AS position, section FROM sections")
def sections_udtf(spark, sf):
    """``split_sections`` as a table function for SQL users: sections(text) in a lateral join."""
    from pyspark.sql.functions import udtf

    @udtf(returnType="position int, section string")
    class Sections:
        def eval(self, text: str):
            import re

            parts = re.split(r"(?m)^(?=##[ \t]+\S)", text or "")
            for k, part in enumerate(p for p in parts if p):
                yield k, part

    spark.udtf.register("sections", Sections)
    page_text(spark, sf).createOrReplaceTempView("page_text_for_sections")
    return spark.sql("SELECT page_id, s.position, s.section FROM page_text_for_sections, LATERAL sections(text) s")


PATTERN_WORDS = r"list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}_]+'), lambda x: length(x) > 0)"
PATTERNS_SQL = f"""w AS (SELECT item_id, {PATTERN_WORDS} AS w FROM benchmark), terms AS (SELECT DISTINCT unnest(list_filter(w, lambda x: length(x) >= 6)) AS term FROM w UNION SELECT DISTINCT unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS term FROM w)"""


def pattern_table(spark, sf):
    """term: words of six letters or more of benchmark items, and their pairs of neighbours as phrases."""
    words = F.filter(F.split(F.lower("text"), r"[^\p{L}\p{N}_]+"), lambda x: F.length(x) > 0)
    w = table(spark, sf, "benchmark").select(words.alias("w"))
    pairs = F.when(F.size("w") > 1, F.transform(F.sequence(F.lit(0), F.size("w") - 2), lambda i: F.concat(F.get("w", i), F.lit(" "), F.get("w", i + 1))))
    return w.select(F.explode(F.filter("w", lambda x: F.length(x) >= 6)).alias("term")).union(w.select(F.explode(pairs).alias("term"))).distinct()


@query("pattern_hits", f"""WITH {PATTERNS_SQL}, d AS (SELECT doc_id, lower(text) AS low, list_distinct({PATTERN_WORDS}) AS w FROM documents WHERE text IS NOT NULL)
    SELECT doc_id, term FROM (SELECT doc_id, unnest(w) AS term FROM d) JOIN terms USING (term) UNION ALL SELECT doc_id, term FROM d JOIN terms ON contains(low, term) WHERE contains(term, ' ')""")
def pattern_hits(spark, sf):
    """Which of very many words and phrases each document holds, in one pass over the documents."""
    docs = table(spark, sf, "documents").select("doc_id", "text")
    return match_patterns(docs, pattern_table(spark, sf), "doc_id", "text", "term", "term").select("doc_id", "term")


@query("redact_known_values", """WITH k AS (SELECT DISTINCT unnest(regexp_extract_all(text, 'token = "([0-9a-f]+)"', 1)) AS v FROM documents), l AS (SELECT list(v) AS known FROM k)
    SELECT doc_id, list_reduce(list_prepend(text, coalesce(known, [])), lambda t, v: replace(t, v, '[redacted]')) AS text FROM documents, l""")
def redact_known_values(spark, sf):
    """Every secret that any document gives away, taken out of all documents, wherever it stands."""
    docs = table(spark, sf, "documents").select("doc_id", "text")
    known = docs.select(F.explode(F.regexp_extract_all("text", F.lit('token = "([0-9a-f]+)"'), F.lit(1))).alias("value")).distinct()
    return redact_known(docs, known)
