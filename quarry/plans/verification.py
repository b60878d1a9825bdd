"""Queries of claims, verdicts, stance and its evaluation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quarry.operators import verify as V
from quarry.operators.retrieve import top_per_group
from quarry.plans.pool import SIGNALS, signals
from quarry.plans.registry import query
from quarry.plans.text_work import CHUNKS_SQL, chunks_of_turns
from quarry.sources.tables import EVIDENCE, evidence, table

RELATIONS = ("supports", "contradicts", "says_nothing")
#: A verdict for each labelled document: eight sources to a claim; every 17th is an error, every third has no distribution.
VERDICTS_SQL = """verdicts AS (SELECT doc_id, doc_id // 8 AS claim, CAST(doc_id % 8 AS INTEGER) AS source_index, CASE WHEN doc_id % 17 = 0 THEN 'error' WHEN toxic = 1 THEN 'contradicts' WHEN quality = 1 THEN 'supports' ELSE 'says_nothing' END AS relation,
    CASE WHEN toxic = 1 THEN 'contradicts' WHEN doc_id % 5 = 0 THEN 'says_nothing' ELSE 'supports' END AS gold, ((doc_id * 37) % 101) / 100.0::DOUBLE AS confidence, CASE WHEN doc_id % 2 = 0 THEN 'typed' ELSE 'prompted' END AS backend, doc_id % 3 <> 0 AS spread FROM labels),
    masses AS (SELECT *, CASE WHEN relation = 'error' AND spread THEN 0 WHEN relation = 'supports' THEN confidence WHEN spread THEN round((1 - confidence) / 2, 6) ELSE 0 END::DOUBLE AS m_for,
    CASE WHEN relation = 'error' AND spread THEN 0 WHEN relation = 'contradicts' THEN confidence WHEN spread THEN round((1 - confidence) / 2, 6) ELSE 0 END::DOUBLE AS m_against,
    CASE WHEN relation = 'error' AND spread THEN 0 WHEN relation = 'says_nothing' THEN confidence WHEN spread THEN round((1 - confidence) / 2, 6) ELSE 0 END::DOUBLE AS m_nothing FROM verdicts)"""


def verdicts(spark, sf):
    k = F.col("doc_id")
    relation = F.when(k % 17 == 0, "error").when(F.col("toxic") == 1, "contradicts").when(F.col("quality") == 1, "supports").otherwise("says_nothing")
    rows = table(spark, sf, "labels").select(
        "doc_id", F.expr("doc_id div 8").alias("claim"), (k % 8).cast("int").alias("source_index"), relation.alias("relation"), F.when(F.col("toxic") == 1, "contradicts").when(k % 5 == 0, "says_nothing").otherwise("supports").alias("gold"),
        (((k * 37) % 101) / 100.0).alias("confidence"), F.when(k % 2 == 0, "typed").otherwise("prompted").alias("backend"),
    )
    each = F.map_from_arrays(F.array(*map(F.lit, RELATIONS)), F.array(*(F.when(F.col("relation") == r, F.col("confidence")).otherwise(F.round((1 - F.col("confidence")) / 2, 6)) for r in RELATIONS)))
    return rows.withColumn("probabilities", F.when((k % 3 != 0) & (F.col("relation") != "error"), each))


@query("fold_verdicts", f"""WITH {VERDICTS_SQL}, b AS (SELECT *, relation <> 'error' AS real, m_nothing >= 0.95 AS nothing, m_against >= CASE backend WHEN 'typed' THEN 0.85 ELSE 0.9 END AS against, m_for >= CASE backend WHEN 'typed' THEN 0.5 ELSE 0.9 END AS pro FROM masses),
    g AS (SELECT claim, CASE WHEN count(*) FILTER (real) = 0 THEN 1 WHEN bool_and(nothing) FILTER (real) THEN 2 WHEN bool_or(against) FILTER (real) THEN 3 WHEN bool_or(pro) FILTER (real) THEN 4 ELSE 5 END AS rule,
    string_agg(DISTINCT source_index::VARCHAR, ',' ORDER BY source_index::VARCHAR) AS cited, string_agg(DISTINCT source_index::VARCHAR, ',' ORDER BY source_index::VARCHAR) FILTER (NOT real OR pro) AS kept FROM b GROUP BY claim)
    SELECT claim, CASE rule WHEN 2 THEN 'unaddressed' WHEN 3 THEN 'contradicted' ELSE '' END AS flag, rule IN (2, 3, 5) AS weak, CASE WHEN rule = 4 THEN kept ELSE cited END AS citations FROM g""")
def fold_verdicts(spark, sf):
    return V.fold_verdicts(verdicts(spark, sf), ["claim"]).withColumn("citations", F.array_join(F.col("citations").cast("array<string>"), ","))


@query("overview_flags", f"""WITH {VERDICTS_SQL}, c AS (SELECT claim, (claim * 7) % 11 AS words, claim % 6 = 0 AS uncited, * EXCLUDE (claim) FROM masses), b AS (SELECT claim, words, uncited, relation <> 'error' AS real, m_against >= CASE backend WHEN 'typed' THEN 0.6 ELSE 0.9 END AS against, m_nothing >= CASE backend WHEN 'typed' THEN 0.6 ELSE 0.9 END AS nothing FROM c)
    SELECT claim, CASE WHEN any_value(uncited) THEN CASE WHEN any_value(words) >= 6 THEN 'uncited' ELSE '' END WHEN bool_or(against) FILTER (real) THEN 'contradicted' WHEN bool_and(nothing) FILTER (real) THEN 'unsupported' ELSE '' END AS flag FROM b GROUP BY claim""")
def overview_flags(spark, sf):
    """Flags of overview chunks: uncited prose of six words or more, else contradicted by any source, else unsupported by all."""
    real = F.col("relation") != "error"
    hit = lambda r: F.when(real, V.mass(r) >= V.bar(F.col("backend"), "summary"))
    per = verdicts(spark, sf).groupBy("claim").agg(F.coalesce(F.bool_or(hit("contradicts")), F.lit(False)).alias("against"), F.coalesce(F.bool_and(hit("says_nothing")), F.lit(False)).alias("nothing"))
    words, uncited = (F.col("claim") * 7) % 11, F.col("claim") % 6 == 0
    return per.select("claim", F.when(uncited, F.when(words >= 6, "uncited").otherwise("")).when(F.col("against"), "contradicted").when(F.col("nothing"), "unsupported").otherwise("").alias("flag"))


#: The chunks of a conversation's turns as overviews: [k] cites source k - 1 of the claim with the conversation's number.
@query("overview_chunks", rf"""WITH {VERDICTS_SQL}, {CHUNKS_SQL}, c AS (SELECT DISTINCT conv_id, turn, line, position, chunk, len(list_filter(string_split(translate(chunk, '*_', ''), ' '), lambda w: w <> '')) AS words, list_transform(regexp_extract_all(chunk, '\[(\d+)\]', 1), lambda d: CAST(d AS INTEGER) - 1) AS idx FROM chunks),
    p AS (SELECT *, len(list_filter(idx, lambda i: i BETWEEN 0 AND 7)) AS n_valid FROM c), u AS (SELECT DISTINCT conv_id, turn, line, position, chunk, unnest(idx) AS source_index FROM p),
    v AS (SELECT conv_id, turn, line, position, chunk, bool_or(m_against >= CASE backend WHEN 'typed' THEN 0.6 ELSE 0.9 END) AS against, bool_and(m_nothing >= CASE backend WHEN 'typed' THEN 0.6 ELSE 0.9 END) AS nothing FROM u JOIN masses m ON m.claim = conv_id AND m.source_index = u.source_index WHERE relation <> 'error' GROUP BY ALL)
    SELECT conv_id, turn, line, position, n_valid, CASE WHEN n_valid = 0 THEN CASE WHEN words >= 6 THEN 'uncited' ELSE '' END WHEN against THEN 'contradicted' WHEN nothing THEN 'unsupported' ELSE '' END AS flag FROM p LEFT JOIN v USING (conv_id, turn, line, position, chunk)""")
def overview_chunks(spark, sf, n_sources: int = 8):
    """A flag for each chunk of an overview, from the verdicts of the sources that it cites.

    Citations out of range are dropped. A chunk that cites nothing valid is ``uncited`` from six words on; else it is
    ``contradicted`` if any verdict is, else ``unsupported`` if all are. Errors don't count, and a chunk without
    another verdict has no flag. Repeated rows count once.
    """
    keys = ["conv_id", "turn", "line", "position", "chunk"]
    index = F.transform("marks", lambda k: k - 1)
    chunks = chunks_of_turns(spark, sf).select(*keys, "words", F.filter(index, lambda i: i.between(0, n_sources - 1)).alias("idx")).distinct()
    cited = chunks.select(*keys, F.col("conv_id").alias("claim"), F.explode(F.array_distinct("idx")).alias("source_index"))
    hit = lambda r: V.mass(r) >= V.bar(F.col("backend"), "summary")
    real = verdicts(spark, sf).filter("relation <> 'error'").select("claim", "source_index", hit("contradicts").alias("against"), hit("says_nothing").alias("nothing"))
    folded = cited.join(real, ["claim", "source_index"]).groupBy(*keys).agg(F.bool_or("against").alias("against"), F.bool_and("nothing").alias("nothing"))
    flag = F.when(F.size("idx") == 0, F.when(F.col("words") >= 6, "uncited").otherwise("")).when(F.col("against"), "contradicted").when(F.col("nothing"), "unsupported").otherwise("")
    return chunks.join(folded, keys, "left").select("conv_id", "turn", "line", "position", F.size("idx").cast("long").alias("n_valid"), flag.alias("flag"))


CLAIMS_SQL = f"""{EVIDENCE}, placed AS (SELECT *, row_number() OVER (PARTITION BY topic_id ORDER BY arrival) - 1 AS place FROM evidence),
    claims AS (SELECT topic_id, place AS claim_index, [CAST(ev_id % 13 AS INTEGER), CAST(ev_id % 13 AS INTEGER), CAST(ev_id % 5 AS INTEGER), 99, -1] AS source_indices, CASE ev_id % 4 WHEN 0 THEN 'strong' WHEN 1 THEN 'moderate' WHEN 2 THEN 'weak' ELSE 'huge' END AS strength, ev_id FROM placed),
    articles AS (SELECT topic_id, CAST(place AS INTEGER) AS position, ev_id AS source_id, CASE WHEN citation_count % 3 = 0 THEN 'direct' ELSE 'indirect' END AS directness FROM placed)"""


def _claims(spark, sf):
    """A claim and an article of every record, numbered by arrival within its topic."""
    k = F.col("ev_id")
    idx = F.array((k % 13).cast("int"), (k % 13).cast("int"), (k % 5).cast("int"), F.lit(99), F.lit(-1))
    strength = F.when(k % 4 == 0, "strong").when(k % 4 == 1, "moderate").when(k % 4 == 2, "weak").otherwise("huge")
    rows = evidence(spark, sf).withColumn("place", F.row_number().over(Window.partitionBy("topic_id").orderBy("arrival")) - 1)
    claims = rows.select("topic_id", F.col("place").cast("long").alias("claim_index"), idx.alias("source_indices"), strength.alias("strength"), "ev_id")
    directness = F.when(F.col("citation_count") % 3 == 0, "direct").otherwise("indirect")
    return claims, rows.select(F.col("topic_id").alias("t"), F.col("place").cast("int").alias("position"), k.alias("source_id"), directness.alias("directness"))


PAIRS_SQL = f"WITH {CLAIMS_SQL}, p AS (SELECT DISTINCT topic_id, claim_index, unnest(source_indices) AS position FROM claims) SELECT topic_id, claim_index, position, source_id, directness FROM p JOIN articles USING (topic_id, position)"


@query("claim_source_pairs_all", PAIRS_SQL)
@query("claim_source_pairs", PAIRS_SQL)
def claim_source_pairs(spark, sf):
    claims, articles = _claims(spark, sf)
    pairs = claims.select("topic_id", "claim_index", F.explode(F.array_distinct("source_indices")).alias("p"))
    return pairs.join(articles, (F.col("topic_id") == F.col("t")) & (F.col("p") == F.col("position"))).select("topic_id", "claim_index", "position", "source_id", "directness")


VALID_SQL = f"""WITH {CLAIMS_SQL}, p AS (SELECT topic_id, claim_index, strength, position, directness FROM (SELECT DISTINCT topic_id, claim_index, strength, unnest(source_indices) AS position FROM claims) JOIN articles USING (topic_id, position))
    SELECT topic_id, claim_index, string_agg(position::VARCHAR, ',' ORDER BY position) AS sources, CASE WHEN NOT bool_or(directness = 'direct') THEN 'weak' WHEN strength IN ('strong', 'moderate', 'weak') THEN strength ELSE 'moderate' END AS strength, count(*) >= 2 AS can_disagree FROM p GROUP BY topic_id, claim_index, strength"""


@query("validate_claims_all", VALID_SQL)
@query("validate_claims", VALID_SQL)
def validate_claims(spark, sf):
    """Claims with their valid, distinct sources; strength defaults to moderate and is weak without a direct source. A claim without a valid source goes."""
    claims, articles = _claims(spark, sf)
    pairs = claims.select("topic_id", "claim_index", "strength", F.explode(F.array_distinct("source_indices")).alias("p"))
    met = pairs.join(articles, (F.col("topic_id") == F.col("t")) & (F.col("p") == F.col("position")))
    per = met.groupBy("topic_id", "claim_index", "strength").agg(F.sort_array(F.collect_set("position")).alias("s"), F.bool_or(F.col("directness") == "direct").alias("direct"))
    known = F.when(F.col("strength").isin("strong", "moderate", "weak"), F.col("strength")).otherwise("moderate")
    return per.select("topic_id", "claim_index", F.array_join(F.col("s").cast("array<string>"), ",").alias("sources"), F.when(~F.col("direct"), "weak").otherwise(known).alias("strength"), (F.size("s") >= 2).alias("can_disagree"))


_CONFLICTS_SQL = """, s AS (SELECT topic_id, claim_index, ev_id, list_sort(list(position)) AS idx FROM (SELECT DISTINCT topic_id, claim_index, ev_id, unnest(source_indices) AS position FROM claims) JOIN articles USING (topic_id, position) GROUP BY ALL),
    i AS (SELECT ev_id, CASE WHEN ev_id % 7 = 0 THEN '  ' ELSE ' ' || title END AS issue, list_filter(list_transform(string_split(snippet, '. '), lambda x: trim(x, ' ')), lambda x: x <> '') AS said FROM evidence)"""


@query("validate_conflicts", f"""WITH {CLAIMS_SQL}{_CONFLICTS_SQL} SELECT topic_id, claim_index, trim(issue, ' ') AS issue, array_to_string(said[1:4], '|') AS positions, array_to_string(idx, ',') AS sources FROM s JOIN i USING (ev_id) WHERE trim(issue, ' ') <> '' AND len(idx) >= 2""")
def validate_conflicts(spark, sf):
    """Disagreements that state an issue and have two valid sources or more; their first four positions that aren't blank."""
    claims, articles = _claims(spark, sf)
    pairs = claims.select("topic_id", "claim_index", "ev_id", F.explode(F.array_distinct("source_indices")).alias("p"))
    met = pairs.join(articles, (F.col("topic_id") == F.col("t")) & (F.col("p") == F.col("position")))
    per = met.groupBy("topic_id", "claim_index", "ev_id").agg(F.sort_array(F.collect_set("position")).alias("idx")).filter(F.size("idx") >= 2)
    stated = evidence(spark, sf).select("ev_id", F.trim(F.when(F.col("ev_id") % 7 == 0, "  ").otherwise(F.concat(F.lit(" "), "title"))).alias("issue"), first_stated(F.split("snippet", r"\. "), 4).alias("positions"))
    rows = per.join(stated.filter("issue <> ''"), "ev_id")
    return rows.select("topic_id", "claim_index", "issue", F.array_join("positions", "|").alias("positions"), F.array_join(F.col("idx").cast("array<string>"), ",").alias("sources"))


def first_stated(items, most: int):
    """The first ``most`` items that aren't blank, trimmed."""
    return F.slice(F.filter(F.transform(items, lambda x: F.trim(x)), lambda x: x != ""), 1, most)


@query("evidence_gaps", f"WITH {EVIDENCE} SELECT ev_id, array_to_string(list_filter(list_transform(string_split(content, '. '), lambda x: trim(x, ' ')), lambda x: x <> '')[1:5], '|') AS gaps FROM evidence")
def evidence_gaps(spark, sf):
    """The first five gaps of a reading that aren't blank."""
    return evidence(spark, sf).select("ev_id", F.array_join(first_stated(F.split("content", r"\. "), 5), "|").alias("gaps"))


@query("evidence_flags", f"WITH {SIGNALS} SELECT topic_id, count(*) FILTER (relevance > 0.65) AS n_passed, NOT bool_or(relevance > 0.65) AS low_evidence, NOT bool_or(relevance > 0.65 AND citation_count % 50 = 0) AS no_direct FROM signals GROUP BY topic_id")
def evidence_flags(spark, sf):
    """Topics where no article passes the strict gate of 0.65, or none of those is direct."""
    gate = F.col("relevance") > 0.65
    return signals(spark, sf).groupBy("topic_id").agg(F.count_if(gate).alias("n_passed"), (~F.bool_or(gate)).alias("low_evidence"), (~F.bool_or(gate & (F.col("citation_count") % 50 == 0))).alias("no_direct"))


#: Words of findings, and what they collapse to.
DIRECTIONS = ("supports", "weakly_supports", "contradicts", "strongly_contradicts", "no_evidence", "mixed")


@query("collapse_direction", f"""WITH d AS (SELECT doc_id, {list(DIRECTIONS)}[1 + doc_id % 6] AS direction FROM documents) SELECT doc_id, CASE WHEN direction LIKE '%supports' THEN 'SUPPORT' WHEN direction LIKE '%contradicts' THEN 'CONTRADICT' ELSE 'NOINFO' END AS label FROM d""")
def collapse_direction(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", F.element_at(F.array(*map(F.lit, DIRECTIONS)), (1 + F.col("doc_id") % 6).cast("int")).alias("direction"))
    return d.select("doc_id", F.when(F.endswith("direction", F.lit("supports")), "SUPPORT").when(F.endswith("direction", F.lit("contradicts")), "CONTRADICT").otherwise("NOINFO").alias("label"))


@query("evidence_block", f"""WITH {EVIDENCE} SELECT topic_id, string_agg('[' || place || '] ' || title || ' (' || source_type || ')', chr(10) ORDER BY arrival) AS block FROM (SELECT *, row_number() OVER (PARTITION BY topic_id ORDER BY arrival) - 1 AS place FROM evidence) WHERE place < 8 GROUP BY topic_id""")
def evidence_block(spark, sf):
    """The prompt lines of a topic's first eight sources, in order."""
    line = F.concat(F.lit("["), (F.col("place") - 1).cast("string"), F.lit("] "), "title", F.lit(" ("), "source_type", F.lit(")"))
    first = top_per_group(evidence(spark, sf), ["topic_id"], ["arrival"], 8, "place")
    per = first.groupBy("topic_id").agg(F.sort_array(F.collect_list(F.struct("arrival", line.alias("line")))).alias("l"))
    return per.select("topic_id", F.array_join(F.transform("l", lambda x: x["line"]), "\n").alias("block"))


@query("coerce_judgements", """WITH j AS (SELECT event_id, CASE event_id % 4 WHEN 0 THEN '{"score": ' || (event_id % 300) / 100.0 || ', "level": "High"}' WHEN 1 THEN '{"score": "0.4", "level": "odd"}' WHEN 2 THEN 'not json' ELSE props END AS raw FROM events)
    SELECT event_id, least(1.0, greatest(0.0, coalesce(TRY_CAST(json_extract_string(TRY_CAST(raw AS JSON), '$.score') AS DOUBLE), 0.0))) AS score, CASE WHEN lower(coalesce(json_extract_string(TRY_CAST(raw AS JSON), '$.level'), '')) IN ('high', 'low') THEN lower(json_extract_string(TRY_CAST(raw AS JSON), '$.level')) ELSE 'medium' END AS level FROM j""")
def coerce_judgements(spark, sf):
    """Model output read leniently: numbers clamped to [0, 1], unknown words to a default, broken JSON to defaults."""
    k = F.col("event_id")
    number = F.format_string("%.2f", (k % 300) / 100.0)
    raw = F.when(k % 4 == 0, F.concat(F.lit('{"score": '), number, F.lit(', "level": "High"}'))).when(k % 4 == 1, F.lit('{"score": "0.4", "level": "odd"}')).when(k % 4 == 2, F.lit("not json")).otherwise(F.col("props"))
    rows = table(spark, sf, "events").select("event_id", raw.alias("raw"))
    level = F.lower(F.coalesce(F.get_json_object("raw", "$.level"), F.lit("")))
    score = F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.coalesce(F.get_json_object("raw", "$.score").try_cast("double"), F.lit(0.0))))
    return rows.select("event_id", score.alias("score"), F.when(level.isin("high", "low"), level).otherwise("medium").alias("level"))


@query("judge_in_batches")
def judge_in_batches(spark, sf):
    def judge(texts):
        if any(t is None or "zzz" in t for t in texts):
            raise ValueError("unreadable")
        return [len(t) / 4000 for t in texts]

    return V.judge_in_batches(table(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("input")), judge)


@query("stance_report", f"""WITH {VERDICTS_SQL}, v AS (SELECT gold, relation AS pred FROM verdicts WHERE relation <> 'error'), c AS (SELECT unnest(['supports', 'contradicts', 'says_nothing']) AS label)
    SELECT label, count(*) FILTER (gold = label) AS n_gold, count(*) FILTER (pred = label) AS n_pred, count(*) FILTER (gold = label AND pred = label) AS n_both,
    round(coalesce(count(*) FILTER (gold = label AND pred = label) / nullif(count(*) FILTER (pred = label), 0), 0), 6) AS precision, round(coalesce(count(*) FILTER (gold = label AND pred = label) / nullif(count(*) FILTER (gold = label), 0), 0), 6) AS recall,
    round(coalesce(2 * count(*) FILTER (gold = label AND pred = label) / nullif(count(*) FILTER (gold = label) + count(*) FILTER (pred = label), 0), 0), 6) AS f1 FROM v, c GROUP BY label""")
def stance_report(spark, sf):
    """Precision, recall and F1 of each class, from a confusion matrix of nine counts."""
    matrix = verdicts(spark, sf).filter("relation <> 'error'").groupBy("gold", F.col("relation").alias("pred")).agg(F.count("*").alias("n"))
    label = F.explode(F.array(*map(F.lit, RELATIONS))).alias("label")
    count = lambda c: F.coalesce(F.sum(F.when(c, F.col("n"))), F.lit(0))
    g, p = F.col("gold") == F.col("label"), F.col("pred") == F.col("label")
    per = matrix.select("*", label).groupBy("label").agg(count(g).alias("n_gold"), count(p).alias("n_pred"), count(g & p).alias("n_both"))
    share = lambda a, b: F.round(F.coalesce(F.try_divide(a, b), F.lit(0.0)), 6)
    return per.select("*", share(F.col("n_both"), F.col("n_pred")).alias("precision"), share(F.col("n_both"), F.col("n_gold")).alias("recall"), share(2 * F.col("n_both"), F.col("n_gold") + F.col("n_pred")).alias("f1"))


#: Fixed value: mass from which a verdict below the flag's bar counts as doubtful.
DOUBT_FLOOR = 0.4


#: Three findings of each labelled document, in order; what the document is labelled; how relevant it was judged.
FINDINGS_SQL = f"""findings AS (SELECT doc_id, position, {list(DIRECTIONS)}[1 + (doc_id * 7 + position * 5) % 6] AS direction FROM labels, (SELECT unnest([0, 1, 2]) AS position)),
    firsts AS (SELECT doc_id, coalesce(arg_min(direction, position) FILTER (direction <> 'no_evidence'), 'no_evidence') AS direction FROM findings GROUP BY doc_id)"""


def first_directions(findings: DataFrame, keys: list[str]) -> DataFrame:
    """The first finding of each document that decides anything, else no_evidence: ``keys``, direction."""
    first = F.min_by(F.when(F.col("direction") != "no_evidence", F.col("direction")), F.when(F.col("direction") != "no_evidence", F.col("position")))
    return findings.groupBy(*keys).agg(F.coalesce(first, F.lit("no_evidence")).alias("direction"))


def _firsts(spark, sf):
    rows = table(spark, sf, "labels").select("doc_id", F.explode(F.array(*map(F.lit, range(3)))).alias("position"))
    at = (1 + (F.col("doc_id") * 7 + F.col("position") * 5) % 6).cast("int")
    return first_directions(rows.withColumn("direction", F.element_at(F.array(*map(F.lit, DIRECTIONS)), at)), ["doc_id"])


@query("first_decisive", f"WITH {FINDINGS_SQL} SELECT doc_id, direction FROM firsts")
def first_decisive(spark, sf):
    return _firsts(spark, sf)


#: Fixed value: relevance up to which a document doesn't pass to the synthesis.
GATE = 0.65
GOLD = ("SUPPORT", "CONTRADICT", "NOINFO")
_F1 = ", ".join(f"coalesce(2 * count(*) FILTER (gold = '{g}' AND pred = '{g}') / nullif(count(*) FILTER (gold = '{g}') + count(*) FILTER (pred = '{g}'), 0), 0)" for g in GOLD)


@query("stance_summary", f"""WITH {FINDINGS_SQL}, p AS (SELECT doc_id, CASE WHEN toxic = 1 THEN 'CONTRADICT' WHEN doc_id % 5 = 0 THEN 'NOINFO' ELSE 'SUPPORT' END AS gold, direction, doc_id % 4 <> 0 AS found, ((doc_id * 29) % 107) / 106.0::DOUBLE AS relevance,
    CASE WHEN direction LIKE '%supports' THEN 'SUPPORT' WHEN direction LIKE '%contradicts' THEN 'CONTRADICT' ELSE 'NOINFO' END AS pred FROM labels JOIN firsts USING (doc_id)), h AS (SELECT *, gold = 'NOINFO' AND found AND direction <> 'no_evidence' AND relevance > {GATE} AS told FROM p)
    SELECT count(*) AS n_pairs, round(count(*) FILTER (gold = pred) / count(*), 6) AS accuracy, round(list_sum([{_F1}]) / 3, 6) AS macro_f1, round(count(*) FILTER (gold = 'CONTRADICT' AND pred = gold) / nullif(count(*) FILTER (gold = 'CONTRADICT'), 0), 6) AS contradict_recall,
    round(count(*) FILTER (direction = 'mixed') / count(*), 6) AS mixed_rate, count(*) FILTER (told) AS n_hallucinated, round(count(*) FILTER (told) / nullif(count(*) FILTER (gold = 'NOINFO'), 0), 6) AS hallucinated_rate,
    round(count(*) FILTER (told AND direction NOT LIKE 'weakly%') / nullif(count(*) FILTER (gold = 'NOINFO'), 0), 6) AS strong_hallucination_rate, round(count(*) FILTER (gold = 'NOINFO' AND relevance <= {GATE}) / nullif(count(*) FILTER (gold = 'NOINFO'), 0), 6) AS below_gate_rate,
    round(avg(relevance) FILTER (gold = 'SUPPORT'), 6) AS relevance_support, round(avg(relevance) FILTER (gold = 'CONTRADICT'), 6) AS relevance_contradict, round(avg(relevance) FILTER (gold = 'NOINFO'), 6) AS relevance_noinfo FROM h""")
def stance_summary(spark, sf):
    """One row over all claim-document pairs: accuracy, macro F1, findings asserted where there is nothing to find, and mean relevance by label."""
    k = F.col("doc_id")
    gold = F.when(F.col("toxic") == 1, "CONTRADICT").when(k % 5 == 0, "NOINFO").otherwise("SUPPORT")
    pred = F.when(F.endswith("direction", F.lit("supports")), "SUPPORT").when(F.endswith("direction", F.lit("contradicts")), "CONTRADICT").otherwise("NOINFO")
    p = table(spark, sf, "labels").join(_firsts(spark, sf), "doc_id").select("direction", gold.alias("gold"), pred.alias("pred"), (k % 4 != 0).alias("found"), (((k * 29) % 107) / 106.0).alias("relevance"))
    g, nothing = F.col("gold"), F.col("gold") == "NOINFO"
    told = nothing & F.col("found") & (F.col("direction") != "no_evidence") & (F.col("relevance") > GATE)
    share = lambda a, b: F.round(F.try_divide(F.count_if(a), F.count_if(b)), 6)
    both = lambda c: F.try_divide(2 * F.count_if((g == c) & (F.col("pred") == c)), F.count_if(g == c) + F.count_if(F.col("pred") == c))
    every = F.lit(True)
    return p.agg(
        F.count("*").alias("n_pairs"), share(g == F.col("pred"), every).alias("accuracy"), F.round(sum(F.coalesce(both(c), F.lit(0.0)) for c in GOLD) / 3, 6).alias("macro_f1"),
        share((g == "CONTRADICT") & (F.col("pred") == g), g == "CONTRADICT").alias("contradict_recall"), share(F.col("direction") == "mixed", every).alias("mixed_rate"),
        F.count_if(told).alias("n_hallucinated"), share(told, nothing).alias("hallucinated_rate"), share(told & ~F.startswith("direction", F.lit("weakly")), nothing).alias("strong_hallucination_rate"),
        share(nothing & (F.col("relevance") <= GATE), nothing).alias("below_gate_rate"), *(F.round(F.avg(F.when(g == c, F.col("relevance"))), 6).alias(f"relevance_{c.lower()}") for c in GOLD),
    )


#: Lower ends of the confidence buckets.
BUCKETS = (0.0, 0.5, 0.7, 0.85, 0.95)


@query("calibration", f"""WITH {VERDICTS_SQL}, b AS (SELECT unnest({list(BUCKETS)})::DOUBLE AS low), v AS (SELECT *, CASE WHEN confidence >= 0.95 THEN 0.95 WHEN confidence >= 0.85 THEN 0.85 WHEN confidence >= 0.7 THEN 0.7 WHEN confidence >= 0.5 THEN 0.5 ELSE 0 END::DOUBLE AS low FROM verdicts WHERE relation <> 'error')
    SELECT low, count(relation) AS n, round(avg(CASE WHEN relation = gold THEN 1.0 WHEN relation IS NOT NULL THEN 0.0 END), 6) AS accuracy FROM b LEFT JOIN v USING (low) GROUP BY low""")
def calibration(spark, sf):
    low = F.lit(0.0)
    for b in BUCKETS[1:]:
        low = F.when(F.col("confidence") >= b, b).otherwise(low)
    per = verdicts(spark, sf).filter("relation <> 'error'").groupBy(low.alias("low")).agg(F.count("*").alias("n"), F.round(F.avg((F.col("relation") == F.col("gold")).cast("double")), 6).alias("accuracy"))
    every = spark.createDataFrame([(b,) for b in BUCKETS], "low double")
    return every.join(per, "low", "left").select("low", F.coalesce("n", F.lit(0)).alias("n"), "accuracy")


@query("rule_precision", f"""WITH {VERDICTS_SQL} SELECT backend, count(*) FILTER (m_against >= CASE backend WHEN 'typed' THEN 0.85 ELSE 0.9 END) AS fired, round(coalesce(count(*) FILTER (m_against >= CASE backend WHEN 'typed' THEN 0.85 ELSE 0.9 END AND gold = 'contradicts')
    / nullif(count(*) FILTER (m_against >= CASE backend WHEN 'typed' THEN 0.85 ELSE 0.9 END), 0), 0), 6) AS precision, round(count(*) FILTER (gold = 'contradicts') / count(*), 6) AS base,
    count(*) FILTER (m_against >= 0.4 AND m_against < CASE backend WHEN 'typed' THEN 0.85 ELSE 0.9 END) AS doubtful, round(count(*) FILTER (m_against >= 0.4 AND m_against < CASE backend WHEN 'typed' THEN 0.85 ELSE 0.9 END AND gold = 'contradicts') / nullif(count(*) FILTER (m_against >= 0.4 AND m_against < CASE backend WHEN 'typed' THEN 0.85 ELSE 0.9 END), 0), 6) AS doubt_share,
    count(*) FILTER (relation = 'supports') AS n_argmax, round(count(*) FILTER (relation = 'supports' AND gold = 'supports') / nullif(count(*) FILTER (relation = 'supports'), 0), 6) AS argmax_precision FROM masses WHERE relation <> 'error' GROUP BY backend""")
def rule_precision(spark, sf):
    """By backend: precision of the flag at its bar, the share that is contradicted just below it (null where none is), and precision of the largest mass alone."""
    fired, right = V.mass("contradicts") >= V.bar(F.col("backend"), "contradict"), F.col("gold") == "contradicts"
    doubt, pro = (V.mass("contradicts") >= DOUBT_FLOOR) & ~fired, F.col("relation") == "supports"
    per = verdicts(spark, sf).filter("relation <> 'error'").groupBy("backend").agg(
        F.count_if(fired).alias("fired"), F.count_if(fired & right).alias("hit"), F.count_if(right).alias("gold"), F.count("*").alias("n"),
        F.count_if(doubt).alias("doubtful"), F.count_if(doubt & right).alias("doubt_hit"), F.count_if(pro).alias("n_argmax"), F.count_if(pro & (F.col("gold") == "supports")).alias("argmax_hit"),
    )
    share = lambda a, b: F.round(F.try_divide(a, b), 6)
    return per.select(
        "backend", "fired", F.coalesce(share("hit", "fired"), F.lit(0.0)).alias("precision"), share("gold", "n").alias("base"),
        "doubtful", share("doubt_hit", "doubtful").alias("doubt_share"), "n_argmax", share("argmax_hit", "n_argmax").alias("argmax_precision"),
    )


@query("ordinal_stance", f"""WITH {VERDICTS_SQL}, s AS (SELECT gold, confidence * 4 AS raw FROM verdicts), r AS (SELECT gold, raw, CASE WHEN abs(raw - floor(raw) - 0.5) < 1e-9 THEN 2 * round(raw / 2) ELSE round(raw) END AS step FROM s)
    SELECT gold, CAST(step AS INTEGER) AS step, count(*) AS n, round(avg(raw), 6) AS mean FROM r GROUP BY ALL""")
def ordinal_stance(spark, sf):
    """Raw scores rounded half to even onto the legend, with their mean by gold label."""
    raw = F.col("confidence") * 4
    return verdicts(spark, sf).select("gold", raw.alias("raw")).groupBy("gold", F.bround("raw", 0).cast("int").alias("step")).agg(F.count("*").alias("n"), F.round(F.avg("raw"), 6).alias("mean"))


#: What the steps of the legend stand for, the lowest first.
LEGEND = ("CONTRADICT", "CONTRADICT", "NOINFO", "SUPPORT", "SUPPORT")


@query("ordinal_labels", f"""WITH {VERDICTS_SQL}, s AS (SELECT gold, confidence * 4 AS raw FROM verdicts), r AS (SELECT gold, raw, CAST(CASE WHEN abs(raw - floor(raw) - 0.5) < 1e-9 THEN 2 * round(raw / 2) ELSE round(raw) END AS INTEGER) AS step FROM s)
    SELECT gold, {list(LEGEND)}[1 + step] AS label, count(*) AS n, round(min(raw), 6) AS least, round(max(raw), 6) AS most FROM r GROUP BY ALL""")
def ordinal_labels(spark, sf):
    """The label that each rounded score stands for, by gold label, with the range of the scores behind it."""
    raw = F.col("confidence") * 4
    label = F.element_at(F.array(*map(F.lit, LEGEND)), 1 + F.bround("raw", 0).cast("int"))
    return verdicts(spark, sf).select("gold", raw.alias("raw")).groupBy("gold", label.alias("label")).agg(F.count("*").alias("n"), F.round(F.min("raw"), 6).alias("least"), F.round(F.max("raw"), 6).alias("most"))
