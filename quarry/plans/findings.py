"""Queries of nested model output. The outputs are made from the records' own sentences, with the faults that models make."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.operators import findings as N
from quarry.plans.registry import query
from quarry.sources.tables import EVIDENCE, evidence

CONFIDENCES = ("1.7", "0.4", "high", "-2")
ABSENT = "said nowhere zzz"


def outputs(spark, sf):
    """ev_id, content, raw: JSON with up to five findings from a record's sentences. Quotes are from the text with wider blanks, from elsewhere, or missing; some outputs are cut
    off, some have a word where the findings should be, some leave parts of the PICO out."""
    k = F.col("ev_id")
    said = F.slice(F.filter(F.transform(F.split("content", r"\. "), lambda x: F.trim(x)), lambda x: x != ""), 1, 5)
    rows = evidence(spark, sf).select("ev_id", "title", "content", said.alias("said"))

    def finding(x, i):
        at = k + i
        quote = F.when(at % 3 == 0, ABSENT).when(at % 3 == 1, F.replace(F.substring(x, 1, 40), F.lit(" "), F.lit("  "))).otherwise("")
        direction = F.when(F.length(x) % 7 == 0, "Odd").otherwise(F.element_at(F.array(*map(F.lit, N.DIRECTIONS)), (1 + F.length(x) % 6).cast("int")))
        return F.struct(
            F.when((i == 1) & (k % 4 == 0), "  ").otherwise(x).alias("statement"), quote.alias("quote"), direction.alias("direction"), F.element_at(F.array(*map(F.lit, CONFIDENCES)), (1 + i % 4).cast("int")).alias("confidence")
        )

    pico = F.struct(F.when(k % 2 == 0, "adults").alias("population"), F.when(k % 3 != 0, F.col("title")).alias("intervention"), F.lit("placebo").alias("comparison"), F.when(k % 5 == 0, "mortality").otherwise(" ").alias("outcome"))
    fields = [((k % 150) / 100.0).alias("relevance"), F.element_at(F.array(*map(F.lit, ("Direct", "indirect", "odd"))), (1 + k % 3).cast("int")).alias("directness"), F.concat(F.lit(" About "), "title").alias("summary")]
    whole = F.to_json(F.struct(*fields, F.transform("said", finding).alias("findings"), pico.alias("pico")))
    odd = F.to_json(F.struct(*fields, F.lit("none").alias("findings"), pico.alias("pico")))
    raw = F.when(k % 11 == 0, F.substring(whole, F.lit(1), F.floor(F.length(whole) / 2).cast("int"))).when(k % 13 == 0, odd).otherwise(whole)
    return rows.select("ev_id", "content", raw.alias("raw"))


_FOLD = "lower(trim(regexp_replace(coalesce({0}, ''), '\\s+', ' ', 'g'), ' '))"
PARSED_SQL = f"""{EVIDENCE}, texts AS (SELECT ev_id, title, content, list_filter(list_transform(string_split(content, '. '), lambda x: trim(x, ' ')), lambda x: x <> '')[1:5] AS said, ev_id % 11 = 0 AS cut, ev_id % 11 <> 0 AND ev_id % 13 = 0 AS odd FROM evidence),
    all_findings AS (SELECT ev_id, content, i, said[i + 1] AS x FROM (SELECT *, unnest(range(len(said))) AS i FROM texts WHERE NOT cut AND NOT odd)),
    stated AS (SELECT *, row_number() OVER (PARTITION BY ev_id ORDER BY i) AS n, CASE WHEN (ev_id + i) % 3 = 1 THEN trim(replace(substr(x, 1, 40), ' ', '  '), ' ') WHEN (ev_id + i) % 3 = 0 THEN '{ABSENT}' END AS said_quote,
        CASE WHEN length(x) % 7 = 0 THEN 'no_evidence' ELSE {list(N.DIRECTIONS)}[1 + length(x) % 6] END AS direction, [1.0, 0.4, 0.0, 0.0][1 + i % 4]::DOUBLE AS confidence FROM all_findings WHERE NOT (i = 1 AND ev_id % 4 = 0)),
    parsed AS (SELECT ev_id, n, x AS statement, CASE WHEN contains({_FOLD.format('content')}, {_FOLD.format('said_quote')}) AND said_quote IS NOT NULL THEN said_quote END AS quote, direction,
        CASE WHEN direction LIKE '%supports' THEN 'SUPPORT' WHEN direction LIKE '%contradicts' THEN 'CONTRADICT' ELSE 'NOINFO' END AS label, confidence FROM stated WHERE n <= {N.MOST_FINDINGS}),
    fields AS (SELECT ev_id, CASE WHEN cut THEN 0 ELSE least(1.0, (ev_id % 150) / 100.0) END::DOUBLE AS relevance, CASE WHEN cut THEN 'background' ELSE ['direct', 'indirect', 'background'][1 + ev_id % 3] END AS directness, CASE WHEN cut THEN '' ELSE trim(' About ' || title, ' ') END AS summary,
        NOT cut AND ev_id % 3 <> 0 AND trim(title, ' ') <> '' AND (ev_id % 2 = 0 OR ev_id % 5 = 0) AS has_pico, cut OR odd AS broken FROM texts)"""


@query("parsed_findings", f"WITH {PARSED_SQL} SELECT ev_id, CAST(n AS INTEGER) AS place, statement, quote, direction, label, confidence FROM parsed")
def parsed_findings(spark, sf):
    """Findings of every output, at most three of a source, in order; quotes that the source doesn't have are dropped."""
    rows = N.parse_output(outputs(spark, sf)).select("ev_id", F.posexplode("findings").alias("at", "x"))
    return rows.select("ev_id", (F.col("at") + 1).alias("place"), "x.statement", "x.quote", "x.direction", "x.label", "x.confidence")


@query("output_fields", f"""WITH {PARSED_SQL}, n AS (SELECT ev_id, count(*) FILTER (label = 'SUPPORT') AS s, count(*) FILTER (label = 'CONTRADICT') AS c FROM parsed GROUP BY 1)
    SELECT f.ev_id, relevance, directness, has_pico, broken, CASE WHEN relevance < 0.65 OR directness = 'background' THEN 'NOINFO' WHEN s > c THEN 'SUPPORT' WHEN c > s THEN 'CONTRADICT' ELSE 'NOINFO' END AS direction FROM fields f LEFT JOIN n USING (ev_id)""")
def output_fields(spark, sf):
    """Fields of every output, and what a source says once it has passed the gates: relevance of 0.65 or more, and not background."""
    rows = N.parse_output(outputs(spark, sf))
    n = lambda label: F.size(F.filter("findings", lambda x: x["label"] == label))
    gated = (F.col("relevance") < 0.65) | (F.col("directness") == "background")
    says = F.when(gated, "NOINFO").when(n("SUPPORT") > n("CONTRADICT"), "SUPPORT").when(n("CONTRADICT") > n("SUPPORT"), "CONTRADICT").otherwise("NOINFO")
    return rows.select("ev_id", "relevance", "directness", F.col("pico").isNotNull().alias("has_pico"), F.col("corrupt").isNotNull().alias("broken"), says.alias("direction"))


@query("finding_blocks", f"""WITH {PARSED_SQL}, l AS (SELECT ev_id, string_agg('- ' || statement || coalesce(' "' || quote || '"', '') || ' [' || label || ']', chr(10) ORDER BY n) AS block FROM parsed GROUP BY 1)
    SELECT ev_id, coalesce(block, summary) AS block FROM fields LEFT JOIN l USING (ev_id)""")
def finding_blocks(spark, sf):
    """What a prompt shows of each source: its findings with their quotes, or its summary."""
    return N.parse_output(outputs(spark, sf)).select("ev_id", N.block_of(F.col("findings"), F.col("summary")).alias("block"))


@query("two_propositions", f"""WITH {PARSED_SQL}, p AS (SELECT f.ev_id, coalesce(max(confidence) FILTER (label = 'SUPPORT'), 0) AS s, coalesce(max(confidence) FILTER (label = 'CONTRADICT'), 0) AS c FROM fields f LEFT JOIN parsed USING (ev_id) GROUP BY f.ev_id)
    SELECT ev_id, CASE WHEN s >= 0.5 AND s > c THEN 'SUPPORT' WHEN c >= 0.5 AND c > s THEN 'CONTRADICT' ELSE 'NOINFO' END AS label, round(CASE WHEN s >= 0.5 AND s > c THEN s WHEN c >= 0.5 AND c > s THEN c ELSE 1 - greatest(s, c) END, 6)::DOUBLE AS decisive FROM p""")
def two_propositions(spark, sf):
    """What a source says by two scores, of the strongest finding for and of the strongest against, and the score that decides."""
    rows = N.parse_output(outputs(spark, sf))
    best = lambda label: F.coalesce(F.array_max(F.transform(F.filter("findings", lambda x: x["label"] == label), lambda x: x["confidence"])), F.lit(0.0))
    return rows.select("ev_id", best("SUPPORT").alias("s"), best("CONTRADICT").alias("c")).select("ev_id", *(c.alias(n) for n, c in N.classify(F.col("s"), F.col("c")).items()))
