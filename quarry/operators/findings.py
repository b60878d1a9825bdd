"""Nested model output: findings with quotes, read leniently, held against their source, and rendered for prompts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions.text import fold_space

#: Words of a finding's direction and directness, what directions collapse to, and how many findings of a source count.
DIRECTIONS = ("supports", "weakly_supports", "contradicts", "strongly_contradicts", "no_evidence", "mixed")
DIRECTNESS = ("direct", "indirect", "background")
MOST_FINDINGS = 3
OUTPUT = (
    "relevance string, directness string, summary string, findings array<struct<statement: string, quote: string, direction: string, confidence: string>>, "
    "pico struct<population: string, intervention: string, comparison: string, outcome: string>, corrupt string"
)


def _word(value: Column, known: tuple[str, ...], default: str) -> Column:
    low = F.lower(F.trim(F.coalesce(value, F.lit(""))))
    return F.when(low.isin(*known), low).otherwise(default)


def _share(value: Column) -> Column:
    """A number in [0, 1], whether it came as one or as text; 0 for what is none."""
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.coalesce(F.nullif(value.try_cast("double"), F.lit(float("nan"))), F.lit(0.0))))


def _said(value: Column) -> Column:
    return F.nullif(F.trim(F.coalesce(value, F.lit(""))), F.lit(""))


def collapse(direction: Column) -> Column:
    return F.when(F.endswith(direction, F.lit("supports")), "SUPPORT").when(F.endswith(direction, F.lit("contradicts")), "CONTRADICT").otherwise("NOINFO")


def parse_output(rows: DataFrame, raw_col: str = "raw", content_col: str = "content") -> DataFrame:
    """``rows`` with the fields of the JSON in ``raw_col``: relevance, directness, summary, findings, pico, and ``corrupt`` with what couldn't be read whole.
    Of JSON that is broken nothing counts; where a field is of another kind, the others do.

    Fields that are missing or of another kind fall to their defaults: relevance to 0 and into [0, 1], directness to background. Of the findings, those without a statement
    go, and the first MOST_FINDINGS are kept; a quote that doesn't stand in ``content_col``, apart from case and white space, is
    dropped, and its finding stays without it. A finding has a confidence in [0, 1], a direction and its ``label``. A PICO counts only if it states an intervention and an
    outcome or a population; else it is null.
    """
    whole = F.try_parse_json(F.col(raw_col)).isNotNull()  # of broken JSON Spark reads more or less, as it is broken
    read = F.when(whole, F.from_json(F.col(raw_col), OUTPUT, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "corrupt"}))
    got = rows.withColumn("_read", read).withColumn("_content", fold_space(F.col(content_col)))

    def finding(x: Column) -> Column:
        direction, quote = _word(x["direction"], DIRECTIONS, "no_evidence"), _said(x["quote"])
        grounded = F.contains(F.col("_content"), fold_space(quote))
        return F.struct(
            F.trim(x["statement"]).alias("statement"), F.when(grounded, quote).alias("quote"), direction.alias("direction"), collapse(direction).alias("label"), _share(x["confidence"]).alias("confidence")
        )

    stated = F.filter(F.coalesce(F.col("_read.findings"), F.array()), lambda x: _said(x["statement"]).isNotNull())
    p = {n: _said(F.col(f"_read.pico.{n}")) for n in ("population", "intervention", "comparison", "outcome")}
    pico = F.when(p["intervention"].isNotNull() & (p["outcome"].isNotNull() | p["population"].isNotNull()), F.struct(*(c.alias(n) for n, c in p.items())))
    return got.select(
        *rows.columns, _share(F.col("_read.relevance")).alias("relevance"), _word(F.col("_read.directness"), DIRECTNESS, "background").alias("directness"), F.coalesce(_said(F.col("_read.summary")), F.lit("")).alias("summary"),
        F.transform(F.slice(stated, 1, MOST_FINDINGS), finding).alias("findings"), pico.alias("pico"), F.when(F.col("_read").isNull(), F.coalesce(F.col(raw_col), F.lit(""))).otherwise(F.col("_read.corrupt")).alias("corrupt"),
    )


def block_of(findings: Column, summary: Column) -> Column:
    """What a prompt shows of a source: a line for each finding, with its quote if it has one, or the summary where it has no findings."""
    lines = F.transform(findings, lambda x: F.concat(F.lit("- "), x["statement"], F.coalesce(F.concat(F.lit(' "'), x["quote"], F.lit('"')), F.lit("")), F.lit(" ["), x["label"], F.lit("]")))
    return F.when(F.size(findings) > 0, F.array_join(lines, "\n")).otherwise(summary)


#: Fixed value: a proposition holds from this score on.
HOLDS = 0.5


def classify(supports: Column, contradicts: Column) -> dict[str, Column]:
    """label and decisive: the proposition that holds and outweighs the other, with its score; else NOINFO, with how far both are from certain."""
    yes, no = (supports >= HOLDS) & (supports > contradicts), (contradicts >= HOLDS) & (contradicts > supports)
    decisive = F.when(yes, supports).when(no, contradicts).otherwise(1 - F.greatest(supports, contradicts))
    return {"label": F.when(yes, "SUPPORT").when(no, "CONTRADICT").otherwise("NOINFO"), "decisive": F.round(decisive, 6)}
