"""Ranking signals, Column to Column."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Saturation, half life and neutral score of the curves.
CITATION_CAP, HALF_LIFE, UNKNOWN_RECENCY = 1000, 8.0, 0.5
#: Weights before and after relevance is judged.
PRIOR_WEIGHTS = {"rerank": 0.35, "cosine": 0.20, "bm25": 0.12, "rrf": 0.09, "concept": 0.09, "evidence": 0.08, "citation": 0.02, "recency": 0.02, "tier": 0.01, "offtopic": -0.30}
FINAL_WEIGHTS = {"relevance": 0.36, "cosine": 0.19, "evidence": 0.12, "rerank": 0.11, "bm25": 0.08, "concept": 0.06, "recency": 0.04, "citation": 0.02, "tier": 0.02, "offtopic": -0.30}


def citation(count: Column) -> Column:
    return F.when(F.coalesce(count, F.lit(0)) <= 0, 0.0).otherwise(F.least(F.lit(1.0), F.log1p(count.cast("double")) / F.log1p(F.lit(float(CITATION_CAP)))))


def pub_year(date: Column) -> Column:
    return F.nullif(F.regexp_extract(F.coalesce(date, F.lit("")), r"((?:19|20)\d{2})", 1), F.lit("")).cast("int")


def recency(date: Column, as_of_year: int) -> Column:
    age = F.greatest(F.lit(0), F.lit(as_of_year) - pub_year(date)).cast("double")
    return F.coalesce(F.pow(F.lit(0.5), age / HALF_LIFE), F.lit(UNKNOWN_RECENCY))


def tier(value: Column) -> Column:
    return F.when(value == 1, 1.0).when(value == 2, 0.6).otherwise(0.2)


def terms_held(text: Column, terms: Column) -> Column:
    """How many of the ``terms`` a text holds, in any case: a phrase as a substring, a single word between word boundaries.

    The text is split into words once, and a term of word characters meets them by equality. Only a single word with other characters in it
    ("covid-19") is sought by an expression. Blank terms are in no text, repeated ones count each time.
    """
    low = F.lower(F.coalesce(text, F.lit("")))
    split = F.array(F.struct(low.alias("text"), F.split(low, r"[^\p{L}\p{N}_]+").alias("words")))

    def held(t: Column, x: Column) -> Column:
        quoted = F.concat(F.lit(r"(?<![\p{L}\p{N}_])\Q"), t, F.lit(r"\E(?![\p{L}\p{N}_])"))
        plain = F.regexp_like(t, F.lit(r"^[\p{L}\p{N}_]+$"))
        return F.when(t == "", False).when(F.contains(t, F.lit(" ")), F.contains(x["text"], t)).when(plain, F.array_contains(x["words"], t)).otherwise(F.regexp_like(x["text"], quoted))

    wanted = F.transform(terms, lambda t: F.lower(F.trim(t)))
    return F.transform(split, lambda x: F.size(F.filter(wanted, lambda t: held(t, x))))[0]


def concept_share(text: Column, concepts: Column) -> Column:
    return F.when((F.size(concepts) > 0) & (F.coalesce(text, F.lit("")) != ""), terms_held(text, concepts) / F.size(concepts)).otherwise(0.0)


def offtopic(text: Column, negatives: Column) -> Column:
    return F.when((F.size(negatives) > 0) & (F.coalesce(text, F.lit("")) != ""), F.least(F.lit(1.0), terms_held(text, negatives) / 2.0)).otherwise(0.0)


def weighted(weights: dict[str, float], by_name: dict[str, Column] | None = None) -> Column:
    """Sum of weight times signal; an absent signal counts 0."""
    total = F.lit(0.0)
    for name, weight in weights.items():
        total = total + F.lit(weight) * F.coalesce((by_name or {}).get(name, F.col(name)), F.lit(0.0))
    return total


def weighted_sql(weights: dict[str, float]) -> str:
    return "0.0::DOUBLE + " + " + ".join(f"({w}::DOUBLE * coalesce({n}, 0.0))" for n, w in weights.items())
