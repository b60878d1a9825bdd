"""Cutting long texts by their sections."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions import text as T


def trim_sections(
    rows: DataFrame, text: str, budget: int, order: tuple[str, ...] = T.BIOMED_PRIORITY, skip: tuple[str, ...] = T.SKIPPED_SECTIONS,
    score: Callable[[Column], Column] | None = None, keep_first: bool = True,
) -> DataFrame:
    """``rows`` with ``text`` cut to ``budget`` characters, shared among its sections; all within the row, so nothing is shuffled.

    A text within the budget stays as it is. Else sections whose heading holds a word of ``skip`` go, and the rest is put
    in order: by the place of the first word of ``order`` that a heading holds, or by falling ``score`` of the section's text
    (a null score comes last); equal ones keep their place. With ``keep_first`` the first section is never skipped and leads.
    Each section gets an equal share of the budget, and what short ones leave goes to the others in that order. Null stays null.
    """
    lead = lambda k: (k == 0) if keep_first else F.lit(False)

    def placed(section: Column, k: Column) -> Column:
        rank = T.section_priority(T.section_name(section), order, skip)
        by = rank.cast("double") if score is None else F.coalesce(-score(section), F.lit(float("inf")))
        return F.struct((~lead(k)).alias("rest"), by.alias("rank"), k.alias("place"), section.alias("body"), (lead(k) | rank.isNotNull()).alias("kept"))

    every = F.filter(F.transform(T.sections(F.col(text)), placed), lambda s: s["kept"])
    rows = rows.withColumn("_parts", F.when(F.length(text) > budget, F.array_sort(every)))
    rows = rows.withColumn("_share", F.floor(F.lit(budget) / F.greatest(F.size("_parts"), F.lit(1))).cast("int"))
    used = F.aggregate("_parts", F.lit(0), lambda sum_, s: sum_ + F.least(F.length(s["body"]), F.col("_share")))
    start = F.struct((budget - used).alias("slack"), F.lit("").alias("text"))

    def grant(state: Column, s: Column) -> Column:
        given = F.least(F.length(s["body"]), F.col("_share") + state["slack"])
        own = F.least(F.length(s["body"]), F.col("_share"))
        return F.struct((state["slack"] - (given - own)).alias("slack"), F.concat(state["text"], F.substring(s["body"], F.lit(1), given)).alias("text"))

    cut = F.aggregate("_parts", start, grant, lambda state: state["text"])
    return rows.withColumn(text, F.when(F.length(text) > budget, cut).otherwise(F.col(text))).drop("_parts", "_share")


def density(section: Column) -> Column:
    """Score of an encyclopaedia's section: its numbers, years and length."""
    n = F.length(section)
    numbers = F.regexp_count(section, F.lit(r"[0-9]+"))
    years = F.regexp_count(section, F.lit(r"[0-9]{4}"))
    return numbers * 0.5 + years * 1.5 + F.least(n / 500, F.lit(3.0)) + F.when(n > 200, 1.0).otherwise(0.3)
