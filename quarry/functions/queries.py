"""What is asked of a provider, made of a topic's fields, Column to Column."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words that a search doesn't need.
SEARCH_STOPWORDS = tuple(
    "a an the is are was were be been being have has had do does did will would shall should may might must can could of in to for with on at from by about as into through during before after above below between "
    "out off over under again further then once that this these those what which who whom when where why how all each every both few more most other some such no not only same so than too very and but or if "
    "it its they their them he she his her".split()
)
#: Filters by type of publication.
TYPE_FILTERS = {
    "systematic_review": "(systematic review[pt] OR meta-analysis[pt])", "cochrane_review": '(systematic review[pt] OR meta-analysis[pt]) AND "cochrane database syst rev"[ta]', "rct": "randomized controlled trial[pt]",
    "guideline": "(practice guideline[pt] OR guideline[pt])", "clinical_trial": "clinical trial[pt]", "review": "review[pt]",
}
#: The type of publication that answers a type of topic, topics that reviews answer, those that only recent work answers, and those about a drug.
TYPE_EVIDENCE = {"dosage": "guideline", "drug_interaction": "systematic_review", "contraindication": "guideline", "adverse_effect": "systematic_review", "clinical_guideline": "guideline", "diagnostic_criteria": "guideline"}
FOUNDATIONAL = ("assertion", "definition", "anatomy", "physiology", "mechanism_of_action", "pathophysiology", "classification", "drug_classification", "statistic", "reference_value", "diagnostic_criteria")
RECENT = ("epidemiology", "prevalence", "incidence")
DRUG_TOPICS = ("dosage", "drug", "drug_classification", "drug_interaction")
#: Registers that are searched by a drug's name, and the words that are taken out of a question to get at that.
NAME_REGISTERS = ("ema", "openfda", "dailymed")
NOT_NAMES = (
    "what|is|the|drug|for|of|and|with|side|effects?|dose|dosage|indication|contraindication|interaction|mechanism|action|"
    "farmaco|indicazion[ei]|dosaggio|controindicazion[ei]|interazion[ei]|meccanismo|azione|effett[oi]|collateral[ie]"
)
#: Characters that are no part of a keyword, and the field tags that a ready query bears.
NOT_KEYWORD, TAGGED = r"""["'()\[\]{}<>:;,./\\]""", r"(?i)\[(?:MeSH|tiab|pt|au|Title|Abstract)"


def keywords(text: Column, most: int, least: int = 3) -> Column:
    """The first ``most`` words of ``least`` characters or more that a search needs."""
    words = F.split(F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), NOT_KEYWORD, " ")), r"\s+")
    return F.slice(F.filter(words, lambda w: (F.length(w) >= least) & ~F.lower(w).isin(*SEARCH_STOPWORDS)), 1, most)


def _joined(words: Column, form, by: str) -> Column:
    return F.array_join(F.transform(words, form), by)


def _quoted(tag: str):
    return lambda w: F.concat(F.lit('"'), w, F.lit(f'"[{tag}]'))


def _tagged(w: Column) -> Column:
    return F.concat(w, F.lit("[tiab]"))


def literature_query(query: Column, mesh: Column, drugs: Column, diseases: Column, kind: Column) -> Column:
    """A boolean query with field tags.

    One that has tags is left as it is. With vocabulary terms: at most three, the first as main heading, and three keywords. Without: blocks of at most two drugs and two
    diseases, and where there is only one block the query's keywords; without any block six keywords, of which the first three are required.
    A known ``kind`` of publication is asked for on top.
    """
    first = F.slice(mesh, 1, 3)
    vocabulary = F.array_join(F.transform(first, lambda t, i: F.concat(F.lit('"'), t, F.when(i == 0, '"[Majr]').otherwise('"[MeSH Terms]'))), " AND ")
    few = F.slice(keywords(query, 4), 1, 3)
    anchored = F.when(F.size(few) > 0, F.concat(F.lit("("), vocabulary, F.lit(") AND ("), _joined(few, _tagged, " AND "), F.lit(")"))).otherwise(vocabulary)

    def block(names: Column) -> Column:
        return F.when(F.size(names) > 0, F.concat(F.lit("("), _joined(F.slice(names, 1, 2), _quoted("tiab"), " OR "), F.lit(")")))

    both = F.concat_ws(" AND ", block(drugs), block(diseases))
    context = F.array_join(keywords(query, 3), " ")
    alone = (F.size(drugs) > 0) != (F.size(diseases) > 0)
    blocks = F.when(alone & (context != ""), F.concat(F.lit("("), both, F.lit(") AND ("), context, F.lit("[tiab])"))).otherwise(both)
    six = keywords(query, 6)
    plain = F.when(F.size(six) == 0, query).when(F.size(six) <= 3, _joined(six, _tagged, " AND ")).otherwise(
        F.concat(F.lit("("), _joined(F.slice(six, 1, 3), _tagged, " AND "), F.lit(") AND ("), F.array_join(F.slice(six, 4, 3), " "), F.lit(")"))
    )
    bare = ~F.regexp_like(query, F.lit(TAGGED)) & (F.size(mesh) == 0) & (F.size(drugs) == 0) & (F.size(diseases) == 0) & (F.size(six) == 0)
    base = F.when(F.regexp_like(query, F.lit(TAGGED)), query).when(F.size(mesh) > 0, anchored).when((F.size(drugs) > 0) | (F.size(diseases) > 0), blocks).otherwise(plain)
    wanted = F.create_map(*(F.lit(x) for pair in TYPE_FILTERS.items() for x in pair))[kind]
    return F.when(wanted.isNotNull() & ~bare, F.concat(F.lit("("), base, F.lit(") AND "), wanted)).otherwise(base)


def vocabulary_terms(queries: Column) -> Column:
    """Terms that stand in an array of queries as ``"term"[MeSH Terms]``, each once, in order."""
    return F.array_distinct(F.flatten(F.transform(queries, lambda q: F.regexp_extract_all(q, F.lit(r'"([^"]+)"\[MeSH Terms\]'), F.lit(1)))))


def topic_options(topic_type: Column, subject: Column) -> dict[str, Column]:
    """drugs, kind, prefer_reviews, recent_only for a type of topic."""
    named = F.trim(F.coalesce(subject, F.lit("")))
    return {
        "drugs": F.when(topic_type.isin(*DRUG_TOPICS) & (named != ""), F.array(named)).otherwise(F.array().cast("array<string>")), "kind": F.create_map(*(F.lit(x) for pair in TYPE_EVIDENCE.items() for x in pair))[topic_type],
        "prefer_reviews": topic_type.isin(*FOUNDATIONAL), "recent_only": topic_type.isin(*RECENT),
    }


def main_query(given: Column, pico: Column, subject: Column, value: Column, text: Column) -> Column:
    """The query that was given; else the terms of a PICO that states an intervention and an outcome or a population, cut at 120 characters; else subject and
    value; else the first 60 characters of the text. Blank fields count as missing."""
    said = lambda c: F.nullif(F.trim(F.coalesce(c, F.lit(""))), F.lit(""))
    p = {n: said(pico[n]) for n in ("population", "intervention", "comparison", "outcome")}
    stated = p["intervention"].isNotNull() & (p["outcome"].isNotNull() | p["population"].isNotNull())
    own = said(F.concat_ws(" ", said(subject), said(value)))
    return F.coalesce(said(given), F.when(stated, F.substring(F.concat_ws(" ", *p.values()), 1, 120)), own, F.substring(F.coalesce(text, F.lit("")), 1, 60))


def with_subject(query: Column, provider: Column, subject: Column) -> Column:
    """For registers that go by name: the topic's drug before a query that doesn't hold it."""
    named = F.trim(F.coalesce(subject, F.lit("")))
    needs = provider.isin(*NAME_REGISTERS) & (named != "") & ~F.contains(F.lower(query), F.lower(named))
    return F.when(needs, F.concat(named, F.lit(" "), query)).otherwise(query)


def with_keywords(query: Column, words: Column) -> Column:
    """Words that a query doesn't hold yet, behind it."""
    more = F.filter(words, lambda w: ~F.contains(F.lower(query), F.lower(w)))
    return F.when(F.size(more) > 0, F.concat(query, F.lit(" "), F.array_join(more, " "))).otherwise(query)


def drug_name(query: Column) -> Column:
    """At most three words of over two characters, without those that ask about a drug."""
    bare = F.regexp_replace(F.regexp_replace(query, rf"(?i)\b({NOT_NAMES})\b", " "), r"""["'()\[\]{}<>?!.,;:]""", " ")
    return F.array_join(F.slice(F.filter(F.split(F.trim(bare), r"\s+"), lambda w: F.length(w) > 2), 1, 3), " ")
