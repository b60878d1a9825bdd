"""Dumps that need more than a projection: sections in order, children of a record, and id crosswalks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quarry.operators.retrieve import top_per_group
from quarry.sources.dumps import normalise_dump, plain, some

JATS = "id string, abstract string, body struct<sec: array<struct<title: string, p: array<string>>>>"


def jats_full_text(dump: DataFrame, most: int = 60_000) -> DataFrame:
    """id and text of full-text articles: the abstract first, then each section under ``## title``; articles without a body go."""
    section = lambda s: F.concat_ws("\n", F.when(plain(s["title"]) != "", F.concat(F.lit("\n## "), plain(s["title"]), F.lit("\n"))), F.array_join(F.filter(F.transform(s["p"], lambda p: F.trim(p)), lambda p: p != ""), "\n"))
    parts = F.array_join(F.filter(F.transform("body.sec", section), lambda x: x != ""), "\n")
    head = F.when(plain(F.col("abstract")) != "", F.concat(F.lit("## Abstract\n"), plain(F.col("abstract")), F.lit("\n")))
    return dump.filter("body is not null").select("id", F.substring(F.concat_ws("\n", head, F.nullif(parts, F.lit(""))), 1, most).alias("text")).filter("text <> ''")


#: Section codes of structured product labels, and our names for them.
SPL_CODES = {
    "34066-1": "boxed_warning", "34067-9": "indications_and_usage", "34068-7": "dosage_and_administration", "34070-3": "contraindications", "43685-7": "warnings_and_cautions", "34071-1": "warnings", "34084-4": "adverse_reactions",
    "34073-7": "drug_interactions", "43679-0": "mechanism_of_action", "43681-6": "pharmacodynamics", "43682-4": "pharmacokinetics", "34090-1": "clinical_pharmacology", "34088-5": "overdosage", "34089-3": "description",
}


def label_sections(sections: DataFrame, most: int = 500) -> DataFrame:
    """set_id, field, text: the first text of each known section code. ``sections``: set_id, code, position, text."""
    codes = sections.sparkSession.createDataFrame(list(SPL_CODES.items()), "code string, field string")
    known = sections.join(F.broadcast(codes), "code").withColumn("text", plain(F.col("text"))).filter("text <> ''")
    return known.groupBy("set_id", "field").agg(F.substring(F.min_by("text", "position"), 1, most).alias("text"))


def indicator_facts(facts: DataFrame, countries: int = 5, points: int = 5) -> DataFrame:
    """indicator, country, facts: newest first, of the first countries of each indicator. ``facts``: indicator, country, year, value, arrival."""
    first = facts.groupBy("indicator", "country").agg(F.min("arrival").alias("arrival"))
    kept = top_per_group(first, ["indicator"], ["arrival"], countries, "n").select("indicator", "country")
    newest = top_per_group(facts.join(kept, ["indicator", "country"]), ["indicator", "country"], [F.desc("year"), "arrival"], points, "n")
    line = F.concat_ws(": ", F.col("year").cast("string"), F.col("value").cast("string"))
    return newest.groupBy("indicator", "country").agg(F.sort_array(F.collect_list(F.struct("n", line.alias("line")))).alias("f")).select("indicator", "country", F.array_join(F.transform("f", lambda x: x["line"]), "; ").alias("facts"))


def child_lines(children: DataFrame, key: str, line, most: int) -> DataFrame:
    """``key`` and the lines of its first ``most`` children by ``position``."""
    kept = top_per_group(children, [key], ["position"], most, "_n")
    return kept.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("_n", line.alias("line")))).alias("l")).select(key, F.transform("l", lambda x: x["line"]).alias("lines"))


def bracket(column, opening: str, closing: str):
    return F.when(some(column) != "", F.concat(F.lit(opening), some(column), F.lit(closing))).otherwise("")


def molecules(mols: DataFrame, mechanisms: DataFrame, indications: DataFrame, warnings: DataFrame) -> DataFrame:
    """Evidence records of molecules with at most five mechanisms, eight indications and five warnings each."""
    mech = F.concat(F.lit("- "), some(F.col("mechanism_of_action")), bracket(F.col("action_type"), " (", ")"), bracket(F.col("target_chembl_id"), " [target: ", "]"))
    ind = F.concat(F.lit("- "), F.coalesce(F.nullif(some(F.col("mesh_heading"), F.col("efo_term")), F.lit("")), F.lit("Unknown")), F.lit(" (phase "), some(F.col("max_phase_for_ind")), F.lit(")"))
    warn = F.concat(F.lit("- "), some(F.col("warning_type")), bracket(F.col("warning_class"), " (", ")"), bracket(F.col("warning_description"), ": ", ""), bracket(F.col("warning_year"), " [", "]"), bracket(F.col("warning_country"), " [", "]"))
    out, key = mols, "molecule_chembl_id"
    for name, children, line, most in (("Mechanisms", mechanisms, mech, 5), ("Indications", indications, ind, 8), ("Warnings", warnings, warn, 5)):
        out = out.join(child_lines(children, key, line, most).withColumnRenamed("lines", name), key, "left")
    block = lambda n: F.when(F.size(n) > 0, F.concat(F.lit(f"## {n}\n"), F.array_join(n, "\n")))
    text = F.concat_ws("\n", F.concat(F.lit("Molecule: "), F.col("pref_name")), *map(block, ("Mechanisms", "Indications", "Warnings")))
    return normalise_dump(out, {"title": F.col("pref_name"), "url": F.concat(F.lit("https://www.ebi.ac.uk/chembl/explore/compound/"), F.col(key)), "content": text}, "chembl")


def molecule_priority(mols: DataFrame, name: str) -> DataFrame:
    """Named molecules, exact names first, then later phases; unnamed ones only where nothing is named. Adds ``place``.

    ``mols``: topic_id, pref_name, max_phase string, arrival.
    """
    named = F.col("pref_name").isNotNull()
    phase = F.coalesce(F.col("max_phase").try_cast("double"), F.lit(-1.0))
    ranked = top_per_group(mols, ["topic_id"], [(~named), F.lower("pref_name") != name.lower(), -phase, "arrival"], 1 << 30, "place")
    return ranked.withColumn("_any", F.max(named).over(Window.partitionBy("topic_id"))).filter(named | ~F.col("_any")).drop("_any")


def platform_entities(hits: DataFrame, enriched: DataFrame) -> DataFrame:
    """Search hits as records: drugs with their enriched text where there is one, all others as they come.

    ``hits``: id, name, entity, description. ``enriched``: id, text.
    """
    known = F.when(F.col("entity").isin("drug", "disease", "target"), F.col("entity")).otherwise("search")
    own = F.concat(F.initcap("entity"), F.lit(": "), "name", F.lit("\nID: "), "id", F.lit("\n\n"), F.coalesce("description", F.lit("")))
    drugs = hits.filter("entity = 'drug'").join(enriched, "id", "left").withColumn("text", F.coalesce("text", own))
    both = drugs.unionByName(hits.filter("not entity <=> 'drug'").withColumn("text", own))
    return normalise_dump(both, {"title": F.concat("name", F.lit(" - Open Targets ("), "entity", F.lit(")")), "url": F.concat(F.lit("https://platform.opentargets.org/"), known, F.lit("/"), "id"), "content": F.col("text"), "snippet": F.concat(F.lit("Open Targets "), "entity", F.lit(": "), "name")}, "open_targets")


def drug_vocabulary(names: DataFrame, concepts: DataFrame, related: DataFrame, brands: int = 5) -> DataFrame:
    """name, concept, ingredient and at most five brands; an unknown name stays with matched false.

    ``names``: name. ``concepts``: name, concept. ``related``: concept, kind ('ingredient' or 'brand'), label, position.
    """
    ingredient = related.filter("kind = 'ingredient'").groupBy("concept").agg(F.min_by("label", "position").alias("ingredient"))
    lists = child_lines(related.filter("kind = 'brand'"), "concept", F.col("label"), brands).withColumnRenamed("lines", "brands")
    met = names.join(concepts, "name", "left").join(ingredient, "concept", "left").join(lists, "concept", "left")
    return met.select("name", "concept", F.coalesce("ingredient", "name").alias("ingredient"), F.coalesce("brands", F.array().cast("array<string>")).alias("brands"), F.col("concept").isNotNull().alias("matched"))


PAPERS = "title string, url string, externalIds struct<DOI: string>, year int, abstract string, citationCount long"


def citation_papers(papers: DataFrame) -> DataFrame:
    """Papers of a citation service; one without url and DOI goes."""
    url = some(F.col("url"), F.concat(F.lit("https://doi.org/"), F.col("externalIds.DOI")))
    facts = F.concat_ws("\n", F.concat(F.lit("Title: "), "title"), F.concat(F.lit("Year: "), F.col("year").cast("string")), F.when(F.col("citationCount") > 0, F.concat(F.lit("Citations: "), F.col("citationCount").cast("string"))))
    text = F.concat(facts, F.when(some(F.col("abstract")) != "", F.concat(F.lit("\n\nAbstract: "), "abstract")).otherwise(""))
    return normalise_dump(papers, {"title": F.col("title"), "url": url, "content": text, "snippet": some(F.col("abstract"), F.col("title")), "publication_date": F.col("year").cast("string"), "citation_count": F.col("citationCount")}, "semantic_scholar")


#: Link names that lead to an article's own full text, the preferred first.
OWN_COPY = ("pubmed_pmc", "pubmed_pmc_local")


def full_text_ids(links: DataFrame) -> DataFrame:
    """pmid, pmcid of each article's own copy. ``links``: pmid, linkname, pmcid, position; links of citing articles are left out."""
    order = F.when(F.col("linkname") == OWN_COPY[0], 0).otherwise(1)
    return links.filter(F.col("linkname").isin(*OWN_COPY)).groupBy("pmid").agg(F.min_by("pmcid", F.struct(order.alias("o"), "position")).alias("pmcid"))


def gold_labels(evidence: DataFrame) -> DataFrame:
    """claim, doc, label: the only label of a document's evidence sets for a claim, else NOINFO. ``evidence``: claim, doc, label (null: no evidence)."""
    return evidence.groupBy("claim", "doc").agg(F.collect_set("label").alias("l")).select("claim", "doc", F.when(F.size("l") == 1, F.col("l")[0]).otherwise("NOINFO").alias("label"))


def claim_labels(evidence: DataFrame) -> DataFrame:
    """claim, label: the only label of all evidence, NOINFO without any; claims of mixed labels go."""
    return evidence.groupBy("claim").agg(F.collect_set("label").alias("l")).filter(F.size("l") <= 1).select("claim", F.coalesce(F.try_element_at("l", F.lit(1)), F.lit("NOINFO")).alias("label"))
