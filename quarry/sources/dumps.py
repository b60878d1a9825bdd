"""Provider dumps to evidence records: one operator, and a mapping of column expressions for each provider.

Every mapping is written for the dump as Spark's JSON or XML reader gives it; all give the same
columns, in the order of FIELDS, with '' for what a dump lacks.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

FIELDS = ("source_type", "title", "url", "snippet", "content", "publication_date", "citation_count", "publication_types")
SNIPPET, CONTENT = 300, 4000


def some(*columns: Column) -> Column:
    """The first that isn't null or ''."""
    return F.coalesce(*(F.nullif(F.trim(c.cast("string")), F.lit("")) for c in columns), F.lit(""))


def plain(text: Column) -> Column:
    """Without tags, white space folded."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.coalesce(text, F.lit("")), "<[^>]+>", ""), r"\s+", " "))


def lines(*pairs: tuple[str, Column]) -> Column:
    """``Label: value`` lines of what is there."""
    parts = [F.when(F.coalesce(c, F.lit("")) != "", F.concat(F.lit(f"{label}: "), c)) for label, c in pairs]
    return F.array_join(F.array_compact(F.array(*parts)), "\n")


def authors(names: Column, most: int = 6) -> Column:
    head = F.array_join(F.slice(names, 1, most), ", ")
    return F.when(F.size(names) > most, F.concat(head, F.lit(" et al."))).otherwise(F.coalesce(head, F.lit("")))


def normalise_dump(dump: DataFrame, mapping: dict[str, Column], source_type: str, content_chars: int = CONTENT, more: dict[str, Column] | None = None) -> DataFrame:
    """``dump`` as evidence records by ``mapping``, with columns of ``more`` behind them; rows without title and url go."""
    text = F.coalesce(mapping.get("content", F.lit("")), F.lit(""))
    out = dump.select(
        F.lit(source_type).alias("source_type"), some(mapping["title"]).alias("title"), some(mapping["url"]).alias("url"), F.substring(some(mapping.get("snippet", text)), 1, SNIPPET).alias("snippet"),
        F.substring(text, 1, content_chars).alias("content"), some(mapping.get("publication_date", F.lit(""))).alias("publication_date"),
        F.coalesce(mapping.get("citation_count", F.lit(0)).try_cast("long"), F.lit(0)).alias("citation_count"), F.coalesce(mapping.get("publication_types", F.array().cast("array<string>")), F.array().cast("array<string>")).alias("publication_types"),
        *(c.alias(name) for name, c in (more or {}).items()),
    )
    return out.filter((F.col("title") != "") & (F.col("url") != ""))


EUROPE_PMC = "id string, pmid string, pmcid string, doi string, title string, abstractText string, firstPublicationDate string, citedByCount long, pubTypeList struct<pubType: array<string>>"


def europe_pmc() -> dict[str, Column]:
    """The url prefers the PMC id, then the PubMed id, then the DOI."""
    url = F.coalesce(F.concat(F.lit("https://europepmc.org/article/PMC/"), F.col("pmcid")), F.concat(F.lit("https://europepmc.org/article/MED/"), F.col("pmid")), F.concat(F.lit("https://doi.org/"), F.col("doi")))
    return {"title": plain(F.col("title")), "url": url, "content": plain(F.col("abstractText")), "publication_date": F.col("firstPublicationDate"), "citation_count": F.col("citedByCount"), "publication_types": F.col("pubTypeList.pubType")}


TRIALS = "nctId string, briefTitle string, overallStatus string, phases array<string>, enrollment long, conditions array<string>, outcomes array<string>, summary string, startDate string"


def clinicaltrials() -> dict[str, Column]:
    text = lines(("Status", F.col("overallStatus")), ("Phase", F.array_join("phases", ", ")), ("Enrolment", F.col("enrollment").cast("string")), ("Conditions", F.array_join(F.slice("conditions", 1, 5), ", ")), ("Outcomes", F.array_join(F.slice("outcomes", 1, 5), "; ")), ("Summary", F.col("summary")))
    return {"title": F.col("briefTitle"), "url": F.concat(F.lit("https://clinicaltrials.gov/study/"), F.col("nctId")), "content": text, "snippet": F.col("summary"), "publication_date": F.col("startDate")}


#: Sections of a drug label in the order in which they are shown.
LABEL_SECTIONS = (
    "boxed_warning", "indications_and_usage", "dosage_and_administration", "contraindications", "warnings_and_cautions", "warnings", "adverse_reactions", "drug_interactions",
    "mechanism_of_action", "pharmacodynamics", "pharmacokinetics", "clinical_pharmacology", "overdosage", "pregnancy", "pediatric_use", "geriatric_use",
)
OPENFDA = "set_id string, openfda struct<generic_name: array<string>, brand_name: array<string>, substance_name: array<string>>, effective_time string, " + ", ".join(f"{s} array<string>" for s in LABEL_SECTIONS)


def openfda() -> dict[str, Column]:
    first = lambda c: F.try_element_at(F.col(c), F.lit(1))
    name = some(first("openfda.generic_name"), first("openfda.brand_name"), first("openfda.substance_name"))
    text = lines(*((s.replace("_", " ").capitalize(), F.substring(plain(first(s)), 1, 800)) for s in LABEL_SECTIONS))
    return {"title": F.when(name != "", F.concat(name, F.lit(" drug label"))), "url": F.concat(F.lit("https://dailymed.nlm.nih.gov/dailymed/drugInfo.cfm?setid="), F.col("set_id")), "content": text, "publication_date": F.col("effective_time")}


#: What a register says of how much evidence an authorisation rests on, by its columns.
REGISTER_FLAGS = {
    "orphan": "orphan", "conditional_approval": "conditional approval", "exceptional_circumstances": "exceptional circumstances", "accelerated_assessment": "accelerated assessment", "additional_monitoring": "additional monitoring",
    "advanced_therapy": "advanced therapy (ATMP)", "prime": "PRIME priority medicine", "generic": "generic", "biosimilar": "biosimilar",
}
EMA = "name string, url string, inn string, atc string, status string, area string, indication string, " + ", ".join(f"{c} string" for c in REGISTER_FLAGS) + ", last_updated string"


def is_yes(column: str) -> Column:
    return F.lower(F.trim(F.coalesce(F.col(column), F.lit("")))) == "yes"


def is_reference_medicine() -> Column:
    """Whether a register row is neither a generic nor a biosimilar."""
    return ~(is_yes("generic") | is_yes("biosimilar"))


def ema() -> dict[str, Column]:
    """A register row; flags are the columns that say yes, and the date turns ISO."""
    flags = F.array_join(F.array_compact(F.array(*(F.when(is_yes(c), name) for c, name in REGISTER_FLAGS.items()))), ", ")
    text = lines(("Substance", F.col("inn")), ("ATC", F.col("atc")), ("Status", F.col("status")), ("Area", F.col("area")), ("Flags", flags), ("Indication", plain(F.col("indication"))))
    iso = F.regexp_replace("last_updated", r"^(\d{2})/(\d{2})/(\d{4})$", "$3-$2-$1")
    return {"title": F.col("name"), "url": F.col("url"), "content": text, "publication_date": iso}


WORKS = "DOI string, title array<string>, abstract string, institution array<struct<name: string>>, `container-title` array<string>, posted struct<`date-parts`: array<array<int>>>, `is-referenced-by-count` long"


def is_preprint_work() -> Column:
    server = some(F.try_element_at(F.col("institution"), F.lit(1))["name"], F.try_element_at(F.col("`container-title`"), F.lit(1)))
    return F.lower(server).isin("biorxiv", "medrxiv") | F.startswith(F.lower(F.coalesce("DOI", F.lit(""))), F.lit("10.1101/"))


def biorxiv() -> dict[str, Column]:
    """Preprint works; filter with ``is_preprint_work`` first."""
    day = F.try_element_at(F.col("posted.`date-parts`"), F.lit(1))
    date = F.array_join(F.transform(day, lambda x: F.when(x < 10, F.concat(F.lit("0"), x.cast("string"))).otherwise(x.cast("string"))), "-")
    return {"title": plain(F.try_element_at(F.col("title"), F.lit(1))), "url": F.concat(F.lit("https://doi.org/"), F.col("DOI")), "content": plain(F.col("abstract")), "publication_date": date, "citation_count": F.col("`is-referenced-by-count`")}


EXTRACTS = "pageid long, title string, extract string, language string"


def wikipedia() -> dict[str, Column]:
    url = F.concat(F.lit("https://"), F.coalesce("language", F.lit("en")), F.lit(".wikipedia.org/wiki/"), F.replace("title", F.lit(" "), F.lit("_")))
    return {"title": F.col("title"), "url": url, "content": F.col("extract")}


PUBMED = (
    "MedlineCitation struct<PMID: string, Article: struct<ArticleTitle: string, ELocationID: array<struct<_VALUE: string, _EIdType: string>>, Abstract: struct<AbstractText: array<struct<_VALUE: string, _Label: string>>>, AuthorList: struct<Author: array<struct<LastName: string, Initials: string>>>, "
    "Journal: struct<JournalIssue: struct<PubDate: struct<Year: string, Month: string, Day: string>>>, PublicationTypeList: struct<PublicationType: array<string>>>, MeshHeadingList: struct<MeshHeading: array<struct<DescriptorName: string>>>>, PubmedData struct<ArticleIdList: struct<ArticleId: array<struct<_VALUE: string, _IdType: string>>>>"
)


def pubmed_doi() -> Column:
    """The DOI among a citation's article ids, else among its electronic locations; '' if neither has one."""
    listed = F.filter(F.col("PubmedData.ArticleIdList.ArticleId"), lambda x: (x["_IdType"] == "doi") & (some(x["_VALUE"]) != ""))
    located = F.filter(F.col("MedlineCitation.Article.ELocationID"), lambda x: (x["_EIdType"] == "doi") & (some(x["_VALUE"]) != ""))
    return some(F.try_element_at(listed, F.lit(1))["_VALUE"], F.try_element_at(located, F.lit(1))["_VALUE"])


def pubmed() -> dict[str, Column]:
    """A citation with labelled abstract parts, at most six authors, date parts, types and subject headings."""
    art = F.col("MedlineCitation.Article")
    parts = F.transform(art["Abstract"]["AbstractText"], lambda p: F.when(p["_Label"].isNotNull(), F.concat(p["_Label"], F.lit(": "), p["_VALUE"])).otherwise(p["_VALUE"]))
    names = F.transform(art["AuthorList"]["Author"], lambda a: F.concat_ws(" ", a["LastName"], a["Initials"]))
    mesh = F.transform(F.col("MedlineCitation.MeshHeadingList.MeshHeading"), lambda m: m["DescriptorName"])
    day = art["Journal"]["JournalIssue"]["PubDate"]
    text = F.concat_ws("\n", F.array_join(parts, "\n"), lines(("Authors", authors(names)), ("MeSH", F.array_join(mesh, ", "))))
    return {
        "title": plain(art["ArticleTitle"]), "url": F.concat(F.lit("https://pubmed.ncbi.nlm.nih.gov/"), F.col("MedlineCitation.PMID"), F.lit("/")), "content": text, "snippet": F.array_join(parts, " "),
        "publication_date": F.concat_ws("-", day["Year"], day["Month"], day["Day"]), "publication_types": art["PublicationTypeList"]["PublicationType"],
    }


def read_json_lines(spark: SparkSession, path: str, schema: str, limit: int | None = None, order: str | None = None) -> DataFrame:
    """JSON lines by an explicit schema; blank lines are skipped. A ``limit`` needs an ``order`` to be the same each time."""
    rows = spark.read.schema(schema).json(path)
    if limit is None:
        return rows
    if order is None:
        raise ValueError("a limit needs an order")
    return rows.orderBy(order).limit(limit)


def read_questions(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The questions of a corpus that is one JSON document with a list ``questions``; ``schema`` has the fields as ``name: type``."""
    return spark.read.schema(f"questions array<struct<{schema}>>").option("multiLine", True).json(path).select(F.explode("questions").alias("q")).select("q.*")


def read_aligned(spark: SparkSession, tokens: str, labels: str, bundled: bool = False) -> DataFrame:
    """doc, position, token, label from folders of token and label files of the same names; files of unequal length give no rows but one with an error.

    Files are whole rows, so each is read by one task, and many by each task. Where there are so many that opening and listing them is the work, they can be ``bundled``:
    a line of any file is then one of them, its name and a tab before what it holds.
    """
    if bundled:
        whole = lambda path: spark.read.text(path).select(F.substring_index("value", "\t", 1).alias("doc"), F.expr(r"substring(value, instr(value, '\t') + 1)").alias("value"))
    else:
        name = F.regexp_extract(F.input_file_name(), r"([^/]+?)(?:\.[^/.]*)?$", 1)
        whole = lambda path: spark.read.text(path, wholetext=True).select(name.alias("doc"), "value")
    t = whole(tokens).select("doc", F.filter(F.split("value", r"\s+"), lambda x: x != "").alias("t"))
    m = whole(labels).select("doc", F.filter(F.split(F.trim("value"), r"[,\s]+"), lambda x: x != "").alias("l"))
    both = t.join(m, "doc", "left").withColumn("fits", F.coalesce(F.size("t") == F.size("l"), F.lit(False)))
    rows = both.select("doc", "fits", F.posexplode_outer(F.when(F.col("fits"), F.arrays_zip("t", "l"))).alias("position", "x")).filter("position is not null or not fits")
    return rows.select("doc", "position", F.col("x.t").alias("token"), F.col("x.l").alias("label"), F.when(~F.col("fits"), "tokens and labels differ in number").alias("error"))


def pending(rows: DataFrame, done: DataFrame, key: str = "id") -> DataFrame:
    """Rows that an earlier run hasn't finished."""
    return rows.join(done.select(key), key, "left_anti")


def run_pending(rows: DataFrame, path: str, evaluate: Callable, key: str = "id", column: str = "input", parts: int = 1) -> DataFrame:
    """Evaluate the rows that no earlier run has finished, append them to ``path`` and return all results: ``key``, value, error.

    What ``evaluate`` of a row's ``column`` raises is kept as that row's error, with a null value; it doesn't end the run. Rows go in
    ``parts`` slices, each committed whole, so a run that is broken off goes on behind the last. Of repeated keys the smallest input counts.
    """
    spark = rows.sparkSession
    kind = StructType([StructField(key, rows.schema[key].dataType), StructField("value", DoubleType()), StructField("error", StringType())])
    spark.createDataFrame([], kind).write.mode("append").parquet(path)
    todo = pending(rows.groupBy(key).agg(F.min(column).alias(column)), spark.read.schema(kind).parquet(path), key)

    def one(value) -> tuple[float | None, str | None]:
        try:
            return float(evaluate(value)), None
        except Exception as e:  # a row's failure is its result
            return None, str(e)

    def run(batches):
        for pdf in batches:
            value, error = zip(*map(one, pdf[column]), strict=True) if len(pdf) else ((), ())
            yield pd.DataFrame({key: pdf[key], "value": pd.Series(value, index=pdf.index, dtype="float64"), "error": pd.Series(error, index=pdf.index, dtype="object")})

    for part in range(parts):
        todo.filter(F.pmod(F.xxhash64(key), F.lit(parts)) == part).mapInPandas(run, kind).write.mode("append").parquet(path)
    return spark.read.schema(kind).parquet(path)


def append_history(summary: DataFrame, path: str) -> None:
    """Add summaries (eval, ts, n_done, n_total, and more) to the history, with whether they are complete."""
    summary.withColumn("complete", F.col("n_done") == F.col("n_total")).write.mode("append").partitionBy("eval").parquet(path)


def latest_history(spark: SparkSession, path: str) -> DataFrame:
    """The newest summary of each evaluation."""
    rows = spark.read.parquet(path)
    rest = [c for c in rows.columns if c != "eval"]
    return rows.groupBy("eval").agg(F.max_by(F.struct(*rest), "ts").alias("s")).select("eval", "s.*")


def publish(rows: DataFrame, path: str, text_cols: list[str], redact) -> None:
    """Overwrite ``path`` with JSON lines whose texts have been through ``redact``."""
    rows.withColumns({c: redact(F.col(c)) for c in text_cols}).write.mode("overwrite").json(path)
