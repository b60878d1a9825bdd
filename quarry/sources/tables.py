"""The engine's tables, derived from the driver's: each frame beside the SQL that derives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: Provider ids in their fixed order, and the reliability tier that we give each.
PROVIDERS = ("pubmed", "europe_pmc", "clinicaltrials", "openfda", "dailymed", "ema", "who_gho", "biorxiv", "chembl", "open_targets", "rxnav", "wikipedia")
TIERS = (1, 1, 1, 1, 1, 1, 1, 2, 2, 2, 2, 3)
#: Rows of a pool: candidates of one topic, so pools stay small however many documents there are.
POOL = 90

_LISTED = ", ".join(f"'{p}'" for p in PROVIDERS)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One evidence record for each document; ``arrival`` is the total order."""
    return table(spark, sf_dir, "documents").selectExpr(
        "doc_id as ev_id", r"substring(substring_index(text, '\n', 1), 1, 160) as title",
        """case doc_id % 3 when 0 then concat('https://doi.org/10.1000/J.', doc_id div 6, ').') when 1 then concat('https://pubmed.ncbi.nlm.nih.gov/', 1000 + doc_id, '/')
           else concat('https://www.example.org/A/', doc_id, '/') end as url""",
        "substring(text, 1, 300) as snippet", "text as content", f"element_at(array({_LISTED}), 1 + cast(substring(source, 4) as int) % 12) as source_type",
        f"element_at(array({', '.join(map(str, TIERS))}), 1 + cast(substring(source, 4) as int) % 12) as reliability_tier",
        "case when doc_id % 10 = 0 then '' else concat(1990 + doc_id % 36, '-06-15') end as publication_date", "(doc_id * 37) % 1501 as citation_count", "lang as language",
        """case doc_id % 7 when 0 then array('Journal Article', 'Meta-Analysis', 'Review') when 1 then array('Randomized Controlled Trial') when 2 then array('Case Reports')
           when 3 then array('Letter') else cast(array() as array<string>) end as publication_types""",
        "doc_id as arrival", f"doc_id div {POOL} as topic_id",
    )


EVIDENCE = f"""evidence AS (SELECT doc_id AS ev_id, substr(split_part(text, chr(10), 1), 1, 160) AS title,
    CASE doc_id % 3 WHEN 0 THEN 'https://doi.org/10.1000/J.' || (doc_id // 6) || ').' WHEN 1 THEN 'https://pubmed.ncbi.nlm.nih.gov/' || (1000 + doc_id) || '/' ELSE 'https://www.example.org/A/' || doc_id || '/' END AS url,
    substr(text, 1, 300) AS snippet, text AS content, [{_LISTED}][1 + CAST(substr(source, 4) AS INTEGER) % 12] AS source_type,
    CAST({list(TIERS)}[1 + CAST(substr(source, 4) AS INTEGER) % 12] AS INTEGER) AS reliability_tier,
    CASE WHEN doc_id % 10 = 0 THEN '' ELSE (1990 + doc_id % 36) || '-06-15' END AS publication_date, (doc_id * 37) % 1501 AS citation_count, lang AS language,
    CASE doc_id % 7 WHEN 0 THEN ['Journal Article', 'Meta-Analysis', 'Review'] WHEN 1 THEN ['Randomized Controlled Trial'] WHEN 2 THEN ['Case Reports'] WHEN 3 THEN ['Letter'] ELSE [] END AS publication_types,
    doc_id AS arrival, doc_id // {POOL} AS topic_id FROM documents)"""
