"""A training-data pipeline: each stage works on all that the one before it kept.

``run(spark, sf_dir)`` applies STAGES to ``documents``; each result is written as Parquet in the
shared folder and read again, so a stage never recomputes another and survives lost executors.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm.bpe import bpe_encode
from quarry.llm.decontaminate import containment_matches
from quarry.llm.langid import identify_language, learn_dictionaries
from quarry.llm.minhash import near_duplicates
from quarry.llm.suffix_dedup import remove_repeats
from quarry.storage import materialise, scratch

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: Bytes from which a repeated string is cut out: most runs of over 50 words are longer (README).
REPEAT_BYTES = 240


def _keyed(docs: DataFrame) -> DataFrame:
    """``docs`` with a ``_key``: the id, or for rows without one a number from 2 ** 62 on, behind all ids. Such rows get theirs in a written copy, so
    that it stays the same whenever it is read."""
    rows = docs.select(*COLUMNS)
    if not rows.filter("doc_id is null").limit(1).count():
        return rows.withColumn("_key", F.col("doc_id").cast("long"))
    return materialise(rows.withColumn("_key", F.coalesce(F.col("doc_id").cast("long"), F.lit(2**62) + F.monotonically_increasing_id())), "keyed")


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is clear; a document without letters, or as near to two languages, goes."""
    found = identify_language(docs.select(*COLUMNS), learn_dictionaries(docs), keep=True)
    return found.filter(~F.col("rejected")).select(*COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near duplicates (five-word shingles, 0.8): the one with the smallest id.

    Documents without words are in no component and stay; of rows that repeat an id all or none stay. A row without an id goes if another document is like it.
    """
    keyed = _keyed(docs)
    gone = near_duplicates(keyed, "_key").filter(~F.col("kept")).select("_key").distinct()
    return keyed.join(gone, "_key", "left_anti").select(*COLUMNS)


def suffix_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without strings of REPEAT_BYTES bytes that also start elsewhere; a character that loses a byte goes,
    as do replacement characters of a text that is cut.

    A text of which nothing remains goes; n_chars follows the text.
    """
    out = remove_repeats(docs.select(*COLUMNS), length=REPEAT_BYTES, keep_columns=True)
    text = F.col("kept").cast("string")
    cut = F.when(F.col("n_removed") > 0, F.replace(F.make_valid_utf8(text), F.lit("\ufffd"), F.lit(""))).otherwise(text)
    rest = out.withColumn("text", cut).filter((F.col("n_removed") == 0) | (F.length(F.trim("text")) > 0))
    return rest.withColumn("n_chars", F.when(F.col("n_removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*COLUMNS)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item to 0.8 of its five-word shingles."""
    keyed = _keyed(docs)
    matches = containment_matches(keyed, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), "_key")
    return keyed.join(matches.select("_key").distinct(), "_key", "left_anti").select(*COLUMNS)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of what is left, and whether they decode to the text again."""
    out = bpe_encode(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), decode=True)
    digests = out.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", F.sha2("decoded", 256).alias("decoded_sha256"))
    return digests


STAGES = [("language_id", language_id), ("near_dedup", near_dedup), ("suffix_dedup", suffix_dedup), ("decontaminate", decontaminate), ("encode", encode)]

#: Compression, repeated byte strings and the encoding have no SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        with scratch(spark):  # what a stage leaves in the shared folder goes once its result is written
            docs = materialise(stage(spark, docs, sf_dir), name, keep=True)
    return docs
