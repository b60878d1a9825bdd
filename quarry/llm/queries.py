"""The registered queries of this subpackage, one for each operator, and their SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm.alignment import align_tokenizers
from quarry.llm.ann import nearest_vectors
from quarry.llm.bpe import bpe_encode
from quarry.llm.chat import perspectives_sql, rotate_perspectives
from quarry.llm.decontaminate import contamination_sql, flag_contaminated
from quarry.llm.langid import identify_language, learn_dictionaries
from quarry.llm.minhash import near_duplicates
from quarry.llm.ngram_join import components_sql, ngram_components
from quarry.llm.prefix_trie import prefix_trie, trie_sql
from quarry.llm.quality import learn_quality, score_quality
from quarry.llm.suffix_dedup import remove_repeats
from quarry.llm.token_counts import count_tokens
from quarry.llm.warc import archive_round_trip


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op2_nearest_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest_vectors(table(spark, sf_dir, "embeddings"))


def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    encoded = bpe_encode(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), decode=True)
    return encoded.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ",").cast("binary"), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = remove_repeats(table(spark, sf_dir, "documents"), length=400)
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2(F.coalesce("kept", F.lit(b"")), 256).alias("kept_sha256"))


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flag_contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def held_out() -> Column:
    """Whether a row is held out; one without an id isn't."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = learn_quality(docs.filter(~held_out()), table(spark, sf_dir, "labels"))
    return score_quality(docs, model).select("doc_id", held_out().alias("held_out"), "score", "predicted")


def op7_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), width=3, percent=85)


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archive_round_trip(table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = identify_language(docs, learn_dictionaries(docs.filter(~held_out())))
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "margin", "rejected")


def op10_perspectives(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = rotate_perspectives(table(spark, sf_dir, "conversations"))
    spans = F.transform(F.arrays_zip("mask_starts", "mask_ends"), lambda x: F.concat(x["mask_starts"].cast("string"), F.lit("-"), x["mask_ends"].cast("string")))
    return out.select("conv_id", "speaker", "piece", "n_turns", "n_own", "n_masked", "rendered", F.array_join(spans, ",").alias("mask"))


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie(table(spark, sf_dir, "conversations"))


def op12_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align_tokenizers(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))


def op13_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_components(table(spark, sf_dir, "documents"), width=4, percent=85)


OP8_SQL = """
    WITH p AS (SELECT page_id, coalesce(html, '') AS html, CAST(octet_length(encode(coalesce(html, ''))) AS BIGINT) AS payload_bytes FROM pages),
    h AS (SELECT *, max(page_id) OVER (PARTITION BY html) AS top FROM p)
    SELECT page_id, payload_bytes, sha1(html) AS payload_digest,
           CASE WHEN payload_bytes >= 1000 AND page_id <> top THEN 'revisit' ELSE 'response' END AS record_type,
           CASE WHEN payload_bytes >= 1000 AND page_id <> top THEN top END AS refers_to
    FROM h
"""

#: 3-word shingles by byte-level words, all links from an inverted index, components by recursion.
OP7_SQL = r"""
    WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
    s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i + 2], ' ')) END) AS s FROM w),
    n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
    o AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY 1, 2),
    l AS (SELECT a, b FROM o JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)),
    r AS (SELECT doc_id AS id, doc_id AS seen FROM w UNION SELECT r.id, l.b FROM r JOIN l ON l.a = r.seen),
    k AS (SELECT id, min(seen) AS component_id FROM r GROUP BY id)
    SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, k.component_id, w.doc_id = k.component_id AS kept FROM w JOIN k ON k.id = w.doc_id LEFT JOIN n ON n.doc_id = w.doc_id
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_token_counts": op1_token_counts, "op2_nearest_vectors": op2_nearest_vectors, "op3_byte_bpe": op3_byte_bpe, "op4_suffix_dedup": op4_suffix_dedup, "op5_decontamination": op5_decontamination, "op6_quality": op6_quality,
        "op7_near_dedup": op7_near_dedup, "op8_warc": op8_warc, "op9_language_id": op9_language_id, "op10_perspectives": op10_perspectives, "op11_prefix_trie": op11_prefix_trie, "op12_alignment": op12_alignment, "op13_ngram_join": op13_ngram_join,
    }


def oracle_sql() -> dict[str, str]:
    return {"op5_decontamination": contamination_sql(), "op7_near_dedup": OP7_SQL, "op8_warc": OP8_SQL, "op10_perspectives": perspectives_sql(), "op11_prefix_trie": trie_sql(), "op13_ngram_join": components_sql()}
