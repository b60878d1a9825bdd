"""Language identification by compression against one raw dictionary for each language."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.sample import bounded_sample
from quarry.llm.worker import bounded_batches, give_back, state

UNKNOWN = "und"
_LETTER = regex.compile(r"\p{L}").search
#: Bytes that are compressed at a time; a dictionary saves about the same on each block, so margins don't fall with the length.
BLOCK_BYTES = 1 << 15


def learn_dictionaries(
    train: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", rows_per_lang: int = 100, row_bytes: int = 2048, most_langs: int = 256,
) -> dict[str, bytes]:
    """A raw-content dictionary for each language: whole texts of a sample of its labelled rows, end to end.

    The sample is at most ``rows_per_lang`` rows of a language, drawn by a hash among those of at most ``row_bytes`` bytes; a
    language that has none of these is learned from the head of its shortest text. So a dictionary has at most ``rows_per_lang * row_bytes``
    characters, and there are at most ``most_langs`` of them, those of the commonest languages: what reaches the driver is bounded
    however long texts are and whatever a dirty column holds. Rows without a language or with a blank text aren't used.
    """
    rows = train.filter(F.col(lang_col).isNotNull() & (F.length(F.trim(text_col)) > 0)).select(
        F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("body"), F.col(id_col).cast("string").alias("row_id")
    )
    draw = F.xxhash64("row_id", "body", F.lit(17))
    short = F.octet_length("body") <= row_bytes
    picked = bounded_sample(rows.filter(short), rows_per_lang, draw, "lang", most_langs).collect()
    parts: dict[str, list] = {}
    for r in sorted(picked, key=lambda r: (r.lang, r.row_id or "", r.body)):
        parts.setdefault(r.lang, []).append(r.body.lower().encode())
    other = rows.filter(~short).filter(~F.col("lang").isin(list(parts)))
    head = F.min_by(F.substring("body", 1, rows_per_lang * row_bytes), F.struct(F.octet_length("body"), draw)).alias("body")
    for r in other.groupBy("lang").agg(F.count("*").alias("n"), head).orderBy(F.desc("n"), "lang").limit(max(0, most_langs - len(parts))).collect():
        parts[r.lang] = [r.body.lower().encode()]
    return {lang: b"\n".join(p) for lang, p in sorted(parts.items())}


class SizeByLanguage:
    """Sizes of a text with each dictionary.

    A long text is compressed in equal blocks of at most BLOCK_BYTES, each with the fresh dictionary, and its
    size is their sum: every part of it counts, not only the head that is still near the dictionary.
    """

    def __init__(self, dictionaries: dict[str, bytes], level: int):
        self.langs = list(dictionaries)
        self.compress = [_compressor(content, level) for content in dictionaries.values()]

    def __call__(self, text: str | None) -> tuple[str, float]:
        """The language of the smallest encoding and the share of the next smallest that it saves."""
        if not self.langs or not text or not _LETTER(text):
            return UNKNOWN, 0.0
        data = text.lower().encode("utf-8", "ignore")
        parts = -(-len(data) // BLOCK_BYTES)
        edges = [len(data) * k // parts for k in range(parts + 1)]
        blocks = [data[a:b] for a, b in zip(edges[:-1], edges[1:], strict=True)]
        best, second = sorted((sum(len(c(b)) for b in blocks), k) for k, c in enumerate(self.compress))[:2] if len(self.langs) > 1 else ((0, 0), (1, 0))
        return self.langs[best[1]], (second[0] - best[0]) / second[0]


def _compressor(content: bytes, level: int):
    import zstandard as z

    d = z.ZstdCompressionDict(content, dict_type=z.DICT_TYPE_RAWCONTENT)
    d.precompute_compress(level=level)
    return z.ZstdCompressor(level=level, dict_data=d, write_checksum=False, write_content_size=False, write_dict_id=False).compress


def identify_language(
    docs: DataFrame, dictionaries: dict[str, bytes], id_col: str = "doc_id", text_col: str = "text", min_margin: float = 0.001, level: int = 9, keep: bool = False,
) -> DataFrame:
    """The language whose dictionary compresses the whole text best, summed over blocks of bounded size.

    The dictionaries (``learn_dictionaries`` bounds them) are broadcast; rows stay in their partitions, and only the text goes to Python.
    Columns: ``id_col`` (with ``keep`` all columns of ``docs`` instead), lang_pred string, margin double
    (what the best encoding saves of the second best), score double (margin / (margin + 0.01)),
    rejected boolean (no letter, or a margin below ``min_margin``).

    A text that is null or has no letter (Unicode category L), or any text if nothing was learned, is ``und`` with score 0
    and rejected. Equal sizes go to the language that sorts first and have margin 0. With ``keep``,
    columns of ``docs`` that bear the names of results give way to them. Repeated rows each give a
    row; an empty table none.
    """
    bounded_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast((dictionaries, level))
    key = uuid.uuid4().hex
    names = ("lang_pred", "margin", "score", "rejected")
    kept = [c for c in docs.columns if keep and c not in names] or [id_col]

    def identify(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        sizes = state(key, lambda: SizeByLanguage(*shared.value))
        try:
            for texts in batches:
                found = [sizes(x.as_py()) for x in texts]
                yield pa.StructArray.from_arrays([pa.array([x for x, _ in found], pa.string()), pa.array([m for _, m in found], pa.float64())], ["lang", "margin"])
        finally:
            give_back()

    # not deterministic to Spark, so that a filter on the result doesn't run it a second time
    ask = F.arrow_udf(identify, "lang string, margin double").asNondeterministic()
    out = docs.select(*(F.col(f"`{c}`").alias(f"c{k}") for k, c in enumerate(kept)), ask(F.col(f"`{text_col}`").cast("string")).alias("found"))
    return out.select(
        *(F.col(f"c{k}").alias(c) for k, c in enumerate(kept)), F.col("found.lang").alias("lang_pred"), F.col("found.margin").alias("margin"),
        (F.col("found.margin") / (F.col("found.margin") + 0.01)).alias("score"),
        ((F.col("found.lang") == UNKNOWN) | (F.col("found.margin") < min_margin)).alias("rejected"),
    )
