"""Token counts by a two-tier lookup that never shuffles pre-tokens."""

from __future__ import annotations

import os
import uuid
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.pretokens import by_offsets, splitter
from quarry.llm.worker import bounded_batches, state, tidy


class PieceCounts(dict):
    """Token counts by piece. The first tier is filled from the broadcast table; what is missing there
    is encoded once per worker and kept, up to ``room`` further pieces, after which the second
    tier starts anew from the first."""

    def __init__(self, tokenizer, frequent: dict[str, int], room: int):
        super().__init__(frequent)
        self.tokenizer, self.frequent, self.limit = tokenizer, frequent, len(frequent) + room

    def __missing__(self, piece: str) -> int:
        if len(self) >= self.limit:
            self.clear()
            self.update(self.frequent)
        n = self[piece] = len(self.tokenizer.encode(piece, add_special_tokens=False).ids)
        return n


class TextCounter:
    def __init__(self, serialised: str, frequent: dict[str, int], room: int):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import regex
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(serialised)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.pieces, self.odd = splitter()
        added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.special = regex.compile("|".join(regex.escape(x) for x in sorted(added, key=len, reverse=True))) if added else None
        self.counts = PieceCounts(self.tokenizer, frequent, room)

    def __call__(self, text: str | None) -> int:
        if not text:
            return 0
        if self.special is None or not self.special.search(text):
            return self._plain(text)
        return len(self.special.findall(text)) + sum(map(self._plain, self.special.split(text)))

    def _plain(self, text: str) -> int:
        """Only the pieces of a text with a code point that isn't assigned here come from the library, which may know it as a letter."""
        return sum(map(self.counts.__getitem__, by_offsets(text, self.tokenizer.pre_tokenizer) if self.odd(text) else self.pieces(text)))


def frequent_pieces(docs: DataFrame, serialised: str, text_col: str, table_size: int, sample_rows: int, row_bytes: int = 1 << 14) -> dict[str, int]:
    """Token counts of the commonest pieces of at most ``sample_rows`` rows of at most ``row_bytes`` bytes.

    The sample only decides which pieces start in the first tier; no count depends on it. Spark reads one partition for it, and
    more only while rows are lacking; nothing is shuffled.
    """
    body = F.col(f"`{text_col}`").cast("string")
    rows = docs.select(body.alias("body")).filter(F.octet_length("body").between(1, row_bytes)).take(sample_rows)
    counter, seen = TextCounter(serialised, {}, 1 << 30), Counter()
    for r in rows:
        seen.update(counter.pieces(r.body))
    return {piece: counter.counts[piece] for piece, _ in seen.most_common(table_size)}


def count_tokens(
    docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text",
    token_limit: int = 512, table_size: int = 1 << 16, sample_rows: int = 1000, cache_room: int = 500_000,
) -> DataFrame:
    """Tokens of every whole text, as the ``tokenizers`` library counts them.

    The vocabulary file (a few MB, read on the driver) and a table of at most ``table_size`` frequent
    pieces are broadcast; every other piece is encoded by the library in the worker that meets it.
    Rows stay in their partitions: there is no shuffle. Columns: ``id_col``, n_bytes, n_tokens, over_limit.

    Special strings inside a text count as the library's default has it (one token). A null text
    counts as empty, with 0 bytes and 0 tokens; an empty table gives no rows; repeated rows each
    give a row; a null id stays null; other columns are ignored, whatever their names.
    """
    with open(tokenizer_path, encoding="utf-8") as f:
        serialised = f.read()
    spark = docs.sparkSession
    bounded_batches(spark)
    shared = spark.sparkContext.broadcast((serialised, frequent_pieces(docs, serialised, text_col, table_size, sample_rows), cache_room))
    key = uuid.uuid4().hex

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = state(key, lambda: TextCounter(*shared.value))
        for batch in batches:
            texts = batch.column(1)
            n = pa.array([counter(x.as_py()) for x in texts], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), n], ["row_id", "n_bytes", "n_tokens"])

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(
        F.col(id_col).alias("row_id"), F.col(f"`{text_col}`").cast("string").alias("body"),
        F.coalesce(F.octet_length(F.col(f"`{text_col}`").cast("string")), F.lit(0)).cast("long").alias("n_bytes"),
    )
    counted = rows.mapInArrow(tidy(count, key), f"row_id {kind}, n_bytes long, n_tokens long")
    return counted.select(F.col("row_id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > token_limit).alias("over_limit"))
