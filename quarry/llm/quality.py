"""Quality scores by similarity-weighted votes of labelled neighbours in a latent space."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.sample import bounded_sample
from quarry.llm.words import MULT, joined, mix, slices, word_hashes
from quarry.llm.worker import bounded_batches, state, tidy
from quarry.storage import materialise

TRIGRAMS, SHAPES, REPEATS = 2048, 512, 4
TERMS = TRIGRAMS + SHAPES + REPEATS


def _shape_table() -> np.ndarray:
    """Letters fall into upper, lower and beyond ASCII, digits into one class; other bytes stand for themselves."""
    table = np.arange(256)
    table[65:91], table[97:123], table[48:58], table[128:] = 1, 2, 3, 4
    return table.astype(np.uint64)


_SHAPE = _shape_table()


def term_counts(texts: list[bytes]) -> np.ndarray:
    """Counts by text of hashed byte trigrams, hashed trigrams of character shapes, and repeated words."""
    buffer, starts = joined(texts)
    n = len(texts)
    doc = np.repeat(np.arange(n), np.diff(starts))[:-2] if len(buffer) > 2 else np.zeros(0, np.int64)
    out = np.zeros((n, TERMS), np.float32)
    if len(buffer) > 2:
        inside = doc == np.repeat(np.arange(n), np.diff(starts))[2:]
        for codes, size, base in ((buffer.astype(np.uint64), TRIGRAMS, 0), (_SHAPE[buffer], SHAPES, TRIGRAMS)):
            with np.errstate(over="ignore"):
                gram = (codes[:-2] << np.uint64(16) | codes[1:-1] << np.uint64(8) | codes[2:]) * MULT >> np.uint64(64 - (size.bit_length() - 1))
            flat = np.bincount(doc[inside] * size + gram[inside].astype(np.int64), minlength=n * size)
            out[:, base : base + size] = flat.reshape(n, size)
    words, of = word_hashes(buffer, starts)
    for k in range(1, 3):  # a word that stands one or two words before
        same = (words[k:] == words[:-k]) & (of[k:] == of[:-k])
        out[:, TRIGRAMS + SHAPES + k - 1] = 8 * np.bincount(of[k:][same], minlength=n)
    order = np.argsort(mix(words + of.astype(np.uint64) * MULT), kind="stable")
    again = (words[order][1:] == words[order][:-1]) & (of[order][1:] == of[order][:-1])
    out[:, TRIGRAMS + SHAPES + 2] = np.bincount(of[order][1:][again], minlength=n)
    out[:, TRIGRAMS + SHAPES + 3] = np.bincount(of, minlength=n)
    return out


@dataclass
class NeighbourModel:
    idf: np.ndarray
    axes: np.ndarray
    vectors: np.ndarray
    labels: np.ndarray
    k: int = 15
    sharpness: float = 6.0

    def project(self, counts: np.ndarray) -> np.ndarray:
        x = np.log1p(counts) * self.idf
        x = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
        z = x @ self.axes
        return z / np.maximum(np.linalg.norm(z, axis=1, keepdims=True), 1e-12)

    def score(self, counts: np.ndarray) -> np.ndarray:
        """Share of label 1 in the votes of the k most similar labelled rows, from all cosines; of equal ones the first in the sample count."""
        if not len(self.labels):
            return np.where(counts.any(axis=1), 0.5, 0.0)
        cosines = self.project(counts) @ self.vectors.T
        k = min(self.k, len(self.labels))
        least = np.partition(cosines, -k, axis=1)[:, -k, None]
        above, level = cosines > least, cosines == least
        taken = above | (level & (np.cumsum(level, axis=1, dtype=np.int32) <= k - above.sum(axis=1, keepdims=True)))
        near = np.nonzero(taken)[1].reshape(-1, k)
        weight = np.exp(self.sharpness * (np.take_along_axis(cosines, near, 1).astype(np.float64) - 1))
        votes = (weight * self.labels[near]).sum(axis=1) / weight.sum(axis=1)
        return np.where(counts.any(axis=1), votes, 0.0)


def _encoded(column: pa.Array) -> list[bytes]:
    return [b"" if t is None else t for t in column.to_pylist()]


def learn_quality(
    train: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality",
    rows_per_label: int = 1500, axes: int = 64, k: int = 15,
) -> NeighbourModel:
    """Latent vectors of at most ``rows_per_label`` labelled rows for each label, those with the smallest
    hashes of their ids (the bound of the sample, and so of what is collected and broadcast).

    Both labels weigh the same, whatever their shares, so a score is not the base rate. A label that is repeated for an id counts
    once; of rows that repeat an id the smallest text is learned from.
    """
    bounded_batches(train.sparkSession)
    known = labels.filter(F.col(label_col).isin(0, 1)).select(F.col(id_col).alias("row_id"), F.col(label_col).cast("int").alias("label")).distinct()
    rows = train.select(F.col(id_col).alias("row_id"), F.col(text_col).cast("binary").alias("body"))
    usable = known.join(rows.select("row_id"), "row_id", "left_semi")
    draw = F.xxhash64(F.col("row_id").cast("string"), F.lit(23))
    picked = bounded_sample(usable, rows_per_label, draw, "label").withColumn("draw", draw)
    picked = materialise(picked, "picked")
    empty = NeighbourModel(np.ones(TERMS, np.float32), np.zeros((TERMS, 1), np.float32), np.zeros((0, 1), np.float32), np.zeros(0), k)
    if not picked.limit(1).count():
        return empty

    def featurise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, label, draw = _encoded(batch.column(2)), batch.column(0), batch.column(1)
            for a, b in slices(texts):
                data = [x.astype(np.float32).tobytes() for x in term_counts(texts[a:b])]
                yield pa.RecordBatch.from_arrays([label.slice(a, b - a), draw.slice(a, b - a), pa.array(data, pa.binary())], ["label", "draw", "counts"])

    # the picked rows are at most two times rows_per_label
    texts = rows.join(F.broadcast(picked), "row_id").groupBy("row_id", "label", "draw").agg(F.min("body").alias("body"))
    sample = texts.select("label", "draw", "body").mapInArrow(tidy(featurise), "label int, draw long, counts binary").collect()
    sample.sort(key=lambda r: (r.draw, r.label, r.counts))
    x = np.stack([np.frombuffer(r.counts, np.float32) for r in sample])
    idf = np.log((1 + len(x)) / (1 + (x > 0).sum(axis=0))).astype(np.float32) + 0.1
    weighted = np.log1p(x) * idf
    weighted /= np.maximum(np.linalg.norm(weighted, axis=1, keepdims=True), 1e-12)
    _, vectors = np.linalg.eigh((weighted.T @ weighted).astype(np.float64))
    model = NeighbourModel(idf, np.ascontiguousarray(vectors[:, ::-1][:, :axes], np.float32), np.zeros((0, 1), np.float32), np.array([r.label for r in sample], np.float64), k)
    model.vectors = model.project(x).astype(np.float32)
    return model


def score_quality(docs: DataFrame, model: NeighbourModel, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.7) -> DataFrame:
    """Score of every whole text: cosine products with all labelled vectors, in blocks of documents.

    The model (a few MB by the bounds of ``learn_quality``) is broadcast; rows stay in their
    partitions. Columns: ``id_col``, score double in [0, 1], predicted int (score >= ``threshold``).
    Null and empty texts score 0; without any labelled row every other text scores 0.5. Equal
    cosines are told apart by the order of the sample. Repeated rows each give a row; an empty table none.
    """
    bounded_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    key = uuid.uuid4().hex

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = state(key, lambda: shared.value)
        for batch in batches:
            texts, ids = _encoded(batch.column(1)), batch.column(0)
            for a, b in slices(texts, 1 << 18):
                for c in range(a, b, 256):
                    d = min(b, c + 256)
                    yield pa.RecordBatch.from_arrays([ids.slice(c, d - c), pa.array(model.score(term_counts(texts[c:d])), pa.float64())], ["row_id", "score"])

    kind = docs.schema[id_col].dataType.simpleString()
    out = docs.select(F.col(id_col).alias("row_id"), F.col(text_col).cast("binary").alias("body")).mapInArrow(tidy(score, key), f"row_id {kind}, score double")
    return out.select(F.col("row_id").alias(id_col), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
