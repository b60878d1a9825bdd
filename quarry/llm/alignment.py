"""Alignment of two tokenizers' tokens over the bytes of each text, on Arrow columns."""

from __future__ import annotations

import hashlib
import json
import os
import re
import uuid
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.pretokens import by_offsets, splitter
from quarry.llm.worker import bounded_batches, state, tidy
from quarry.storage import broadcast_if_small, materialise

#: Bytes of text that are aligned at a time; a longer text goes in segments that no token crosses.
SLICE = 1 << 19
#: Bits of a linked pair's key that hold the second tokenizer's id.
ID_BITS = 32
_MARK = "▁"
_WORD = re.compile(" +[^ ]*").findall
#: Where a long text may be cut: both tokenizers end a token before a blank that stands between such characters.
_CUT = re.compile(r"(?<=[a-zA-Z.,]) (?=[a-zA-Z])")


def byte_of_char() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable ones themselves, the rest from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class PieceTokens(dict):
    """Ids of the tokens of pieces, encoded once in a worker and kept, as one Arrow list column."""

    def __init__(self, encode: Callable[[list[str]], list[list[int]]], room: int):
        super().__init__()
        self.encode, self.room, self.waiting = encode, room, []
        self.flat, self.offsets = np.zeros(1 << 16, np.int32), np.zeros(1, np.int32)

    def __missing__(self, piece: str) -> int:
        self.waiting.append(piece)
        k = self[piece] = len(self)
        return k

    def _learn(self) -> None:
        """Add the tokens of the pieces that were new."""
        found = self.encode(self.waiting)
        ends = np.cumsum([len(x) for x in found], dtype=np.int32) + self.offsets[-1]
        if ends[-1] > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros(max(len(self.flat), ends[-1]), np.int32)])
        self.flat[self.offsets[-1] : ends[-1]] = np.fromiter(chain.from_iterable(found), np.int32, ends[-1] - self.offsets[-1])
        self.offsets = np.concatenate([self.offsets, ends])
        self.waiting = []

    def tokens(self, texts: list[list[str]]) -> tuple[pa.Array, np.ndarray]:
        """The ids of all pieces of all texts, flattened, and the text that each is in."""
        if len(self) > self.room:
            self.clear()
            self.offsets = self.offsets[:1]
        picked = np.array(list(map(self.__getitem__, chain.from_iterable(texts))), np.int32)
        if self.waiting:
            self._learn()
        column = pa.ListArray.from_arrays(pa.array(self.offsets), pa.array(self.flat[: self.offsets[-1]]))
        lists = column.take(pa.array(picked))
        text = np.repeat(np.arange(len(texts), dtype=np.int32), [len(x) for x in texts])
        return pc.list_flatten(lists), text[pc.list_parent_indices(lists).to_numpy()]


class Aligner:
    """Both tokenizers, what their entries stand for, and the pieces that this worker has met."""

    def __init__(self, serialised: str, model: bytes, room: int):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        first = Tokenizer.from_str(serialised)
        first.no_truncation()
        first.no_padding()
        first.encode_special_tokens = True
        self.first, (self.split, self.odd) = first, splitter()
        self.second = sentencepiece.SentencePieceProcessor(model_proto=model)
        byte = byte_of_char()
        names = [first.id_to_token(k) or "" for k in range(first.get_vocab_size())]
        special = {t.content for t in first.get_added_tokens_decoder().values()}
        marks = [self.second.id_to_piece(k) for k in range(self.second.get_piece_size())]
        entries = [b"" if n in special else bytes(byte[c] for c in n) for n in names], [
            bytes([int(m[3:5], 16)]) if self.second.is_byte(k) else m.replace(_MARK, " ").encode() for k, m in enumerate(marks)
        ]
        self.bytes = [pa.array(e, pa.binary()) for e in entries]
        self.sizes = [np.array([len(x) for x in e], np.int64) for e in entries]
        # each id as it is written within a group and at a group's end
        self.written = pa.array([f"{k}{s}" for n, end in ((len(names), "|"), (len(marks), ";")) for k in range(n) for s in (",", end)], pa.string())
        # no entry has a mark behind another character: then no merge crosses the start of a run of blanks
        self.by_word = not any(_MARK in m.lstrip(_MARK) for m in marks)
        blank = [self.second.piece_to_id(_MARK)]
        self.a = PieceTokens(lambda new: [x.ids for x in first.encode_batch_fast(new, add_special_tokens=False)], room)
        self.b = PieceTokens(lambda new: [x or blank for x in self.second.encode([p[1:] for p in new], num_threads=1)], room)

    def _pieces(self, text: str) -> list[str]:
        return list(by_offsets(text, self.first.pre_tokenizer)) if self.odd(text) else self.split(text)

    def __call__(self, texts: list[str]) -> Alignment:
        """The alignment of texts that begin with a blank."""
        body = [t.encode() for t in texts]
        n = np.array([len(b) for b in body], np.int64)
        sides = [self.a.tokens([self._pieces(t) for t in texts]), self.b.tokens([_WORD(t) if self.by_word else [t] for t in texts])]
        good = np.ones(len(texts), bool)
        for k, (ids, text) in enumerate(sides):
            total = np.bincount(text, self.sizes[k][ids.to_numpy()], len(texts)).astype(np.int64)
            good &= total == n
            data = np.frombuffer(self.bytes[k].take(ids).buffers()[2] or b"", np.uint8)
            if not good.all() or not np.array_equal(data[: total.sum()], np.frombuffer(b"".join(body), np.uint8)):
                at = np.concatenate([[0], np.cumsum(total)])
                good &= [data[at[j] : at[j + 1]].tobytes() == b for j, b in enumerate(body)]
        return Alignment(self, [(ids, text) if good.all() else (ids.filter(pa.array(good[text])), text[good[text]]) for ids, text in sides], good)


class Alignment:
    """Tokens of both tokenizers over some texts, and the links where they end together."""

    def __init__(self, of: Aligner, sides: list[tuple[pa.Array, np.ndarray]], good: np.ndarray):
        self.of, self.good, self.n = of, good, len(good)
        self.ids, self.texts = [ids.to_numpy() for ids, _ in sides], [text for _, text in sides]
        ends = [self._ends(of.sizes[k][self.ids[k]], self.texts[k]) for k in (0, 1)]
        # a document-end key: the text above, the offset below
        left, right = (pa.table({"key": self.texts[k].astype(np.int64) << 40 | ends[k], f"at{k}": np.arange(len(self.ids[k]))}) for k in (0, 1))
        met = left.join(right, "key", join_type="inner", use_threads=False)
        self.links = [np.sort(met[f"at{k}"].to_numpy()) for k in (0, 1)]

    @staticmethod
    def _ends(sizes: np.ndarray, text: np.ndarray) -> np.ndarray:
        """Byte offsets at which tokens end, counted from the start of their text."""
        total = pc.cumulative_sum(pa.array(sizes)).to_numpy()
        if not len(text):
            return total
        first = np.flatnonzero(np.concatenate([[True], text[1:] != text[:-1]]))
        return total - np.repeat(total[first] - sizes[first], np.diff(np.append(first, len(text))))

    def counts(self) -> list[np.ndarray]:
        """Tokens of each side and links, by text."""
        return [np.bincount(t, minlength=self.n) for t in (*self.texts, self.texts[0][self.links[0]])]

    def pairs(self) -> pa.Table:
        """How often a text links each pair of ids: text, pair, times."""
        key = self.ids[0][self.links[0]].astype(np.int64) << ID_BITS | self.ids[1][self.links[1]]
        return pa.table({"text": self.texts[0][self.links[0]], "pair": key}).group_by(["text", "pair"], use_threads=False).aggregate([("pair", "count")])

    def written(self) -> list[memoryview]:
        """The groups of each text, with a semicolon after each."""
        out, place = np.empty(sum(map(len, self.ids)), np.int64), []
        for k in (0, 1):
            last = np.zeros(len(self.ids[k]), np.int64)
            last[self.links[k]] = 1
            group = np.cumsum(last) - last
            # tokens of the other side that are written before: those of earlier groups, and of this one if this side comes second
            before = np.concatenate([[0], self.links[1 - k] + 1])[group + k]
            place.append(np.arange(len(group)) + before)
            out[place[k]] = (self.ids[k] + k * len(self.of.sizes[0])) * 2 + last
        strings = self.of.written.take(pa.array(out))
        _, offsets, data = strings.buffers()
        at = np.frombuffer(offsets, np.int32)[: len(out) + 1] if len(out) else np.zeros(1, np.int32)
        tokens = np.concatenate([[0], np.cumsum(sum(self.counts()[:2]))])
        data = memoryview(data or b"")
        return [data[at[a] : at[b]] for a, b in zip(tokens[:-1], tokens[1:], strict=True)]


def segments(text: str, size: int = SLICE) -> Iterator[str]:
    """The text in segments of about ``size`` characters, each from a blank on, cut where neither tokenizer has a token across."""
    start = 0
    while len(text) - start > size and (cut := _CUT.search(text, start + size)):
        yield text[start : cut.start()]
        start = cut.start()
    yield text[start:]


def _long(aligner: Aligner, text: str) -> tuple[list[int], str, pa.Table]:
    """Counts, digest and pairs of one long text. All is held against the text's bytes before anything counts."""
    none = [0, 0, 0], "", pa.table({"pair": pa.array([], pa.int64()), "times": pa.array([], pa.int64())})
    counts, digest, found, waiting = np.zeros(3, np.int64), hashlib.sha256(), none[2], b""
    for s in segments(text):
        part = aligner([s])
        if not part.good[0]:
            return none
        digest.update(waiting)
        groups = part.written()[0]
        digest.update(groups[:-1])
        waiting = b";"
        counts += np.array(part.counts())[:, 0]
        new = part.pairs().select(["pair", "pair_count"]).rename_columns(["pair", "times"])
        found = pa.concat_tables([found, new]).group_by("pair", use_threads=False).aggregate([("times", "sum")]).rename_columns(["pair", "times"])
    return counts.tolist(), digest.hexdigest(), found


def _ranges(texts: list[str]) -> Iterator[tuple[int, int]]:
    a = total = 0
    for b, t in enumerate(texts):
        if b > a and total + len(t) > SLICE:
            yield a, b
            a, total = b, 0
        total += len(t)
    if texts:
        yield a, len(texts)


def _lists(text: np.ndarray, column: pa.ChunkedArray | pa.Array, n: int) -> pa.ListArray:
    order = np.argsort(text, kind="stable")
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(text[order], np.arange(n + 1)).astype(np.int32)), pa.array(column.to_numpy()[order]))


def _rows(aligner: Aligner, texts: list[str]) -> Iterator[list[pa.Array]]:
    """n_a, n_b, links, digest, pairs and times of texts, in slices."""
    for a, b in _ranges(texts):
        if b == a + 1 and len(texts[a]) > SLICE:
            counts, digest, pairs = _long(aligner, " " + texts[a])
            yield [*(pa.array([c], pa.int64()) for c in counts), pa.array([digest]), pa.array([pairs["pair"].to_pylist()], pa.list_(pa.int64())), pa.array([pairs["times"].to_pylist()], pa.list_(pa.int64()))]
            continue
        there = [k for k in range(a, b) if texts[k]]
        done, at = aligner([" " + texts[k] for k in there]), np.array(there, np.int64) - a
        full = lambda x: np.bincount(at, x, b - a).astype(np.int64)
        digests = [""] * (b - a)
        for k, groups, good in zip(there, done.written(), done.good, strict=True):
            digests[k - a] = hashlib.sha256(groups[:-1]).hexdigest() if good else ""
        pairs = done.pairs()
        of = at[pairs["text"].to_numpy()]
        yield [*(pa.array(full(c)) for c in done.counts()), pa.array(digests), _lists(of, pairs["pair"], b - a), _lists(of, pairs["pair_count"], b - a)]


def align_tokenizers(
    docs: DataFrame, tokenizer_path: str, model_path: str, id_col: str = "doc_id", text_col: str = "text", cache_room: int = 400_000, broadcast_rows: int = 1_000_000,
) -> DataFrame:
    """How the tokens of a byte-level vocabulary (A, a ``tokenizers`` file) and of a sentencepiece model (B) meet in every whole text.

    A encodes a blank and the text, B the text, to which it adds the blank itself; special strings are plain text. Offsets at which tokens of both end cut the
    tokens into groups, and the two tokens that end there are linked. How many links of the whole
    corpus hold a pair of ids is the pair's count. Columns: ``id_col``, n_a, n_b, n_groups, n_links, n_best (links whose count is
    the highest of their B id, ties included), count_sum (counts over the links), all long, and groups_sha256
    (``a1,a2|b1;a3|b2,b3``; '' without tokens).

    Texts are encoded where they lie: pieces by a cache in each worker, then list columns are flattened with their parent indices, byte
    sizes summed by text, the ends joined, and pairs counted by text, all in Arrow tables of at most SLICE bytes of text.
    A longer text goes in segments that begin at a blank between letters; one without such blanks for longer than that is one segment. Results are
    written once; partial counts by text and pair are all that is shuffled. There are no more B ids than the model
    has, so the highest counts are broadcast; the pairs' counts are if they have at most ``broadcast_rows`` rows, and joined by shuffling beyond.

    A text that is null or empty, or whose bytes one of the tokenizers doesn't give back, has no tokens and zeros.
    Every row gives a row: repeated and null ids are kept apart and count as texts of their own. An empty table gives no rows; other columns are ignored.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    with open(tokenizer_path, encoding="utf-8") as f, open(model_path, "rb") as g:
        shared = spark.sparkContext.broadcast((json.dumps(json.load(f)), g.read(), cache_room))
    key = uuid.uuid4().hex
    kind = docs.schema[id_col].dataType.simpleString()
    names = ["row_key", "row_id", "n_a", "n_b", "n_links", "digest", "pairs", "times"]

    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = state(key, lambda: Aligner(*shared.value))
        row = TaskContext.get().partitionId() << 40
        for batch in batches:
            done = 0
            for columns in _rows(aligner, [t or "" for t in batch.column(1).to_pylist()]):
                n = len(columns[0])
                keys = pa.array(np.arange(row, row + n))
                yield pa.RecordBatch.from_arrays([keys, batch.column(0).slice(done, n), *columns], names)
                row, done = row + n, done + n

    rows = docs.select(F.col(f"`{id_col}`").alias("row_id"), F.col(f"`{text_col}`").cast("string").alias("body"))
    schema = f"row_key long, row_id {kind}, n_a long, n_b long, n_links long, digest string, pairs array<long>, times array<long>"
    aligned = materialise(rows.mapInArrow(tidy(align, key), schema), "aligned")

    links = aligned.select("row_key", F.explode(F.arrays_zip("pairs", "times")).alias("x")).select("row_key", F.col("x.pairs").alias("pair"), "x.times")
    counts = materialise(links.groupBy("pair").agg(F.sum("times").alias("n")).withColumn("b", F.col("pair").bitwiseAND((1 << ID_BITS) - 1)), "pair_counts")
    highest = counts.groupBy("b").agg(F.max("n").alias("highest"))
    known = counts.join(F.broadcast(highest), "b").select("pair", "n", (F.col("n") == F.col("highest")).cast("long").alias("best"))
    sums = links.join(broadcast_if_small(known, broadcast_rows, 24), "pair").groupBy("row_key").agg(
        F.sum(F.col("times") * F.col("best")).alias("n_best"), F.sum(F.col("times") * F.col("n")).alias("count_sum")
    )
    out = aligned.drop("pairs", "times").join(sums, "row_key", "left")
    return out.select(
        F.col("row_id").alias(id_col), "n_a", "n_b", F.col("n_links").alias("n_groups"), "n_links", F.coalesce("n_best", F.lit(0)).alias("n_best"),
        F.coalesce("count_sum", F.lit(0)).alias("count_sum"), F.col("digest").alias("groups_sha256"),
    )
