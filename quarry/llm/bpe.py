"""Byte-level BPE over padded numpy matrices, one row for each piece."""

from __future__ import annotations

import base64
import heapq
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.pretokens import splitter
from quarry.llm.worker import bounded_batches, state, tidy

NONE = np.int32(2**31 - 1)


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}


class PairTable:
    """Rank of a pair of ids by open addressing, looked up for whole arrays at once."""

    def __init__(self, ranks: dict[bytes, int]):
        keys, values = [], []
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                left, right = ranks.get(token[:cut]), ranks.get(token[cut:])
                if left is not None and right is not None:
                    keys.append(left << 32 | right)
                    values.append(rank)
        keys, values = np.array(keys, np.uint64), np.array(values, np.int32)
        self.bits = max(4, int(np.ceil(np.log2(max(2, len(keys)) * 4))))
        self.keys = np.full(1 << self.bits, np.uint64(2**64 - 1))
        self.values = np.full(1 << self.bits, NONE, np.int32)
        slot, todo = self._slot(keys), np.arange(len(keys))
        while len(todo):
            free = self.keys[slot[todo]] == np.uint64(2**64 - 1)
            _, first = np.unique(slot[todo][free], return_index=True)
            put = todo[free][first]
            self.keys[slot[put]], self.values[slot[put]] = keys[put], values[put]
            todo = np.setdiff1d(todo, put, assume_unique=True)
            slot[todo] = (slot[todo] + 1) & (len(self.keys) - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def __call__(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """NONE where a side is padding (negative) or the pair isn't a merge."""
        keys = (left.astype(np.uint64) << np.uint64(32)) | (right.astype(np.uint64) & np.uint64(0xFFFFFFFF))
        slot = self._slot(keys)
        held = self.keys[slot]
        out = np.where(held == keys, self.values[slot], NONE)
        todo = np.nonzero((held != keys) & (held != np.uint64(2**64 - 1)))
        while len(todo[0]):
            slot[todo] = (slot[todo] + 1) & (len(self.keys) - 1)
            held, wanted = self.keys[slot[todo]], keys[todo]
            hit = held == wanted
            out[tuple(x[hit] for x in todo)] = self.values[slot[todo][hit]]
            go = ~hit & (held != np.uint64(2**64 - 1))
            todo = tuple(x[go] for x in todo)
        out[(left < 0) | (right < 0)] = NONE
        return out


class MatrixBpe:
    """Encodes many pieces at once; ``long_piece`` is the length from which a heap does one piece."""

    def __init__(self, ranks: dict[bytes, int], long_piece: int = 192, cells: int = 1 << 20):
        self.ranks, self.pairs, self.long_piece, self.cells = ranks, PairTable(ranks), long_piece, cells
        self.byte_id = np.array([ranks.get(bytes([b]), -1) for b in range(256)], np.int32)
        if (self.byte_id < 0).any():
            raise ValueError("the ranks lack single bytes")
        top = max(ranks.values()) + 1
        tokens = [b""] * top
        for token, rank in ranks.items():
            tokens[rank] = token
        self.lengths = np.array([len(t) for t in tokens], np.int64)
        self.starts = np.concatenate([[0], np.cumsum(self.lengths)[:-1]])
        self.bytes = np.frombuffer(b"".join(tokens), np.uint8)

    def encode(self, pieces: list[bytes]) -> list[np.ndarray]:
        out: list = [None] * len(pieces)
        widths = np.array([len(p) for p in pieces])
        # buckets of similar lengths: padding is at most a quarter of a row or three cells
        bucket = np.where(widths <= 4, 4, np.ceil(widths / 4) * 4).astype(np.int64)
        for width in np.unique(bucket):
            rows = np.nonzero(bucket == width)[0]
            if width > self.long_piece:
                for r in rows:
                    out[r] = self._by_heap(pieces[r])
                continue
            step = max(1, self.cells // int(width))
            for a in range(0, len(rows), step):
                self._matrix(pieces, rows[a : a + step], int(width), out)
        return out

    def _matrix(self, pieces: list[bytes], rows: np.ndarray, width: int, out: list) -> None:
        raw = np.frombuffer(b"".join(pieces[r].ljust(width, b"\0") for r in rows), np.uint8).reshape(len(rows), width)
        size = np.array([len(pieces[r]) for r in rows])
        ids = self.byte_id[raw]
        ids[np.arange(width)[None, :] >= size[:, None]] = -1
        rank = self.pairs(ids[:, :-1], ids[:, 1:])
        whole = np.array([self.ranks.get(pieces[r], -1) for r in rows])
        for k in np.nonzero(whole >= 0)[0]:
            out[rows[k]] = whole[k : k + 1].astype(np.int32)
        live = whole < 0
        rows, ids, rank, size = rows[live], ids[live], rank[live], size[live]
        while len(rows):
            at = rank.argmin(axis=1) if rank.shape[1] else np.zeros(len(rows), np.int64)
            best = rank[np.arange(len(rows)), at] if rank.shape[1] else np.full(len(rows), NONE)
            done = best == NONE
            if done.any():
                for k in np.nonzero(done)[0]:
                    out[rows[k]] = ids[k, : size[k]].copy()
                go = ~done
                rows, ids, rank, size, at, best = rows[go], ids[go], rank[go], size[go], at[go], best[go]
                if not len(rows):
                    return
            n, w = ids.shape
            each = np.arange(n)
            ids[each, at] = best
            # compaction: every row drops the cell right of its merge, so rows stay equally wide
            keep = np.ones((n, w), bool)
            keep[each, at + 1] = False
            ids = ids[keep].reshape(n, w - 1)
            rank = rank[keep[:, 1:]].reshape(n, w - 2)
            size = size - 1
            has = at > 0
            rank[each[has], at[has] - 1] = self.pairs(ids[each[has], at[has] - 1], ids[each[has], at[has]])
            has = at < w - 2
            rank[each[has], at[has]] = self.pairs(ids[each[has], at[has]], ids[each[has], at[has] + 1])

    def _by_heap(self, piece: bytes) -> np.ndarray:
        """The same merges for one long piece, in n log n steps."""
        whole = self.ranks.get(piece)
        if whole is not None:
            return np.array([whole], np.int32)
        ids = self.byte_id[np.frombuffer(piece, np.uint8)].tolist()
        n = len(ids)
        after, before, token = list(range(1, n + 1)), list(range(-1, n - 1)), [piece[k : k + 1] for k in range(n)]
        heap = [(r, k, ids[k], ids[k + 1]) for k in range(n - 1) if (r := self.ranks.get(token[k] + token[k + 1])) is not None]
        heapq.heapify(heap)
        gone = [False] * n
        while heap:
            rank, k, left, right = heapq.heappop(heap)
            j = after[k]
            if gone[k] or j >= n or ids[k] != left or ids[j] != right:
                continue
            ids[k], token[k], gone[j], after[k] = rank, token[k] + token[j], True, after[j]
            if after[k] < n:
                before[after[k]] = k
            for a, b in ((before[k], k), (k, after[k])):
                if a >= 0 and b < n and (r := self.ranks.get(token[a] + token[b])) is not None:
                    heapq.heappush(heap, (r, a, ids[a], ids[b]))
        return np.array([x for x, dead in zip(ids, gone, strict=True) if not dead], np.int32)

    def decode(self, ids: np.ndarray) -> bytes:
        size = self.lengths[ids]
        ends = np.cumsum(size)
        if not len(ends):
            return b""
        at = np.repeat(self.starts[ids] - (ends - size), size) + np.arange(ends[-1])
        return self.bytes[at].tobytes()


class TextEncoder:
    def __init__(self, ranks: dict[bytes, int], room: int):
        import public_tokenizers

        self.bpe, self.room, self.cache = MatrixBpe(ranks), room, {}
        self.pieces, self.odd = splitter()
        self.pattern, self.library = public_tokenizers.PATTERN, None

    def _by_library(self, text: str) -> np.ndarray:
        """For texts with a code point that isn't assigned here, which the library may know as a letter; it doesn't show its pieces."""
        if self.library is None:
            import tiktoken

            self.library = tiktoken.Encoding("ranks", pat_str=self.pattern, mergeable_ranks=self.bpe.ranks, special_tokens={})
        return np.array(self.library.encode_ordinary(text), np.int32)

    def __call__(self, texts: list[str]) -> list[np.ndarray]:
        split = [None if self.odd(t) else self.pieces(t) for t in texts]
        new = list({p for s in split if s for p in s}.difference(self.cache))
        if len(self.cache) + len(new) > self.room:
            self.cache.clear()
            new = list({p for s in split if s for p in s})
        self.cache.update(zip(new, self.bpe.encode([p.encode() for p in new]), strict=True))
        get = self.cache.__getitem__
        return [self._by_library(t) if s is None else np.concatenate([np.empty(0, np.int32), *map(get, s)]) for t, s in zip(texts, split, strict=True)]


def _encoder(key: str, shared) -> TextEncoder:
    return state(key, lambda: TextEncoder(*shared.value))


def _slices(texts: list[str], chars: int = 400_000) -> Iterator[tuple[int, int]]:
    a = total = 0
    for b, t in enumerate(texts):
        total += len(t)
        if total >= chars:
            yield a, b + 1
            a, total = b + 1, 0
    if a < len(texts):
        yield a, len(texts)


def _lists(arrays: list[np.ndarray]) -> pa.ListArray:
    offsets = np.concatenate([[0], np.cumsum([len(a) for a in arrays])]).astype(np.int32)
    return pa.ListArray.from_arrays(offsets, np.concatenate([np.empty(0, np.int32), *arrays]))


def bpe_encode(docs: DataFrame, ranks_path: str, id_col: str = "doc_id", text_col: str = "text", decode: bool = False, cache_room: int = 250_000) -> DataFrame:
    """Token ids of every whole text by a byte-level rank file, each match of the pattern by itself.

    Columns: ``id_col``, ids array<int>, and with ``decode`` also decoded binary, which is made from
    the ids alone. The rank file (under 1 MB) is broadcast; rows stay in their partitions. A worker
    encodes the pieces it hasn't met in length-bucketed matrices: every row of a matrix merges its
    leftmost pair of lowest rank in each round. Pieces of over 192 bytes go through a heap instead,
    which makes the same merges.

    Special tokens are never produced. A null or empty text gives no ids and empty bytes; an empty
    table gives no rows; repeated rows each give a row; other columns are ignored.
    """
    bounded_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast((read_ranks(ranks_path), cache_room))
    key = uuid.uuid4().hex

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(key, shared)
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            for a, b in _slices(texts):
                ids = encoder(texts[a:b])
                columns = {"row_id": batch.column(0).slice(a, b - a), "ids": _lists(ids)}
                if decode:
                    columns["decoded"] = pa.array([encoder.bpe.decode(x) for x in ids], pa.binary())
                yield pa.RecordBatch.from_pydict(columns)

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("row_id"), F.col(text_col).cast("string").alias("body"))
    return rows.mapInArrow(tidy(encode, key), f"row_id {kind}, ids array<int>" + ", decoded binary" * decode).withColumnRenamed("row_id", id_col)


def bpe_decode(encoded: DataFrame, ranks_path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """Bytes of every row's ids (null ids: null). Columns: ``id_col``, decoded binary. An id outside the vocabulary fails the task."""
    bounded_batches(encoded.sparkSession)
    shared = encoded.sparkSession.sparkContext.broadcast((read_ranks(ranks_path), 0))
    key = uuid.uuid4().hex

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _encoder(key, shared).bpe
        for batch in batches:
            out = [None if x is None else bpe.decode(np.array(x, np.int64)) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_pydict({"row_id": batch.column(0), "decoded": pa.array(out, pa.binary())})

    kind = encoded.schema[id_col].dataType.simpleString()
    return encoded.select(F.col(id_col).alias("row_id"), F.col(ids_col).cast("array<int>").alias("ids")).mapInArrow(tidy(decode, key), f"row_id {kind}, decoded binary").withColumnRenamed("row_id", id_col)
