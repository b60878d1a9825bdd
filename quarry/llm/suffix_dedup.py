"""Repeated long strings by blockwise suffix sorting with a difference cover.

Suffixes are dealt into buckets so that two which share their first ``length`` bytes meet in one bucket; a
task sorts the suffixes of one block of buckets at a time, and long ties are resolved by ranks of
the suffixes at a difference cover of the block, so memory is bounded by the block.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.words import _BYTE, CHUNK, mix, powers
from quarry.llm.worker import bounded_batches, tidy
from quarry.storage import broadcast_if_small, materialise

#: A position takes this many bits of the numbers whose minimum picks an anchor.
PLACE_BITS = 24
#: A difference cover, and its period. Every difference modulo PERIOD is one of two members.
PERIOD, COVER = 31, (1, 5, 11, 24, 25, 27)


def _byte_hashes(buffer: np.ndarray, k: int) -> np.ndarray:
    """64-bit hash of the k bytes from each position on, over at most CHUNK bytes."""
    n = len(buffer)
    up, down = powers()
    with np.errstate(over="ignore"):
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_BYTE[buffer] * up[:n], dtype=np.uint64)])
        return mix((total[k:] - total[: n + 1 - k]) * down[: n + 1 - k])


def anchors(buffer: np.ndarray, length: int, k: int) -> tuple[np.ndarray, ...]:
    """Runs of windows of ``length`` bytes that have the same anchor: first window, number, anchor, hash at the anchor.

    The anchor of a window is its leftmost k bytes of smallest hash, so equal windows have equal
    anchors at the same offset, whatever stands around them.
    """
    hashes = _byte_hashes(buffer, k)
    place = np.arange(len(hashes), dtype=np.uint64)
    least = (hashes >> np.uint64(PLACE_BITS) << np.uint64(PLACE_BITS)) | place
    width, span = length - k + 1, 1
    while span * 2 <= width:
        least = np.minimum(least[:-span], least[span:])
        span *= 2
    if span < width:
        least = np.minimum(least[: len(least) - (width - span)], least[width - span :])
    at = (least & np.uint64((1 << PLACE_BITS) - 1)).astype(np.int64)
    first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
    return first, np.diff(np.concatenate([first, [len(at)]])), at[first], hashes[at[first]]


def text_anchors(texts: list[bytes], length: int, k: int, segment: int = CHUNK) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """``anchors`` of every text of at least ``length`` bytes: text numbers, and so on, within texts.

    Many short texts go at a time; a text longer than ``segment`` (or than 16 windows, if that is more) goes in overlapping segments.
    """
    segment = min(CHUNK, max(segment, 16 * length))
    group: list[int] = []
    size = 0

    def flush():
        buffer = np.frombuffer(b"".join(texts[i] for i in group), np.uint8)
        ends = np.cumsum([len(texts[i]) for i in group])
        first, n, at, key = anchors(buffer, length, k)
        # a run is cut where a text ends; windows across an end, and anchors chosen by them, drop out
        of = np.searchsorted(ends, first, side="right")
        last = np.searchsorted(ends, first + n - 1, side="right")
        pieces = []
        for extra in range(int((last - of).max()) + 1):
            t = of + extra
            on = t <= last
            lo = np.maximum(first, np.where(t > 0, ends[t - 1], 0) if extra or len(ends) else first)
            hi = np.minimum(first + n, ends[np.minimum(t, len(ends) - 1)] - length + 1)
            on &= hi > lo
            pieces.append((t[on], lo[on], (hi - lo)[on], at[on], key[on]))
        t, lo, count, at, key = (np.concatenate(x) for x in zip(*pieces, strict=True))
        base = ends[t] - np.array([len(texts[i]) for i in group])[t]
        return np.array(group)[t], lo - base, count, at - base, key

    for i, text in enumerate(texts):
        if len(text) < length:
            continue
        if len(text) > segment:
            for a in range(0, len(text) - length + 1, segment - length + 1):
                first, n, at, key = anchors(np.frombuffer(text[a : a + segment], np.uint8), length, k)
                yield np.full(len(first), i), first + a, n, at + a, key
            continue
        if group and size + len(text) > segment:
            yield flush()
            group, size = [], 0
        group.append(i)
        size += len(text)
    if group:
        yield flush()


def collapse(texts: list[bytes], of: np.ndarray, first: np.ndarray, count: np.ndarray, offset: np.ndarray, key: np.ndarray, length: int) -> tuple[np.ndarray, list[tuple[int, int, int]]]:
    """Which runs of windows to keep, and spans (text, start, end) of those that occur again in their own text.

    Runs of one text whose bytes and anchor are equal (by a 128-bit hash) are all repeated, and the first of them stands for
    all towards other texts. So a text of short period keeps a few runs instead of one for each period.
    """
    with np.errstate(over="ignore"):
        tag = mix(key.astype(np.uint64) + mix((of.astype(np.uint64) << np.uint64(32)) + (count.astype(np.uint64) << np.uint64(16)) + offset.astype(np.uint64)))
    order = np.argsort(tag, kind="stable")
    twin = tag[order[1:]] == tag[order[:-1]]
    among = np.zeros(len(tag), bool)
    among[order[1:][twin]] = among[order[:-1][twin]] = True
    keep, seen, found = np.ones(len(tag), bool), {}, {}
    for e in np.flatnonzero(among).tolist():
        i, start, end = int(of[e]), int(first[e]), int(first[e] + count[e]) - 1 + length
        name = (i, int(offset[e]), hashlib.blake2b(texts[i][start:end], digest_size=16).digest(), end - start)
        if name in seen:
            keep[e] = False
            spans = found.setdefault(i, [])
            for span in ([start, end], seen[name]):
                if span and spans and spans[-1][0] <= span[0] <= spans[-1][1]:
                    spans[-1][1] = max(spans[-1][1], span[1])
                elif span:
                    spans.append(span)
            seen[name] = None
        else:
            seen[name] = [start, end]
    return keep, [(i, a, b) for i, spans in found.items() for a, b in spans]


def by_distance(offset: int, count: int, width: int) -> Iterator[tuple[int, int, int]]:
    """(range, first, end) of a run's windows whose distances to the anchor fall into the same range of ``width`` distances.

    Window i is at distance ``offset`` - i, so ranges come in falling order.
    """
    first = 0
    while first < count:
        number = (offset - first) // width
        end = min(count, offset - number * width + 1)
        yield number, first, end
        first = end


def narrower(rows: list[tuple], length: int, width: int) -> Iterator[tuple]:
    """Runs of hot buckets dealt anew: (bucket, digest, first, count, offset, context).

    Windows whose distances to the anchor fall into the same range of ``width`` share the bytes that every such window
    covers, ``length - width + 1`` of them at a fixed place from the anchor. These name the new bucket, so windows that can be equal still meet.
    """
    for bucket, digest, first, count, offset, context in rows:
        for number, a, b in by_distance(offset, count, width):
            common = offset - number * width
            shared = context[common : common - width + 1 + length]
            name = hashlib.blake2b(b"%d %d %d " % (bucket, width, number) + shared, digest_size=8).digest()
            yield int.from_bytes(name, "big", signed=True), digest, first + a, b - a, offset - a, context[a : b - 1 + length]


def _words(data: np.ndarray, at: np.ndarray, width: int) -> list[np.ndarray]:
    """The ``width`` bytes from each position on as big-endian 8-byte numbers, most significant first."""
    out = []
    for a in range(0, width, 8):
        word = np.zeros(len(at), np.uint64)
        for b in range(a, min(a + 8, width)):
            word = word << np.uint64(8) | data[at + b].astype(np.uint64)
        out.append(word)
    return out


def _rank(keys: list[np.ndarray]) -> np.ndarray:
    """Rank of each entry by ``keys``, the most significant first; equal entries have equal ranks."""
    order = np.lexsort(keys[::-1]) if len(keys) > 1 else np.argsort(keys[0], kind="stable")
    new = np.zeros(len(order), bool)
    for key in keys:
        sorted_key = key[order]
        new[1:] |= sorted_key[1:] != sorted_key[:-1]
    out = np.empty(len(order), np.int64)
    out[order] = np.cumsum(new)
    return out


def repeated_in_block(contexts: list[bytes], group: np.ndarray, offset: np.ndarray, count: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Which windows of a block of buckets occur more than once in it.

    Entry i is in bucket ``group[i]`` and has ``count[i]`` windows that start at the first bytes of
    ``contexts[i]``, whose anchor is at ``offset[i]``. Returns for all windows in turn: entry, start, repeated.
    Windows are compared within their bucket and distance to the anchor only, as others can't be equal.
    """
    # where each context goes: anchors fall on multiples of the period, so windows that can be equal share a phase
    base, end = np.zeros(len(contexts), np.int64), 0
    for i, c in enumerate(contexts):
        base[i] = end + (-(end + int(offset[i]))) % PERIOD
        end = base[i] + len(c)
    reach = PERIOD << max(1, int(np.ceil(np.log2(length / PERIOD))))
    data = np.zeros(end + 2 * reach, np.uint8)
    for i, c in enumerate(contexts):
        data[base[i] : base[i] + len(c)] = np.frombuffer(c, np.uint8)

    # ranks of the cover's suffixes: by their first PERIOD bytes, then by twice as many each time
    member = np.zeros(PERIOD, bool)
    member[list(COVER)] = True
    sample = np.flatnonzero(member[np.arange(end + PERIOD) % PERIOD])
    number = np.full(len(data) + reach, -1, np.int64)
    number[sample] = np.arange(len(sample))
    levels, depth = [_rank(_words(data, sample, PERIOD))], PERIOD
    while depth < length:
        follow = number[sample + depth]
        after = np.where(follow >= 0, levels[-1][follow] + 1, 0)
        levels.append(_rank([levels[-1] * (len(sample) + 2) + after]))
        depth *= 2

    entry = np.repeat(np.arange(len(contexts)), count)
    start = np.arange(len(entry)) - np.repeat(np.cumsum(count) - count, count)
    at = base[entry] + start
    wait = np.array([min(d for d in range(PERIOD) if member[(r + d) % PERIOD]) for r in range(PERIOD)])[at % PERIOD]
    distance = offset[entry] - start
    bucket = group[entry] * (int(distance.max()) + 1 if len(distance) else 1) + distance
    # order by bucket, then the bytes up to the next cover position, then that position's rank
    lead = np.zeros(len(at), np.uint64)
    more = np.zeros(len(at), np.uint64)
    for b in range(int(wait.max()) if len(wait) else 0):
        byte = np.where(b < wait, data[at + b], 0).astype(np.uint64)
        if b < 8:
            lead = lead << np.uint64(8) | byte
        else:
            more = more << np.uint64(8) | byte
    order = np.lexsort((levels[-1][number[at + wait]], more, lead, bucket))
    x, y = order[:-1], order[1:]
    same = (bucket[x] == bucket[y]) & (lead[x] == lead[y]) & (more[x] == more[y])
    x, y, pair = x[same], y[same], np.flatnonzero(same)
    # the rest of the window in steps whose ranks are known, and its last bytes one by one
    px, py, rest = at[x] + wait[x], at[y] + wait[y], length - wait[x]
    for level in range(len(levels) - 1, -1, -1):
        size = PERIOD << level
        while True:
            todo = rest >= size
            if not todo.any():
                break
            equal = ~todo
            equal[todo] = levels[level][number[px[todo]]] == levels[level][number[py[todo]]]
            px, py, rest, x, y, pair, todo = (v[equal] for v in (px, py, rest, x, y, pair, todo))
            px, py, rest = px + size * todo, py + size * todo, rest - size * todo
    for b in range(PERIOD - 1):
        equal = (b >= rest) | (data[px + b] == data[py + b])
        px, py, rest, x, y, pair = (v[equal] for v in (px, py, rest, x, y, pair))
    repeated = np.zeros(len(at), bool)
    repeated[x] = repeated[y] = True
    return entry, start, repeated


def _runs(entry: np.ndarray, start: np.ndarray, mark: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of marked windows: entry, first start, last start."""
    at = np.flatnonzero(mark)
    if not len(at):
        return at, at, at
    new = np.concatenate([[True], (np.diff(at) != 1) | (entry[at[1:]] != entry[at[:-1]])])
    first = at[new]
    last = at[np.concatenate([np.flatnonzero(new)[1:] - 1, [len(at) - 1]])]
    return entry[first], start[first], start[last]


def _block(rows: list[tuple], length: int) -> list[tuple]:
    """Spans (digest, start, end) of the windows that occur more than once in a block of buckets.

    Rows are (bucket, digest, first, count, offset, context). Rows of one bucket with the same context are sorted once.
    """
    groups: dict = {}
    same: dict = {}
    for bucket, digest, first, count, offset, context in rows:
        same.setdefault((groups.setdefault(bucket, len(groups)), offset, count, context), []).append((digest, first))
    keys = list(same)
    entry, start, repeated = repeated_in_block([k[3] for k in keys], *(np.array([k[j] for k in keys], np.int64) for j in range(3)), length)
    repeated |= np.array([len(same[k]) > 1 for k in keys])[entry]
    return [(digest, first + lo, first + hi + length) for e, lo, hi in zip(*(v.tolist() for v in _runs(entry, start, repeated)), strict=True) for digest, first in same[keys[e]]]


#: Rows that go to a sort: a run of windows and the bytes that they cover.
_CONTEXT = "bucket long, digest binary, first long, count int, offset int, context binary"
_KINDS = (pa.int64(), pa.binary(), pa.int64(), pa.int32(), pa.int32(), pa.binary())


def _batches(rows: Iterator[tuple], names: list[str], kinds: tuple, most: int = 2000) -> Iterator[pa.RecordBatch]:
    held: list = []
    for row in rows:
        held.append(row)
        if len(held) >= most:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), kinds, strict=True)], names)
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), kinds, strict=True)], names)


def _tuples(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(c.to_pylist() for c in batch.columns), strict=True)


_NAMES = [c.split()[0] for c in _CONTEXT.split(", ")]


def split_hot_buckets(hot: DataFrame, length: int, width: int, bucket_rows: int) -> tuple[list[DataFrame], list[DataFrame]]:
    """(rows of bounded buckets, spans that are already known to be repeated) for the rows of buckets that are too large to sort.

    In each round equal contexts of a bucket become one row, as all their windows are repeated, and what is left is dealt by a longer
    piece of its bytes (``narrower``), with ranges a quarter as wide. A row that is then alone is dropped, since no window equals its own; a
    bucket of at most ``bucket_rows`` rows is bounded. With ranges of one window a bucket holds equal windows only, so the rounds end. Groups
    are counted by pre-aggregation and joined back, so none is gathered anywhere, however many rows it has.
    """
    ready, spans = [], []
    while True:
        named = hot.withColumn("name", F.substring(F.unhex(F.sha2("context", 256)), 1, 16))
        of = ["bucket", "offset", "count", "name"]
        groups = materialise(named.groupBy(*of).agg(F.count("*").alias("copies"), F.min(F.struct("digest", "first")).alias("one")), "equal")
        joined = named.join(groups, of)
        alone = (F.col("digest") == F.col("one.digest")) & (F.col("first") == F.col("one.first"))
        known = materialise(joined.select("bucket", "digest", "first", "count", "offset", "copies", F.when(alone, F.col("context")).alias("context")), "known")
        spans.append(known.filter("copies > 1").select("digest", F.col("first").alias("start"), (F.col("first") + F.col("count") - 1 + length).alias("end")))
        if width == 1:
            return ready, spans
        width = -(-width // 4)

        def deal(batches: Iterator[pa.RecordBatch], width: int = width) -> Iterator[pa.RecordBatch]:
            return _batches(narrower(_tuples(batches), length, width), _NAMES, _KINDS)

        dealt = materialise(known.filter("context is not null").select(*_NAMES).mapInArrow(tidy(deal), _CONTEXT), "dealt")
        counts = materialise(dealt.groupBy("bucket").agg(F.count("*").alias("n")).filter("n > 1"), "common")
        ready.append(dealt.join(counts.filter(F.col("n") <= bucket_rows).select("bucket"), "bucket").select(*_NAMES))
        large = counts.filter(F.col("n") > bucket_rows)
        if not large.limit(1).count():
            return ready, spans
        hot = dealt.join(large.select("bucket"), "bucket").select(*_NAMES)


def repeated_spans(docs: DataFrame, text_col: str = "text", length: int = 400, bucket_rows: int = 256, block_bytes: int = 1 << 20, broadcast_rows: int = 500_000) -> tuple[DataFrame, DataFrame]:
    """(spans of repeated strings by text digest, number of rows by digest of the texts that are repeated whole).

    1. Every window of ``length`` bytes gets an anchor in it. Anchors that occur once in all texts
       belong to windows that occur once; no other windows are dropped. Equal texts count as one here.
       Of equal runs of windows within one text one goes on, as they are known to be repeated (``collapse``).
    2. Buckets are keyed by the anchor's hash. Their entries carry the bytes of their windows, about three times
       the bytes in question. A bucket of more than ``bucket_rows`` entries is dealt by longer pieces until it is bounded (``split_hot_buckets``).
    3. Each task sorts block after block of buckets (``repeated_in_block``).
    """
    bounded_batches(docs.sparkSession)
    k = max(1, length // 4)
    body = F.coalesce(F.col(f"`{text_col}`").cast("string").cast("binary"), F.lit(b""))
    texts = docs.select(body.alias("body"), F.substring(F.unhex(F.sha2(body, 256)), 1, 16).alias("digest"))
    copies = texts.filter(F.length("body") >= length).groupBy("digest").agg(F.count("*").alias("copies")).filter("copies > 1")

    def anchor_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["digest", "bucket", "first", "count", "offset", "end"]
        for batch in batches:
            bodies = batch.column(0).to_pylist()
            for found in text_anchors(bodies, length, k):
                of, first, count, at, key = found
                keep, own = collapse(bodies, of, first, count, at - first, key, length)
                columns = [batch.column(1).take(pa.array(of[keep])), pa.array(key[keep].view(np.int64)), pa.array(first[keep], pa.int64()), pa.array(count[keep], pa.int32()), pa.array((at - first)[keep], pa.int32())]
                yield pa.RecordBatch.from_arrays([*columns, pa.nulls(int(keep.sum()), pa.int64())], names)
                if own:
                    text, start, end = (pa.array(x, pa.int64()) for x in zip(*own, strict=True))
                    yield pa.RecordBatch.from_arrays([batch.column(1).take(text), pa.nulls(len(own), pa.int64()), start, *[pa.nulls(len(own), pa.int32())] * 2, end], names)

    long_enough = texts.filter(F.length("body") >= length)
    every = materialise(long_enough.mapInArrow(tidy(anchor_rows), "digest binary, bucket long, first long, count int, offset int, end long").distinct(), "anchors")
    rows, own = every.filter("end is null").drop("end"), every.filter("end is not null").select("digest", F.col("first").alias("start"), "end")
    # written first, so that both sides of the join are plain exchanges and Spark can split a hot anchor
    common = materialise(rows.groupBy("bucket").agg(F.count("*").alias("n")).filter("n > 1"), "common")
    wanted = rows.join(common, "bucket").groupBy("digest").agg(F.collect_list(F.struct("bucket", "n", "first", "count", "offset")).alias("runs"))
    wanted = materialise(wanted, "wanted")
    bodies = texts.join(broadcast_if_small(wanted.select("digest"), broadcast_rows), "digest", "left_semi").dropDuplicates(["digest"])

    def contexts(asked: DataFrame) -> DataFrame:
        def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            found = ((r["bucket"], digest, r["first"], r["count"], r["offset"], text[r["first"] : r["first"] + r["count"] - 1 + length]) for digest, text, runs in _tuples(batches) for r in runs)
            return _batches(found, _NAMES, _KINDS)

        return bodies.join(asked, "digest").select("digest", "body", "runs").mapInArrow(tidy(cut), _CONTEXT)

    def of_buckets(hot: bool) -> DataFrame:
        runs = F.filter("runs", lambda r: (r["n"] > bucket_rows) if hot else (r["n"] <= bucket_rows))
        return wanted.select("digest", runs.alias("runs")).filter(F.size("runs") > 0)

    ready, spans = [contexts(of_buckets(hot=False))], [own]
    if common.filter(F.col("n") > bucket_rows).limit(1).count():
        more, known = split_hot_buckets(materialise(contexts(of_buckets(hot=True)), "hot"), length, length - k + 1, bucket_rows)
        ready, spans = ready + more, spans + known

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def found() -> Iterator[tuple]:
            held, size, last = [], 0, None
            for row in _tuples(batches):
                if row[0] != last and size >= block_bytes:
                    yield from _block(held, length)
                    held, size = [], 0
                last = row[0]
                held.append(row)
                size += len(row[5])
            if held:
                yield from _block(held, length)

        return _batches(found(), ["digest", "start", "end"], (pa.binary(), pa.int64(), pa.int64()))

    dealt = reduce(DataFrame.unionByName, ready).repartition(F.col("bucket")).sortWithinPartitions("bucket")
    found = materialise(dealt.mapInArrow(tidy(blocks), "digest binary, start long, end long"), "spans")
    return reduce(DataFrame.unionByName, spans, found), copies


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 400, keep_columns: bool = False, **options) -> DataFrame:
    """Every text without the bytes that a string of ``length`` bytes covers which also starts anywhere else.

    Texts are UTF-8 bytes; strings lie within one text, overlap with themselves or others as they
    like, and are judged on the input, so all their occurrences go. Columns: ``id_col`` (with
    ``keep_columns`` all columns of ``docs`` but the text), kept binary, n_bytes long, n_removed long, n_spans long
    (maximal removed runs). A null text counts as empty, loses nothing and has a null ``kept``; equal rows are copies
    of each other, so long ones lose everything; an empty table gives no rows. With ``keep_columns``,
    columns of ``docs`` that bear the names of results give way to them.
    """
    spans, copies = repeated_spans(docs, text_col, length, **options)
    results = ("kept", "n_bytes", "n_removed", "n_spans")
    names = [c for c in docs.columns if c not in (*results, text_col)] if keep_columns else [id_col]
    body = F.col(f"`{text_col}`").cast("string").cast("binary")
    own = F.struct(*(F.col(f"`{c}`").alias(f"c{k}") for k, c in enumerate(names))).alias("own")
    rows = docs.select(own, body.alias("body")).withColumn("digest", F.substring(F.unhex(F.sha2("body", 256)), 1, 16))
    by_text = spans.groupBy("digest").agg(F.collect_set(F.struct("start", "end")).alias("spans"))
    marks = by_text.join(copies.withColumn("whole", F.lit(True)), "digest", "full").select("digest", "spans", F.coalesce("whole", F.lit(False)).alias("whole"))
    # written first, so that both sides of the join are plain exchanges and Spark can split a text that very many rows have
    marks = materialise(marks, "marks")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept, size, removed, runs = [], [], [], []
            for text, found, all_of_it in zip(*(c.to_pylist() for c in batch.columns[1:]), strict=True):
                n = len(text or b"")
                merged: list = [[0, n]] if all_of_it else []
                for s, e in sorted((x["start"], x["end"]) for x in found or () if not all_of_it):
                    if merged and s <= merged[-1][1]:
                        merged[-1][1] = max(merged[-1][1], e)
                    else:
                        merged.append([s, e])
                edges = [0, *(x for m in merged for x in m), n]
                kept.append(b"".join(text[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True)) if merged else text)
                size.append(n)
                removed.append(sum(e - s for s, e in merged))
                runs.append(len(merged))
            numbers = (pa.array(x, pa.int64()) for x in (size, removed, runs))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(kept, pa.binary()), *numbers], ["own", *results])

    kind = rows.schema["own"].dataType.simpleString()
    out = rows.join(marks, "digest", "left").select("own", "body", "spans", "whole").mapInArrow(tidy(cut), f"own {kind}, kept binary, n_bytes long, n_removed long, n_spans long")
    return out.select(*(F.col(f"own.c{k}").alias(c) for k, c in enumerate(names)), *results)
