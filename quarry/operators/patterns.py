"""Very many patterns in very many texts, in one pass over the texts for each share of the patterns that a worker can hold."""

from __future__ import annotations

import unicodedata
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bytes of patterns that go to a worker at a time, as text; an automaton takes some tens of times as much.
SHARE_BYTES = 8 << 20
_BUILT: dict = {}


def _shares(patterns: DataFrame, term: str, share_bytes: int) -> int:
    found = patterns.agg(F.coalesce(F.sum(F.octet_length(F.col(term)) + 16), F.lit(0)).alias("bytes")).first()
    return -(-int(found.bytes) // share_bytes)


def _word_char(c: str) -> bool:
    return c == "_" or unicodedata.category(c)[0] in "LN"


def _automaton(key: str, pairs: list[tuple]):
    """The automaton of a share, built once in a worker for as long as it works on that share."""
    import ahocorasick

    if key not in _BUILT:
        _BUILT.clear()
        found: dict = {}
        for term, value in pairs:
            found.setdefault(term, []).append(value)
        a = ahocorasick.Automaton()
        for term, values in found.items():
            a.add_word(term, (len(term), values))
        if len(a):
            a.make_automaton()
        _BUILT[key] = a
    return _BUILT[key]


def _rounds(patterns: DataFrame, columns: list[Column], term: str, share_bytes: int) -> Iterator[tuple[str, object]]:
    """Each share of the patterns, as a broadcast list of at most about ``share_bytes``: how many there are is measured first."""
    n = _shares(patterns, term, share_bytes)
    for k in range(n):
        rows = patterns.filter(F.pmod(F.xxhash64(F.col(term), F.lit(7)), F.lit(n)) == k).select(*columns).collect()
        yield uuid.uuid4().hex, patterns.sparkSession.sparkContext.broadcast([tuple(r) for r in rows])


def match_patterns(texts: DataFrame, patterns: DataFrame, id_col: str = "id", text_col: str = "text", pattern_col: str = "pattern_id", term_col: str = "term", share_bytes: int = SHARE_BYTES) -> DataFrame:
    """Which patterns each text holds: ``id_col``, ``pattern_col``, n, first. Case doesn't count.

    A term with a blank is a phrase and is found wherever it stands; a term without one is a word and is found between word boundaries (letters, numbers and the
    underscore are word characters). Every occurrence counts, overlapping ones too; ``first`` is the place of the first in the lower-case text, from 0. Patterns with
    the same term are all found. Null and blank terms and null texts are found nowhere.

    All patterns of a share go through a text at once, by an automaton on Arrow batches in the worker. A share is the patterns of about ``share_bytes``, which bounds
    what is broadcast; a larger table takes more shares, and a pass over the texts for each. Texts are never shuffled.
    """
    term = F.trim(F.lower(F.col(term_col)))
    usable = patterns.select(F.col(pattern_col).alias("p"), term.alias("t")).filter("t <> ''").distinct()
    kind, wanted = texts.schema[id_col].dataType.simpleString(), usable.schema["p"].dataType
    low = texts.select(F.col(id_col).alias("id"), F.lower(F.col(text_col)).alias("body"))
    schema = f"id {kind}, p {wanted.simpleString()}, n long, first long"

    def run_of(key: str, shared) -> Callable:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            automaton = _automaton(key, shared.value)
            for batch in batches:
                rows: list[tuple] = []
                for at, body in enumerate(batch.column(1).to_pylist()):
                    seen: dict = {}
                    for end, (size, values) in automaton.iter(body) if body and len(automaton) else ():
                        start = end - size + 1
                        whole = " " in body[start : end + 1] or not (start and _word_char(body[start - 1]) or end + 1 < len(body) and _word_char(body[end + 1]))
                        if whole:
                            for v in values:
                                n, first = seen.get(v, (0, start))
                                seen[v] = n + 1, min(first, start)
                    rows += [(at, v, n, first) for v, (n, first) in seen.items()]
                ids = batch.column(0).take(pa.array([r[0] for r in rows], pa.int64()))
                yield pa.RecordBatch.from_arrays([ids, pa.array([r[1] for r in rows]).cast(batch_type), pa.array([r[2] for r in rows], pa.int64()), pa.array([r[3] for r in rows], pa.int64())], ["id", "p", "n", "first"])

        return run

    from pyspark.sql.pandas.types import to_arrow_type

    batch_type = to_arrow_type(wanted)
    out = None
    for key, shared in _rounds(usable, ["t", "p"], "t", share_bytes):
        part = low.mapInArrow(run_of(key, shared), schema)
        out = part if out is None else out.unionByName(part)
    out = texts.sparkSession.createDataFrame([], schema) if out is None else out
    return out.select(F.col("id").alias(id_col), F.col("p").alias(pattern_col), "n", "first")


def redact_known(rows: DataFrame, values: DataFrame, text_col: str = "text", value_col: str = "value", mark: str = "[redacted]", share_bytes: int = SHARE_BYTES) -> DataFrame:
    """``rows`` with every known value in ``text_col`` replaced by ``mark``; case counts.

    Of values that overlap in a text the one that starts first goes, of those that start together the longest; what is left of another stays. Values go in shares as in
    ``match_patterns``, a later share on what the earlier ones have left. Null and empty values are none.
    """
    usable = values.select(F.col(value_col).alias("v")).filter("v <> ''").distinct()
    names, at = rows.columns, rows.columns.index(text_col)

    def run_of(key: str, shared) -> Callable:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            automaton = _automaton(key, [(v, None) for (v,) in shared.value])
            for batch in batches:
                texts = [_replaced(automaton, t, mark) if t else t for t in batch.column(at).to_pylist()]
                columns = [*batch.columns[:at], pa.array(texts, pa.string()), *batch.columns[at + 1 :]]
                yield pa.RecordBatch.from_arrays(columns, names)

        return run

    for key, shared in _rounds(usable, ["v"], "v", share_bytes):
        rows = rows.mapInArrow(run_of(key, shared), rows.schema)
    return rows


def _replaced(automaton, text: str, mark: str) -> str:
    if not len(automaton):
        return text
    out, done = [], 0
    for end, (size, _) in automaton.iter_long(text):
        out += [text[done : end - size + 1], mark]
        done = end + 1
    return "".join([*out, text[done:]]) if out else text
