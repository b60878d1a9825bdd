"""Near-duplicate components by fast similarity sketches, banding and exact verification."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.words import MULT, joined, mix, shingles, slices, word_hashes
from quarry.llm.worker import bounded_batches, tidy
from quarry.operators.components import connected_components
from quarry.storage import broadcast_if_small, materialise

BANDS, BAND_ROWS = 32, 4
COORDINATES = BANDS * BAND_ROWS


def shingle_sets(texts: list[bytes | None], width: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of all texts, ordered by text and hash, and where each text's begin."""
    buffer, starts = joined(texts)
    value, doc = shingles(*word_hashes(buffer, starts), len(texts), width)
    order = np.lexsort((value, doc))
    value, doc = value[order], doc[order]
    new = np.concatenate([[True], (value[1:] != value[:-1]) | (doc[1:] != doc[:-1])])[: len(value)]
    value, doc = value[new], doc[new]
    return value, np.searchsorted(doc, np.arange(len(texts) + 1))


def fast_similarity_sketch(value: np.ndarray, offsets: np.ndarray, t: int = COORDINATES) -> np.ndarray:
    """One row of ``t`` coordinates for each set; two sets agree in a coordinate with the probability of their Jaccard similarity.

    In each of t rounds every element is hashed to a bin and leaves there the round and a hash if
    that is smaller; a set with bins still empty goes on to the next round. After t rounds, round
    t + k puts all elements into bin k, so every bin of a set that isn't empty fills.
    """
    n, size = len(offsets) - 1, np.diff(offsets)
    out = np.full((n, t), np.uint64(2**64 - 1))
    sets = np.flatnonzero(size)
    doc = np.repeat(np.arange(n), size)
    for k in range(2 * t):
        if not len(sets):
            break
        if k:
            take = np.isin(doc, sets, kind="table") if len(sets) < n else slice(None)
            value, doc = value[take], doc[take]
        with np.errstate(over="ignore"):
            h = mix(value ^ (np.uint64(k + 1) * MULT))
        at = doc * t + ((h >> np.uint64(32)) * np.uint64(t) >> np.uint64(32)).astype(np.int64) if k < t else doc * t + (k - t)
        with np.errstate(over="ignore"):
            np.minimum.at(out.reshape(-1), at, (np.uint64(k) << np.uint64(55)) | (mix(h) >> np.uint64(9)))
        sets = sets[(out[sets] == np.uint64(2**64 - 1)).any(axis=1)]
    return out


def band_keys(sketch: np.ndarray) -> np.ndarray:
    """A key for each band of BAND_ROWS coordinates, different for different bands."""
    parts = sketch.reshape(len(sketch), BANDS, BAND_ROWS)
    key = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64), parts.shape[:2])
    with np.errstate(over="ignore"):
        for k in range(BAND_ROWS):
            key = mix(key * MULT ^ parts[:, :, k])
    return key


def set_digests(value: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
    """Two 64-bit hashes of each set."""
    total = [np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(value ^ np.uint64(s)), dtype=np.uint64)]) for s in (1, 2)]
    with np.errstate(over="ignore"):
        return [mix(x[offsets[1:]] - x[offsets[:-1]]).view(np.int64) for x in total]


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("row_id"), F.col(text_col).cast("binary").alias("body"))


def _sketched(docs: DataFrame, width: int) -> DataFrame:
    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for a, b in slices(texts):
                value, offsets = shingle_sets(texts[a:b], width)
                keys = band_keys(fast_similarity_sketch(value, offsets)).view(np.int64)
                digest = set_digests(value, offsets)
                bands = pa.ListArray.from_arrays(np.arange(b - a + 1, dtype=np.int32) * BANDS, keys.reshape(-1))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(np.diff(offsets), pa.int64()), *map(pa.array, digest), bands], ["row_id", "n", "h1", "h2", "bands"])

    return docs.mapInArrow(tidy(sketch), "row_id long, n long, h1 long, h2 long, bands array<long>")


def _sets(docs: DataFrame, width: int) -> DataFrame:
    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for a, b in slices(texts):
                value, offsets = shingle_sets(texts[a:b], width)
                h1, h2 = set_digests(value, offsets)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(h1), pa.array(h2), pa.ListArray.from_arrays(offsets.astype(np.int32), value.view(np.int64))], ["row_id", "h1", "h2", "members"])

    return docs.mapInArrow(tidy(build), "row_id long, h1 long, h2 long, members array<long>")


def _links(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets reach the similarity."""
    left = sets.select(F.col("row_id").alias("a"), F.col("members").alias("of_a"))
    right = sets.select(F.col("row_id").alias("b"), F.col("members").alias("of_b"))
    both = pairs.join(left, "a").join(right, "b")
    shared = F.size(F.array_intersect("of_a", "of_b"))
    return both.filter(100 * shared >= percent * (F.size("of_a") + F.size("of_b") - shared)).select("a", "b")


def _across(rows: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """All pairs (a, b) of different parts that can reach the similarity.

    Of a set of n, the n - ceil(n * percent / 100) + 1 rarest members are its prefix; two sets
    that reach the similarity have a member in both prefixes. Rarity is counted over ``rows``, so
    a passage that very many texts share brings none of them together by itself. Members that are
    found in no other part can't be in an overlap with one, and nothing before the first common
    member of two prefixes is common: both bound the overlap from above.
    """
    tokens = sets.join(rows, "row_id").select("row_id", "n", "part", F.explode("members").alias("token"))
    # written first, so that both sides of the join are plain exchanges and Spark can split a member that very many sets have
    counts = materialise(tokens.groupBy("token").agg(F.count("*").alias("docs"), F.min("part").alias("low"), F.max("part").alias("high")), "members")
    mixed = F.col("low") < F.col("high")
    ranked = tokens.join(counts, "token").groupBy("row_id", "n", "part").agg(
        F.count_if(mixed).alias("most"), F.sort_array(F.collect_list(F.struct("docs", "token", mixed.alias("mixed")))).alias("by_rarity")
    ).filter(100 * F.col("most") >= percent * F.col("n"))
    length = F.col("n") - F.ceil(F.col("n") * percent / 100) + 1
    prefix = ranked.select("row_id", "n", "part", "most", F.posexplode(F.slice("by_rarity", F.lit(1), length.cast("int"))).alias("at", "t")).filter("t.mixed")
    prefix = materialise(prefix.select("row_id", "n", "part", "most", "at", F.col("t.token").alias("token")), "prefixes")
    other = prefix.select("token", F.col("row_id").alias("b"), F.col("n").alias("m"), F.col("part").alias("other"), F.col("most").alias("most_b"), F.col("at").alias("at_b"))
    fits = f"a < b and part <> other and {100 + percent} * least(most, most_b, n - at, m - at_b) >= {percent} * (n + m)"
    meet = prefix.withColumnRenamed("row_id", "a").join(other, "token").filter(fits)
    return meet.select("a", "b").distinct()


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 80, broadcast_rows: int = 500_000,
) -> DataFrame:
    """Components of documents whose sets of word shingles have 100 * |A and B| >= percent * |A or B|.

    Words are runs without ASCII white space, A-Z in lower case; a text with fewer than ``width``
    words is one shingle; a null or blank text has none and is linked with nothing.

    1. One pass makes a fast similarity sketch of every set, and a digest of the set.
    2. Equal sets form a class, represented by its smallest id; only representatives go on.
    3. Representatives with a band in common are candidates. Each is first compared with the
       smallest one of its bucket, on full sets; components of these links follow.
    4. Sets that share a bucket but not a component are joined on the rare members that similar
       sets must share, and compared unless step 3 did. Pairs within one component would change nothing
       and are never made, so a large group of copies costs a pair for each member, and no link
       that matters is left out.

    A pair at exactly the similarity escapes all 32 bands with probability 1e-7 (80 %) or 5e-11
    (85 %). Columns: ``id_col`` (long), n_shingles long, component_id long (smallest id reachable),
    kept boolean. Ids are meant to be unique; rows that repeat an id each give a row, and if their sets differ, the one with
    the smallest digest stands for the id in the search, the others link it with equal sets only, and all rows of the id are in one component. A row with
    a null id is linked with nothing and kept. An empty table gives no rows; other columns are ignored.
    """
    bounded_batches(docs.sparkSession)
    texts = _texts(docs, id_col, text_col)
    meta = materialise(_sketched(texts, width), "sketches")
    usable = meta.filter("n > 0 and row_id is not null")
    several = materialise(usable.select("row_id", "n", "h1", "h2").groupBy("row_id").agg(F.min(F.struct("h1", "h2", "n")).alias("least"), F.max(F.struct("h1", "h2", "n")).alias("most")).filter("least <> most").select("row_id", "least"), "repeated")
    repeated = several.limit(1).count() > 0
    if repeated:
        other = meta.join(several, "row_id").filter("least <> struct(h1, h2, n)").select("row_id", "h1", "h2", "n", "least").distinct()
        usable = materialise(usable.join(other, ["row_id", "h1", "h2"], "left_anti"), "sketches")
    classes = materialise(usable.groupBy("h1", "h2", "n").agg(F.min("row_id").alias("rep")), "classes")
    banded = materialise(usable.join(classes.select(F.col("rep").alias("row_id")), "row_id", "left_semi").select("row_id", "n", F.explode("bands").alias("key")).distinct(), "bands")

    # written first, so that both sides of the join are plain exchanges and Spark can split a hot bucket
    heads = materialise(banded.groupBy("key").agg(F.min(F.struct("row_id", "n")).alias("head"), F.count("*").alias("size")).filter("size > 1"), "heads")
    members = materialise(banded.join(heads.select("key", "head"), "key"), "buckets")
    fits = f"100 * least(n, m) >= {percent} * greatest(n, m)"
    stars = materialise(
        members.select(F.col("head.row_id").alias("a"), F.col("row_id").alias("b"), F.col("head.n").alias("m"), "n").filter("a <> b").filter(fits).select("a", "b").distinct(), "pairs"
    )
    involved = members.select("row_id").distinct()
    sets = _sets(texts.join(broadcast_if_small(involved, broadcast_rows), "row_id", "left_semi"), width)
    if repeated:
        sets = sets.join(usable.select("row_id", "h1", "h2").distinct(), ["row_id", "h1", "h2"], "left_semi")
    sets = materialise(sets.drop("h1", "h2").dropDuplicates(["row_id"]), "sets")
    links = _links(stars, sets, percent)
    if repeated:
        of = classes.select(F.struct("h1", "h2", "n").alias("least"), F.col("rep").alias("a"))
        links = links.union(other.join(classes, ["h1", "h2", "n"]).select("least", F.col("rep").alias("b")).join(of, "least").select("a", "b"))
    links = materialise(links, "links")
    parts = connected_components(links, "a", "b")

    placed = members.join(parts, members.row_id == parts.id, "left").select("key", "row_id", "n", F.coalesce("component", "row_id").alias("part"))
    placed = materialise(placed, "placed")
    mixed = materialise(placed.groupBy("key").agg(F.min("part").alias("low"), F.max("part").alias("high")).filter("low < high").select("key"), "mixed")
    open_rows = materialise(placed.join(mixed, "key", "left_semi").select("row_id", "n", "part").distinct(), "open")
    fresh = materialise(_across(open_rows, sets, percent).join(stars, ["a", "b"], "left_anti"), "pairs")
    more = materialise(_links(fresh, sets, percent), "links")
    if more.limit(1).count():
        parts = connected_components(links.union(more), "a", "b")

    known = classes.join(parts, classes.rep == parts.id, "left").select("h1", "h2", "n", F.coalesce("component", "rep").alias("part"))
    ids = meta.select("row_id", F.col("n").alias("size"), "n", "h1", "h2")
    if repeated:
        ids = ids.join(several, "row_id", "left").withColumn("of", F.when(F.col("n") > 0, F.coalesce("least", F.struct("h1", "h2", "n")))).select("row_id", "size", "of.h1", "of.h2", "of.n")
    out = ids.join(known, ["h1", "h2", "n"], "left").select(
        F.col("row_id").alias(id_col), F.col("size").alias("n_shingles"), F.when(F.col("row_id").isNotNull() & (F.col("size") > 0), F.col("part")).otherwise(F.col("row_id")).alias("component_id")
    )
    return out.withColumn("kept", F.col(id_col).eqNullSafe(F.col("component_id")))
