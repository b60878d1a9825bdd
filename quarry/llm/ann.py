"""Nearest vectors by multi-index hashing over learned rotated binary codes, with exact scores."""

from __future__ import annotations

import uuid
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quarry.llm.sample import bounded_sample
from quarry.llm.worker import bounded_batches, give_back, state
from quarry.storage import materialise

#: Width of a substring, and how many bits of two 16-bit numbers differ, by their exclusive or.
PART = 16
_ONES = np.bitwise_count(np.arange(1 << PART, dtype=np.uint16))


def _masks(radius: int) -> np.ndarray:
    return np.array([sum(1 << b for b in bits) for r in range(radius + 1) for bits in combinations(range(PART), r)], np.uint16)


@dataclass
class RotatedCodes:
    """Signs of rotated vectors, PART bits to a substring; ``radius`` is the Hamming distance that is searched."""

    rotations: np.ndarray
    longest: float
    radius: int = 0

    def encode(self, x: np.ndarray, query: bool) -> np.ndarray:
        """Largest inner product is smallest angle once indexed vectors are padded to one length."""
        norm = np.linalg.norm(x, axis=1, keepdims=True)
        pad = np.zeros_like(norm) if query else np.sqrt(np.maximum(0, self.longest**2 - norm**2))
        scaled = np.hstack([x, pad]) / (norm if query else self.longest)
        bits = np.packbits(scaled @ self.rotations > 0, axis=1, bitorder="little")
        return np.ascontiguousarray(bits).view(np.uint16)


def learn_codes(sample: np.ndarray, longest: float, bits: int, seed: int = 7, rounds: int = 30) -> RotatedCodes:
    """Rotations of the principal axes, each turned so that its signs lose least (iterative quantisation)."""
    rng = np.random.default_rng(seed)
    norm = np.linalg.norm(sample, axis=1, keepdims=True)
    padded = np.hstack([sample, np.sqrt(np.maximum(0, longest**2 - norm**2))]) / longest
    _, axes = np.linalg.eigh(padded.T @ padded)
    axes = axes[:, ::-1][:, : min(padded.shape[1], 64)]
    z = padded @ axes
    found = []
    while sum(r.shape[1] for r in found) < bits:
        turn = np.linalg.qr(rng.normal(size=(z.shape[1], z.shape[1])))[0]
        for _ in range(rounds):
            u, _, v = np.linalg.svd(np.sign(z @ turn).T @ z)
            turn = (u @ v).T
        found.append(axes @ turn)
    return RotatedCodes(np.hstack(found)[:, :bits], longest)


def learn_radius(codes: RotatedCodes, sample: np.ndarray, near: int, share: float) -> int:
    """The Hamming distance within which ``share`` of the sample's nearest ``near`` neighbours lie."""
    scores = sample @ sample.T
    np.fill_diagonal(scores, -np.inf)
    near = min(near, len(sample) - 1)
    top = np.argpartition(-scores, near - 1, axis=1)[:, :near] if near else np.zeros((len(sample), 0), int)
    if not top.size:
        return codes.rotations.shape[1]
    a, b = codes.encode(sample, True), codes.encode(sample, False)
    distance = _ONES[a[:, None, :] ^ b[top]].sum(axis=2)
    return int(np.quantile(distance, share, method="higher"))


class MultiIndex:
    """Buckets of one block by the value of each substring of its codes."""

    def __init__(self, codes: np.ndarray):
        self.codes, self.parts = codes, codes.shape[1]
        self.order = [np.argsort(codes[:, p], kind="stable") for p in range(self.parts)]
        self.values = [np.unique(codes[:, p], return_counts=True) for p in range(self.parts)]

    def within(self, query: np.ndarray, radius: int) -> np.ndarray:
        """Rows whose code is within ``radius`` of ``query``: all of them, since then some substring is
        within radius / parts. Buckets are probed one by one, or all compared if there are fewer."""
        near = radius // self.parts
        hit = np.zeros(len(self.codes), bool)
        probes = _masks(near) if near <= 2 else None
        for p in range(self.parts):
            values, count = self.values[p]
            if probes is not None and len(probes) < len(values):
                wanted = probes ^ query[p]
                at = np.minimum(np.searchsorted(values, wanted), len(values) - 1)
                buckets = at[values[at] == wanted]
            else:
                buckets = np.flatnonzero(_ONES[values ^ query[p]] <= near)
            size, begin = count[buckets], (np.cumsum(count) - count)[buckets]
            rows = np.repeat(begin - (np.cumsum(size) - size), size) + np.arange(size.sum())
            hit[self.order[p][rows]] = True
        rows = np.flatnonzero(hit)
        return rows[_ONES[self.codes[rows] ^ query].sum(axis=1) <= radius]

    def search(self, query: np.ndarray, radius: int, least: int) -> np.ndarray:
        """``within``, with a radius that grows until ``least`` rows are found."""
        while True:
            rows = self.within(query, radius)
            if len(rows) >= min(least, len(self.codes)) or radius >= PART * self.parts:
                return rows
            radius = min(PART * self.parts, radius + self.parts)


def nearest_vectors(
    vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", query_every: int = 20, k: int = 20,
    bits: int = 128, sample_rows: int = 2000, share: float = 0.985, block_rows: int = 4096, query_rows: int = 4096,
) -> DataFrame:
    """The ``k`` largest inner products of each query with all other rows, as multi-index hashing finds them.

    Queries are the rows whose id is divisible by ``query_every``. Equal vectors are one entry of the
    index, with their k + 1 smallest ids: ties go to smaller ids, so no others can be in a result. Codes
    are learned from at most ``sample_rows`` vectors (the bound of what the driver gathers), and so is the
    Hamming radius that holds ``share`` of near neighbours; every vector is indexed. Blocks of the query
    set meet blocks of the index, each cell a bounded task; candidates are scored in
    double precision on the vectors as given. A query with fewer than k + 1 codes in the radius of a
    block takes a larger radius there, so no result is short of rows.

    Vectors that are null, zero, hold null or non-finite components, or are not of the commonest length take no
    part, as rows with a null id. Of rows that repeat an id each takes part. Columns: query_id
    long, rank int (from 1), vec_id long, score double. Other columns are ignored.
    """
    spark = vectors.sparkSession
    bounded_batches(spark)
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) | F.forall("v", lambda x: x == 0)
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.transform(F.col(vector_col), lambda x: x.cast("double") + F.lit(0.0)).alias("v"))
    rows = rows.filter(F.col("id").isNotNull() & F.col("v").isNotNull() & (F.size("v") > 0)).filter(~bad)
    sizes = rows.groupBy(F.size("v").alias("n")).agg(F.count("*").alias("rows")).orderBy(F.desc("rows"), F.desc("n")).limit(1).collect()
    if not sizes:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    rows = rows.filter(F.size("v") == sizes[0].n)
    few = rows.withColumn("r", F.row_number().over(Window.partitionBy("v").orderBy("id"))).filter(F.col("r") <= k + 1)
    entries = materialise(few.groupBy("v").agg(F.sort_array(F.collect_list("id")).alias("ids")).withColumn("rep", F.col("ids")[0]), "vectors")
    facts = entries.agg(F.count("*").alias("n"), F.max(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)).alias("square")).first()
    wanted = rows.filter(F.col("id") % query_every == 0)
    asked = materialise(wanted.join(entries.select("v", "rep"), "v").select("id", "rep"), "queries")
    queries = asked.select("rep").distinct()
    n_queries = queries.count()

    picked = bounded_sample(entries.select("rep", "v"), sample_rows, F.xxhash64("rep", F.lit(5))).collect()
    sample = np.array([r.v for r in sorted(picked, key=lambda r: r.rep)]).reshape(len(picked), -1)
    longest = float(np.sqrt(facts.square)) * (1 + 1e-12)
    codes = learn_codes(sample if len(sample) else np.eye(sizes[0].n), longest, bits)
    codes.radius = learn_radius(codes, sample, max(1, round(k * len(sample) / facts.n)), share) if len(sample) > 1 else bits
    shared, key = spark.sparkContext.broadcast(codes), uuid.uuid4().hex

    def cell(left: pa.Table, right: pa.Table) -> pa.Table:
        codes = state(key, lambda: shared.value)
        matrix = lambda t, c: t.column(c).combine_chunks().flatten().to_numpy().reshape(t.num_rows, -1)
        out: list = [np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)]
        if left.num_rows and right.num_rows:
            q, x, ids = matrix(left, "qv"), matrix(right, "v"), right.column("rep").to_numpy()
            index, found = MultiIndex(codes.encode(x, False)), []
            for vector, code, rep in zip(q, codes.encode(q, True), left.column("q").to_pylist(), strict=True):
                near = index.search(code, codes.radius, k + 1)
                score = (x[near] * vector).sum(axis=1)
                best = np.lexsort((ids[near], -score))[: k + 1]
                found.append((np.full(len(best), rep), ids[near[best]], score[best]))
            out = [np.concatenate(c) for c in zip(*found, strict=True)]
            give_back()
        return pa.table({"q": out[0], "rep": out[1], "score": out[2]})

    n_index, n_blocks = -(-facts.n // block_rows), -(-max(1, n_queries) // query_rows)
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = queries.join(entries.select("rep", "v"), "rep").select(F.col("rep").alias("q"), F.col("v").alias("qv"), F.pmod(F.xxhash64("rep"), F.lit(n_blocks)).cast("int").alias("qb"), every(n_index).alias("ib"))
    right = entries.select(F.col("rep").alias("rep"), F.col("v").alias("v"), F.pmod(F.xxhash64("rep"), F.lit(n_index)).cast("int").alias("ib"), every(n_blocks).alias("qb"))
    hits = left.groupBy("qb", "ib").cogroup(right.groupBy("qb", "ib")).applyInArrow(cell, "q long, rep long, score double")
    best = Window.partitionBy("q").orderBy(F.desc("score"), "rep")
    few = materialise(hits.withColumn("r", F.row_number().over(best)).filter(F.col("r") <= k + 1).select("q", "rep", "score"), "hits")
    spread = few.join(entries.select("rep", "ids"), "rep").select("q", "score", F.explode("ids").alias("id"))
    lists = spread.groupBy("q").agg(F.slice(F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("minus"), "id"))), 1, k + 1).alias("all"))
    placed = asked.join(lists, asked.rep == lists.q).select(F.col("id").alias("query_id"), F.slice(F.filter("all", lambda h: h["id"] != F.col("query_id")), 1, k).alias("all"))
    return placed.select("query_id", F.posexplode("all").alias("at", "h")).select("query_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("h.id").alias("vec_id"), (-F.col("h.minus")).alias("score"))
