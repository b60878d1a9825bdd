"""Jaccard join of documents on word n-grams by blocked sparse products of the incidence matrix."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm.minhash import set_digests, shingle_sets
from quarry.llm.words import slices
from quarry.llm.worker import bounded_batches, tidy
from quarry.operators.components import connected_components
from quarry.storage import broadcast_if_small, materialise

#: Increments of overlap counts that are laid out at a time.
EXPANSION = 1 << 21


class Bounds:
    """What sizes say about pairs with 100 * |A and B| >= percent * |A or B|.

    N-grams are in the order of their hashes. Of a set of n the first ``sample`` are looked at; any partner shares at least ``least`` of
    these, all of which it has in its own sample. For, of the common n-grams, which are at least
    percent of the larger set, the first k lie within the first n - ceil(n * percent / 100) + k.
    """

    def __init__(self, percent: int):
        self.percent = percent

    def extra(self, n):
        return n // 20 + 1

    def sample(self, n: np.ndarray) -> np.ndarray:
        return np.minimum(n, n + self.percent * n // -100 + self.extra(n))

    def least(self, n: Column) -> Column:
        """Smallest partners look at the fewest."""
        return (F.floor(F.ceil(n * self.percent / 100) / 20) + 1).cast("int")

    def fits(self, n: Column, m: Column) -> Column:
        return 100 * F.least(n, m) >= self.percent * F.greatest(n, m)

    def size_class(self, n: Column) -> Column:
        """Sets that can reach the similarity are in one class or in neighbouring ones."""
        return F.floor(F.log(n.cast("double")) / math.log(100 / (self.percent - 1)))

    def reached(self, counts: np.ndarray, n: np.ndarray, m: np.ndarray) -> np.ndarray:
        return (counts > 0) & ((100 + self.percent) * counts >= self.percent * (n[:, None] + m[None, :]))


def overlap_counts(left: tuple[np.ndarray, np.ndarray], right: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """The product of two blocks of the incidence matrix: how many n-grams each set on the left shares with each on the right.

    A block is its sets' n-grams, end to end, and where each set begins. Columns that only one block has are dropped. Columns
    that many sets have are multiplied as dense strips, the rest pair by pair from its posting lists.
    """
    rows = [np.repeat(np.arange(len(o) - 1), np.diff(o)) for _, o in (left, right)]
    shape = len(left[1]) - 1, len(right[1]) - 1
    columns = np.intersect1d(left[0], right[0])
    counts = np.zeros(shape, np.int64)
    if not len(columns):
        return counts
    entries = []
    for (value, _), row in zip((left, right), rows, strict=True):
        at = np.searchsorted(columns, value)
        at[at == len(columns)] = 0
        there = columns[at] == value
        order = np.argsort(at[there], kind="stable")
        entries.append((at[there][order], row[there][order]))
    widths = [np.bincount(c, minlength=len(columns)) for c, _ in entries]
    dense = widths[0] * widths[1] * 32 > shape[0] * shape[1]
    for strip in np.array_split(np.flatnonzero(dense), -(-int(dense.sum()) // 2048) or 1):
        place = np.full(len(columns), -1)
        place[strip] = np.arange(len(strip))
        parts = []
        for (c, r), size in zip(entries, shape, strict=True):
            here = place[c] >= 0
            block = np.zeros((size, len(strip)), np.float32)
            block[r[here], place[c[here]]] = 1
            parts.append(block)
        counts += (parts[0] @ parts[1].T).astype(np.int64)
    start = np.concatenate([[0], np.cumsum(widths[1])])
    c, r = (x[~dense[entries[0][0]]] for x in entries[0])
    times = widths[1][c]
    ends = np.cumsum(times)
    a = 0
    while a < len(c):
        b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + EXPANSION, side="right")))
        n = times[a:b]
        within = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        partner = entries[1][1][np.repeat(start[c[a:b]], n) + within]
        counts += np.bincount(np.repeat(r[a:b], n) * shape[1] + partner, minlength=counts.size).reshape(shape)
        a = b
    return counts


def _spanning(pairs: np.ndarray, n: int) -> list[tuple[int, int]]:
    """At most n - 1 of the pairs, which connect what all of them do."""
    parent, kept = list(range(n)), []

    def find(x: int) -> int:
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        return x

    for a, b in pairs.tolist():
        x, y = find(a), find(b)
        if x != y:
            parent[max(x, y)] = min(x, y)
            kept.append((a, b))
    return kept


def cell_links(ids: list[np.ndarray], sets: list[list[np.ndarray]], bounds: Bounds) -> list[tuple[int, int]]:
    """Links of a cell: of its left sets with its right ones or, if it has no right ones, among the left; not more than it has sets."""
    alone = not len(ids[1])
    blocks = [(np.concatenate(s), np.concatenate([[0], np.cumsum([len(x) for x in s])])) for s in (sets[:1] * 2 if alone else sets)]
    sizes = [np.diff(o) for _, o in blocks]
    found = bounds.reached(overlap_counts(*blocks), *sizes)
    left, right = np.nonzero(np.triu(found, 1) if alone else found)
    names = ids[0] if alone else np.concatenate(ids)
    pairs = np.stack([left, right if alone else right + len(ids[0])], axis=1)
    return [(int(names[a]), int(names[b])) for a, b in _spanning(pairs, len(names)) if names[a] != names[b]]


def _meta(docs: DataFrame, width: int, bounds: Bounds) -> DataFrame:
    """Size, digest and the sample of every set."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for a, b in slices(texts):
                value, offsets = shingle_sets(texts[a:b], width)
                n = np.diff(offsets)
                within = np.arange(len(value)) - np.repeat(offsets[:-1], n)
                take = within < np.repeat(bounds.sample(n), n)
                at = np.concatenate([[0], np.cumsum(bounds.sample(n))]).astype(np.int32)
                digest = set_digests(value, offsets)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(n, pa.int64()), *map(pa.array, digest), pa.ListArray.from_arrays(pa.array(at), pa.array(value[take].view(np.int64)))], ["id", "n", "h1", "h2", "sample"])

    return docs.mapInArrow(tidy(build), "id long, n long, h1 long, h2 long, sample array<long>")


def _full(docs: DataFrame, width: int) -> DataFrame:
    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for a, b in slices(texts):
                value, offsets = shingle_sets(texts[a:b], width)
                digest = set_digests(value, offsets)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), *map(pa.array, digest), pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(value.view(np.int64)))], ["id", "h1", "h2", "members"])

    return docs.mapInArrow(tidy(build), "id long, h1 long, h2 long, members array<long>")


def _postings(rows: DataFrame, bounds: Bounds, name: str) -> DataFrame:
    """Rows (token, docs, id, n, part) on which every pair of different parts that can be linked meets at least once, from all rows (token, id, n, part) of the samples.

    Tokens that one part alone has link nothing. A set with fewer than ``least`` of the others is out; of the rest it can do without
    all but the first of its ``least`` commonest, as the rarest common one of a pair is not among them. So what very many
    texts share brings together only those that consist of such.
    """
    # written first, so that both sides of the join are plain exchanges and Spark can split a hot token
    counts = materialise(rows.groupBy("token").agg(F.count("*").alias("docs"), F.min("part").alias("low"), F.max("part").alias("high")).filter("low < high").select("token", "docs"), f"{name}_counts")
    least = bounds.least(F.col("n"))
    held = rows.join(counts, "token").groupBy("id", "n", "part").agg(F.sort_array(F.collect_list(F.struct("docs", "token"))).alias("t")).filter(F.size("t") >= least)
    first = F.explode(F.slice("t", F.lit(1), F.size("t") - least + 1)).alias("x")
    return materialise(held.select("id", "n", "part", first).select("x.token", "x.docs", "id", "n", "part"), name)


class Cells:
    """Blocks of sets that are multiplied with one another in one go; ``members`` bounds the n-grams of a side."""

    def __init__(self, sets: DataFrame, bounds: Bounds, members: int):
        self.sets, self.bounds, self.members = sets, bounds, members

    def _pieces(self, n: Column, rows: Column, most: int) -> Column:
        return F.greatest(F.ceil(rows * n / self.members), F.ceil(rows / most))

    def of_pairs(self, pairs: DataFrame) -> DataFrame:
        """Pairs (a, n, b) as cells of one set ``a`` against pieces of its partners."""
        sized = materialise(pairs.groupBy("a", "n").agg(F.count("*").alias("rows")), "heads").withColumn("pieces", self._pieces(F.col("n") * 1.2, F.col("rows"), 512))
        right = pairs.join(sized.select("a", "pieces"), "a").select(F.xxhash64("a", F.pmod(F.xxhash64("b"), "pieces")).alias("cell"), F.lit(1).alias("side"), F.col("b").alias("id"))
        left = sized.select("a", F.explode(F.sequence(F.lit(0).cast("long"), F.col("pieces") - 1)).alias("k")).select(F.xxhash64("a", "k").alias("cell"), F.lit(0).alias("side"), F.col("a").alias("id"))
        return left.union(right)

    def of_tokens(self, rows: DataFrame) -> DataFrame:
        """Rows (token, id, n) of common tokens as cells of two pieces each: pieces of one size class, or of neighbouring ones."""
        rows = rows.withColumn("s", self.bounds.size_class(F.col("n")))
        # tokens of just the same sets meet in the same cells
        lists = materialise(rows.groupBy("token").agg(F.count("*").alias("rows"), F.bit_xor(F.xxhash64("id")).alias("x"), F.bit_xor(F.xxhash64("id", F.lit(5))).alias("y")), "lists")
        rows = rows.join(lists.groupBy("rows", "x", "y").agg(F.min("token").alias("token")).select("token"), "token", "left_semi")
        sized = materialise(rows.groupBy("token", "s").agg(F.count("*").alias("rows"), F.max("n").alias("top")).withColumn("pieces", self._pieces(F.col("top"), F.col("rows"), 1024)).select("token", "s", "pieces"), "size_classes")
        near = sized.select("token", F.explode(F.array(F.col("s") - 1, F.col("s"), F.col("s") + 1)).alias("s"), F.col("s").alias("other"), F.col("pieces").alias("others"))
        mine = rows.join(sized, ["token", "s"]).withColumn("k", F.pmod(F.xxhash64("id"), "pieces"))
        met = mine.join(near, ["token", "s"]).withColumn("j", F.explode(F.sequence(F.lit(0).cast("long"), F.col("others") - 1)))
        first, second = F.struct("s", "k"), F.struct(F.col("other").alias("s"), F.col("j").alias("k"))
        cell = F.xxhash64("token", F.least(first, second), F.greatest(first, second))
        return met.select(cell.alias("cell"), (first > second).cast("int").alias("side"), "id")

    def links(self, cells: DataFrame) -> DataFrame:
        """(a, b) that connect whatever pairs of the cells reach the similarity."""
        bounds = self.bounds

        def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            at, ids, sets = None, [[], []], [[], []]

            def close() -> list[tuple[int, int]]:
                return cell_links([np.array(x, np.int64) for x in ids], sets, bounds) if at is not None and ids[0] else []

            for batch in batches:
                done = []
                members = batch.column(3)
                value, offsets = members.values.to_numpy(), members.offsets.to_numpy()
                for k, (cell, side, i) in enumerate(zip(*(batch.column(c).to_pylist() for c in range(3)), strict=True)):
                    if cell != at:
                        done += close()
                        at, ids, sets = cell, [[], []], [[], []]
                    ids[side].append(i)
                    sets[side].append(value[offsets[k] : offsets[k + 1]].copy())
                yield _pairs(done)
            yield _pairs(close())

        rows = cells.join(self.sets.select("id", "members"), "id").select("cell", "side", "id", "members")
        return rows.repartition("cell").sortWithinPartitions("cell", "side").mapInArrow(tidy(multiply), "a long, b long")


def _pairs(pairs: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([p[k] for p in pairs], pa.int64()) for k in (0, 1)], ["a", "b"])


def ngram_components(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 4, percent: int = 85,
    few: int = 64, members: int = 1 << 20, broadcast_rows: int = 500_000,
) -> DataFrame:
    """Components of documents whose sets of ``width``-word n-grams have 100 * |A and B| >= percent * |A or B|, without losing a link.

    Words are runs without ASCII white space, A-Z in lower case; a text with fewer than ``width`` words is one n-gram; a null or blank
    text has none and is linked with nothing. Columns: ``id_col`` (long), n_shingles long, component_id long (smallest id reachable).

    1. Equal sets are one, represented by its smallest id. A fifth of each set, the n-grams of smallest hash, says
       which sets can have a partner (``Bounds``), and on which of these n-grams every pair that can be linked meets.
    2. Sets are multiplied with the smallest one of their size class that has the n-gram; components of these links follow, so a
       group of copies costs a row for each.
    3. On what is left between components the same bounds are taken again. N-grams of at most ``few`` sets give pairs; sets that meet
       on commoner ones are dealt in blocks of at most about ``members`` n-grams, and pairs of blocks multiplied.

    Overlaps are counted on whole sets as products of blocks of the document by n-gram matrix. Pairs are never emitted: a cell
    gives at most one link for each set that it holds. Blocks of k sets that share common n-grams but aren't linked are all multiplied with one another,
    which is quadratic in k, as an exact join of such sets is.

    Ids are meant to be unique; of rows that repeat an id the one whose set has the smallest digest stands for it, and all get its component. A row with a null id
    is linked with nothing and has no component_id. An empty table gives no rows; other columns are ignored.
    """
    bounded_batches(docs.sparkSession)
    bounds = Bounds(percent)
    texts = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").cast("binary").alias("body"))
    meta = materialise(_meta(texts, width, bounds), "samples")
    one = materialise(meta.filter("n > 0 and id is not null").groupBy("id").agg(F.min(F.struct("h1", "h2", "n")).alias("d")), "digests")
    classes = materialise(one.groupBy("d").agg(F.min("id").alias("rep")), "classes")
    reps = classes.select(F.col("rep").alias("id"), "d.h1", "d.h2")
    # smaller sets than this have only equal ones as partners
    large = reps.join(meta.filter((100 - percent) * F.col("n") >= percent).withColumnsRenamed({"h1": "of1", "h2": "of2"}), "id").filter("h1 = of1 and h2 = of2")
    rows = large.dropDuplicates(["id"]).select("id", "n", F.explode("sample").alias("token"))
    met = _postings(rows.withColumn("part", F.col("id")), bounds, "postings")

    s = bounds.size_class(F.col("n"))
    heads = materialise(met.groupBy("token", s.alias("s")).agg(F.min(F.struct("id", "n")).alias("head"), F.count("*").alias("size")).filter("size > 1").select("token", "s", "head"), "heads")
    stars = met.withColumn("s", s).join(heads, ["token", "s"]).select(F.col("head.id").alias("a"), F.col("head.n").alias("n"), F.col("id").alias("b"), F.col("n").alias("m"))
    stars = materialise(stars.filter("a <> b").filter(bounds.fits(F.col("n"), F.col("m"))).select("a", "n", "b").distinct(), "stars")
    involved = materialise(met.select("id").distinct().join(reps, "id"), "involved")
    sets = _full(texts.join(broadcast_if_small(involved.select("id"), broadcast_rows), "id", "left_semi"), width)
    sets = materialise(sets.join(broadcast_if_small(involved, broadcast_rows), ["id", "h1", "h2"], "left_semi").dropDuplicates(["id"]).select("id", "members"), "sets")
    cells = Cells(sets, bounds, members)
    links = materialise(cells.links(cells.of_pairs(stars)), "links")
    parts = connected_components(links, "a", "b").select("id", F.col("component").alias("of"))

    known = meta.join(broadcast_if_small(involved, broadcast_rows), ["id", "h1", "h2"], "left_semi").dropDuplicates(["id"]).join(parts, "id", "left")
    open_rows = materialise(known.select("id", "n", F.coalesce("of", "id").alias("part"), F.explode("sample").alias("token")), "open")
    rest = _postings(open_rows, bounds, "rest")
    left, right = (rest.filter(F.col("docs") <= few).select("token", *(F.col(c).alias(n) for c, n in zip(("id", "n", "part"), names, strict=True))) for names in (("a", "n", "of_a"), ("b", "m", "of_b")))
    pairs = left.join(right, "token").filter("a < b and of_a <> of_b").filter(bounds.fits(F.col("n"), F.col("m"))).select("a", "n", "b").distinct()
    done = stars.select("a", "b").union(stars.select("b", "a"))
    pairs = materialise(pairs.join(done, ["a", "b"], "left_anti"), "pairs")
    common = cells.of_tokens(rest.filter(F.col("docs") > few).select("token", "id", "n"))
    more = materialise(cells.links(cells.of_pairs(pairs).union(common)), "links")
    if more.limit(1).count():
        parts = connected_components(links.union(more), "a", "b").select("id", F.col("component").alias("of"))

    found = classes.join(parts, classes.rep == parts.id, "left").select("d", F.coalesce("of", "rep").alias("component"))
    placed = one.join(found, "d").select("id", "component")
    out = meta.select("id", "n").join(placed, "id", "left")
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.coalesce("component", "id")).otherwise(F.col("id")).alias("component_id"))


def components_sql(width: int = 4, percent: int = 85) -> str:
    """``ngram_components`` of documents in DuckDB SQL: all n-grams, all links, components by recursion."""
    return rf"""
    WITH RECURSIVE t AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
    g AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] ELSE list_transform(range(1, greatest(len(w) - {width - 1}, 1) + 1), lambda i: array_to_string(w[i:i + {width - 1}], ' ')) END) AS g FROM t),
    n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
    o AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS shared FROM g x JOIN g y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY ALL),
    l AS (SELECT a, b FROM o JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE 100 * shared >= {percent} * (p.n + q.n - shared)),
    r AS (SELECT doc_id AS id, doc_id AS seen FROM t UNION SELECT r.id, l.b FROM r JOIN l ON l.a = r.seen),
    k AS (SELECT id, min(seen) AS component_id FROM r GROUP BY id)
    SELECT t.doc_id, coalesce(n.n, 0) AS n_shingles, k.component_id FROM t JOIN k ON k.id = t.doc_id LEFT JOIN n ON n.doc_id = t.doc_id
    """
