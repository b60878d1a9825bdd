"""Benchmark decontamination by size-partitioned MinHash containment search, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.storage import broadcast_if_small, materialise

#: Items whose shingles go to a text in one row.
ITEMS_AT_A_TIME = 64


def word_array(text: Column) -> Column:
    """Runs of letters and digits, lower case."""
    return F.filter(F.split(F.lower(text.cast("string")), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def _runs(words: Column, width: int, of) -> Column:
    """``of`` applied to the first place of each run of ``width`` words; null in fewer words."""
    return F.when(F.size(words) >= width, F.transform(F.sequence(F.lit(0), F.size(words) - width), of))


def _text_of(words: Column, width: int):
    return lambda i: F.array_join(F.slice(words, i + 1, width), " ")


def _hash_of(hashes: Column, width: int):
    """A run's hash from those of its words, so that no run has to be built as a string."""
    return lambda i: F.xxhash64(*(F.get(hashes, i + j) for j in range(width)))


def _probes(hashes: Column, width: int) -> Column:
    return _runs(hashes, width, lambda i: F.struct(_hash_of(hashes, width)(i).alias("h"), F.lit(width).alias("m")))


def containment_matches(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text",
    width: int = 5, percent: int = 80, broadcast_rows: int = 1_000_000,
) -> DataFrame:
    """Pairs (``id_col``, item_id, n_shared, n_item, containment) where a text holds ``percent`` of an item's shingles or more.

    Shingles are runs of ``width`` words, and an item of fewer words is one shingle, which a text holds wherever these words stand in
    a row; containment is the share of an item's distinct shingles that
    the whole text has. Items are partitioned by size, in powers of two. Every item's sketch is its k smallest
    shingle hashes, with k set by its partition: one more than the largest item of the partition may
    lack. So a text that holds enough of an item holds at least one value of its sketch, at any
    length of the text: the search loses no pair, and candidates are then verified on the shingles themselves.

    Texts are scanned where they lie: words are hashed once, and runs are hashed from their words' hashes. The sketches are broadcast if they
    have at most ``broadcast_rows`` rows, which are counted first; larger ones are joined by shuffling on the hash.
    Items without words, and null texts, match nothing. Repeated item ids count as one item
    with the shingles of all; repeated document ids likewise. Rows with a null id take no part.
    """
    items = benchmark.filter(F.col(item_col).isNotNull()).select(F.col(item_col).alias("item"), word_array(F.col(item_text_col)).alias("w")).filter(F.size("w") > 0)
    items = items.withColumn("wh", F.transform("w", lambda x: F.xxhash64(x)))
    w, wh = F.col("w"), F.col("wh")
    run = lambda m: _runs(w, m, lambda i: F.struct(_hash_of(wh, m)(i).alias("h"), F.lit(m).alias("m"), _text_of(w, m)(i).alias("s")))
    shorter = F.coalesce(*(F.when(F.size("w") == m, run(m)) for m in range(1, width)), run(width))
    owned = items.select("item", F.explode(shorter).alias("x")).distinct()
    sized = materialise(owned.groupBy("item").agg(F.sort_array(F.collect_list("x")).alias("by_hash")).withColumn("n_item", F.size("by_hash")), "items")
    top = F.pow(F.lit(2.0), F.floor(F.log2(F.col("n_item").cast("double"))) + 1) - 1
    k = top - F.ceil(top * percent / 100) + 1
    sketches = sized.select("item", F.explode(F.slice("by_hash", F.lit(1), k.cast("int"))).alias("x")).select("x.h", "x.m", "item")
    # at most ``width`` numbers: how many words the shingles of items have
    widths = [r.m for r in sized.select(F.explode("by_hash.m").alias("m")).distinct().orderBy("m").collect()] or [width]

    texts = docs.filter(F.col(id_col).isNotNull()).select(F.col(id_col).alias("doc"), F.col(text_col).alias("body"))
    hashed = texts.select("doc", F.transform(word_array(F.col("body")), lambda x: F.xxhash64(x)).alias("wh"))
    probe = F.concat(*(F.coalesce(_probes(wh, m), F.array().cast("array<struct<h:bigint,m:int>>")) for m in widths))
    probes = hashed.select("doc", F.explode(probe).alias("x")).select("doc", "x.h", "x.m")
    candidates = materialise(probes.join(broadcast_if_small(sketches, broadcast_rows), ["h", "m"]).select("doc", "item").distinct(), "candidates")

    # the shingles of an item go to the texts that may hold it, some items at a time: a shingle that many items share brings no other items together with a text
    several = candidates.groupBy("doc").agg(F.ceil(F.count("*") / ITEMS_AT_A_TIME).alias("pieces"))
    asked = broadcast_if_small(sized.select("item", "n_item", F.col("by_hash.s").alias("strings")), broadcast_rows, 32 + F.aggregate("strings", F.lit(0), lambda n, x: n + 16 + F.octet_length(x)))
    pieces = candidates.join(asked, "item").join(several, "doc").groupBy("doc", F.pmod(F.xxhash64("item"), "pieces").alias("piece"))
    found = pieces.agg(F.collect_list(F.struct("item", "n_item", "strings")).alias("wanted"))
    size = F.aggregate("wanted", F.lit(16), lambda n, x: n + 32 + F.aggregate(x["strings"], F.lit(0), lambda k, y: k + 16 + F.octet_length(y)))
    # the words of candidates only: the join comes before the split
    near = texts.join(broadcast_if_small(found, broadcast_rows, size), "doc").select("doc", "wanted", word_array(F.col("body")).alias("w"))
    strings = F.concat(*(F.coalesce(_runs(w, m, _text_of(w, m)), F.array().cast("array<string>")) for m in widths))
    # the text's shingles are bound once for all items: as a column of their own they would be put into the function and made for each item again
    within = lambda has: F.transform("wanted", lambda x: F.struct(x["item"].alias("item"), x["n_item"].alias("n_item"), F.array_intersect(x["strings"], has).alias("both")))
    met = near.select("doc", F.explode(F.flatten(F.transform(F.array(F.array_distinct(strings)), within))).alias("x"))
    both = met.select("doc", "x.item", "x.n_item", F.explode("x.both").alias("s")).distinct()
    counted = both.groupBy("doc", "item", "n_item").agg(F.count("*").alias("n_shared")).filter(100 * F.col("n_shared") >= percent * F.col("n_item"))
    return counted.select(F.col("doc").alias(id_col), F.col("item").alias("item_id"), "n_shared", F.col("n_item").cast("long").alias("n_item"), (F.col("n_shared") / F.col("n_item")).alias("containment"))


def flag_contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """One row for each row of ``docs``: ``id_col``, contaminated boolean, n_items long, and the item_id of largest
    containment (the smaller id on a tie) with that containment; null where nothing matched. A row with a null id is known by its
    text instead, so it is flagged like any other. Takes the options of ``containment_matches``."""
    text_col = options.get("text_col", "text")
    key = F.coalesce(F.concat(F.lit("i"), F.col(f"`{id_col}`").cast("string")), F.concat(F.lit("t"), F.sha2(F.col(f"`{text_col}`").cast("binary"), 256)))
    keyed = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("body"), key.alias("key"))
    matches = containment_matches(keyed, benchmark, "key", **options | {"text_col": "body"})
    best = matches.groupBy(F.col("key").alias("_doc")).agg(
        F.count("*").alias("n_items"), F.min_by(F.struct("item_id", "containment"), F.struct(-F.col("containment"), F.col("item_id"))).alias("best")
    )
    out = keyed.select("id", "key").join(best, F.col("key") == F.col("_doc"), "left")
    return out.select(F.col("id").alias(id_col), F.col("n_items").isNotNull().alias("contaminated"), F.coalesce("n_items", F.lit(0)).alias("n_items"), F.col("best.item_id").alias("item_id"), F.col("best.containment").alias("containment"))


def contamination_sql(width: int = 5, percent: int = 80) -> str:
    """``flag_contaminated`` of documents and benchmark in DuckDB SQL: all shingles, no sketches."""
    words = r"list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda w: w <> '')"
    run = "unnest(list_transform(range(1, len(w) - m + 2), lambda i: array_to_string(w[i:i + m - 1], ' ')))"
    return f"""
    WITH i AS (SELECT item_id, w, least(len(w), {width}) AS m FROM (SELECT item_id, {words} AS w FROM benchmark WHERE item_id IS NOT NULL) WHERE len(w) > 0),
    b AS (SELECT DISTINCT item_id, {run} AS s FROM i),
    n AS (SELECT item_id, count(*) AS n_item FROM b GROUP BY item_id),
    d AS (SELECT DISTINCT doc_id, {run} AS s FROM (SELECT doc_id, {words} AS w FROM documents), (SELECT DISTINCT m FROM i) WHERE len(w) >= m),
    m AS (SELECT doc_id, item_id, count(*) AS shared, any_value(n_item) AS n_item FROM d JOIN b USING (s) JOIN n USING (item_id) GROUP BY doc_id, item_id),
    k AS (SELECT doc_id, item_id, shared / n_item AS containment, count(*) OVER (PARTITION BY doc_id) AS n_items,
          row_number() OVER (PARTITION BY doc_id ORDER BY shared / n_item DESC, item_id) AS r FROM m WHERE 100 * shared >= {percent} * n_item)
    SELECT doc_id, item_id IS NOT NULL AS contaminated, coalesce(n_items, 0) AS n_items, item_id, containment
    FROM documents LEFT JOIN (SELECT * FROM k WHERE r = 1) USING (doc_id)
    """
