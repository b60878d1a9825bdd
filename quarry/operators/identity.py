"""Which records are one entity, and what the entity keeps of them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.functions.text import host, host_suffixes, identity_keys
from quarry.operators.components import connected_components
from quarry.storage import broadcast_if_small


def duplicate_components(records: DataFrame, id_col: str = "ev_id", max_key_rows: int | None = None) -> DataFrame:
    """``id_col`` and the smallest id of its entity: records that share any identity key, in any order, are one.

    Every key links its records to its smallest one, so a key that very many records share costs one edge for each.
    ``max_key_rows`` sets aside keys of boilerplate titles; without it all keys count.
    """
    keys = records.select(F.col(id_col).alias("id"), F.explode(identity_keys(F.col("url"), F.col("title"))).alias("key"))
    heads = keys.groupBy("key").agg(F.min("id").alias("head"), F.count("*").alias("size")).filter("size > 1")
    if max_key_rows is not None:
        heads = heads.filter(F.col("size") <= max_key_rows)
    parts = connected_components(keys.join(heads, "key").select(F.col("id").alias("src"), F.col("head").alias("dst")))
    return records.select(id_col).join(parts, F.col(id_col) == F.col("id"), "left").select(id_col, F.coalesce("component", F.col(id_col)).alias("component"))


def merge_entities(records: DataFrame, components: DataFrame, id_col: str = "ev_id") -> DataFrame:
    """One row for each entity: most citations, first date, longest content, best tier; all else from the first arrival."""
    rows = records.join(components, id_col)
    dated = F.col("publication_date") != ""
    return rows.groupBy("component").agg(
        F.count("*").alias("n_records"), F.max("citation_count").alias("citation_count"), F.coalesce(F.min_by("publication_date", F.when(dated, F.col("arrival"))), F.lit("")).alias("publication_date"),
        F.max_by("content", F.struct(F.length("content"), -F.col("arrival"))).alias("content"), F.min("reliability_tier").alias("reliability_tier"),
        F.min_by(F.struct("title", "url", "source_type"), "arrival").alias("first"),
    ).select("component", "n_records", "citation_count", "publication_date", "content", "reliability_tier", "first.title", "first.url", "first.source_type")


def host_filter(rows: DataFrame, domains: DataFrame, url_col: str = "url", keep_listed: bool = False, broadcast_rows: int = 1_000_000) -> DataFrame:
    """Rows whose host isn't a listed domain or below one (with ``keep_listed``: only those that are). Rows without a host aren't listed.

    Each host that occurs is looked up once: its few suffixes meet ``domains`` (a column ``domain``, of any length) by equality, and rows meet the
    hosts that were found. What is found is broadcast if it is small, after it has been measured.
    """
    hosts = rows.select(host(F.col(url_col)).alias("_host")).filter("_host is not null").distinct()
    suffixes = hosts.select("_host", F.explode(host_suffixes(F.col("_host"))).alias("domain"))
    listed = suffixes.join(broadcast_if_small(domains.select("domain").distinct(), broadcast_rows), "domain", "left_semi").select("_host").distinct()
    met = rows.withColumn("_host", host(F.col(url_col))).join(broadcast_if_small(listed, broadcast_rows), "_host", "left_semi" if keep_listed else "left_anti")
    return met.select(*rows.columns)


def first_arrivals(rows: DataFrame, keys: list[str], order: str = "arrival") -> DataFrame:
    """The first row of each key by ``order``, found by a pre-aggregated minimum."""
    rest = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.min_by(F.struct(*rest), order).alias("r")).select(*keys, *(F.col(f"r.{c}").alias(c) for c in rest))
