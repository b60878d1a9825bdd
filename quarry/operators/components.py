"""Connected components of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.storage import materialise


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst", max_rounds: int = 60) -> DataFrame:
    """Smallest reachable id of every id that has an edge: columns id, component.

    Each round takes the smallest label among the neighbours and then the label's own label, so
    labels travel twice as far every round. Minima are pre-aggregated before the shuffle, rounds
    are cut by tables in the shared folder, and the end is found by a count. Loops, repeated edges
    and null ends are allowed; an edge with a null end is ignored.
    """
    kept = edges.select(F.col(src).alias("src"), F.col(dst).alias("dst")).filter("src is not null and dst is not null and src <> dst")
    both = materialise(kept.union(kept.select("dst", "src")).distinct(), "edges")
    labels = materialise(both.groupBy(F.col("src").alias("id")).agg(F.least(F.col("id"), F.min("dst")).alias("component")), "labels")
    for _ in range(max_rounds):
        offered = both.join(labels, both.dst == labels.id).groupBy("src").agg(F.min("component").alias("offer"))
        better = labels.join(offered, labels.id == offered.src).select("id", F.col("component").alias("was"), F.least("component", "offer").alias("label"))
        parents = labels.select(F.col("id").alias("label"), F.col("component").alias("above"))
        moved = materialise(better.join(parents, "label").select("id", "was", F.least("label", "above").alias("component")), "labels")
        labels = moved.select("id", "component")
        if not moved.filter("was <> component").limit(1).count():
            return labels
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
