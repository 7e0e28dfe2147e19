"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evgraph.session import stored


def _large_star(edges: DataFrame) -> DataFrame:
    """Every neighbour above a node is tied to the node's least neighbour (itself included)."""
    both = edges.unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    least = stored(both.groupBy("src").agg(F.min("dst").alias("m")).select("src", F.least("src", "m").alias("m")), "components-least")  # a bare join side: hot nodes can be split
    up = both.where("dst > src").hint("merge").join(least.hint("merge"), "src")
    return up.where("dst <> m").select(F.col("dst").alias("src"), F.col("m").alias("dst")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """A node and its lower neighbours are tied to the least of them; edges point downwards (src > dst)."""
    least = stored(edges.groupBy("src").agg(F.min("dst").alias("m")), "components-least")
    moved = edges.hint("merge").join(least.hint("merge"), "src").where("dst <> m").select(F.col("dst").alias("src"), F.col("m").alias("dst"))
    return moved.unionByName(least.select("src", F.col("m").alias("dst"))).distinct()


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst", max_rounds: int = 50) -> DataFrame:
    """(id, component) for every node that has an edge to another; component is the least id that can be reached.

    Ids may be of any ordered type. Self loops and nulls are ignored; repeated edges count once; no edges give no rows. Each round is
    written to the shared folder, so a lost executor costs one round. Rounds grow with the logarithm of the longest path.
    """
    e = edges.select(F.greatest(src, dst).alias("src"), F.least(src, dst).alias("dst")).where("src <> dst").distinct()
    e = stored(e, "components")
    before = None
    for _ in range(max_rounds):
        e = stored(_small_star(stored(_large_star(e), "components")), "components")
        now = tuple(e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("src", "dst").cast("decimal(38,0)"))).first())
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return e.select(F.col("src").alias("id"), F.col("dst").alias("component")).unionByName(e.select(F.col("dst").alias("id"), F.col("dst").alias("component")).distinct())
