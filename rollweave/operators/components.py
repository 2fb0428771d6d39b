"""Connected components of an edge table by alternating star contractions.

Large-star and small-star steps (Kiveris et al., 2014) need a number of rounds that grows with the logarithm of the
longest chain. Minima are combined map-side before they are shuffled, joins of a hub's edges with its one minimum may be
split by adaptive execution, and each round is cut off by a reliable checkpoint.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.session import checkpoint


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).where("u != v").distinct()


def connected_components(edges: DataFrame, left: str, right: str, max_rounds: int = 100) -> DataFrame:
    """(node, component) for every node with an edge; the component is its smallest node.

    Edges with a null end and loops are ignored. Raises RuntimeError if ``max_rounds`` don't suffice.
    """
    now = edges.select(F.col(left).alias("u"), F.col(right).alias("v")).where("u != v").distinct()
    now, state = checkpoint(now), None
    for _ in range(max_rounds):
        now = checkpoint(_small_star(_large_star(now)))
        seen = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if seen == state:
            roots = now.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("component"))
            return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
        state = seen
    raise RuntimeError(f"components didn't settle in {max_rounds} rounds")
