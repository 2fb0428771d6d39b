"""Pairs inside blocks: a join on the blocks' keys in which a hot block is dealt to many tasks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows of one side of a block that one task takes at most, about; there is a broadcast row for so many rows at least.
BLOCK_ROWS = 20_000


def pairs_in_blocks(left: DataFrame, right: DataFrame, left_keys: list[str], right_keys: list[str], on: Column, deal_by: str, rows: int | None = None) -> DataFrame:
    """Inner join on equal keys and ``on``. Blocks of more than ``rows`` left rows are cut into parts, and their right rows copied to each.

    ``deal_by``: the left column that says which part a row goes to. Null keys match nothing. Columns of the two sides must differ in name.
    Pairs are many and dear to score where their rows are few bytes, so the left side's partitions aren't coalesced.
    """
    rows = rows or BLOCK_ROWS
    tasks = int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = [f"__h{i}" for i in range(len(left_keys))]
    sizes = left.groupBy(*(F.col(c).alias(k) for c, k in zip(left_keys, keys))).agg(F.count(F.lit(1)).alias("__n")).where(F.col("__n") > rows)
    hot = F.broadcast(sizes.select(*keys, F.ceil(F.col("__n") / rows).cast("int").alias("__parts")))

    def with_parts(side: DataFrame, names: list[str]) -> DataFrame:
        same = F.lit(True)
        for c, k in zip(names, keys):
            same = same & (F.col(c) == F.col(k))
        return side.join(hot, same, "left").drop(*keys).withColumn("__parts", F.coalesce("__parts", F.lit(1)))

    cut = with_parts(left, left_keys).withColumn("__part", F.pmod(F.xxhash64(deal_by), F.col("__parts"))).drop("__parts").repartition(tasks, *left_keys, "__part")
    copied = with_parts(right, right_keys).withColumn("__copy", F.explode(F.sequence(F.lit(0), F.col("__parts") - 1))).drop("__parts")
    met = F.col("__part") == F.col("__copy")
    for a, b in zip(left_keys, right_keys):
        met = met & (F.col(a) == F.col(b))
    return cut.join(copied, met & on).drop("__part", "__copy")
