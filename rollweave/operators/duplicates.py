"""Potential duplicates inside one table: exact groups, similar names in blocks, and what these links connect.

Rows become nodes of distinct (block, name); pairs of nodes are scored inside blocks by the similarity of their sorted
words, exact groups add one link for each member, and components give the clusters. A node's name is a digest of its block and name, so rows
need no number of their own to find their cluster, and nothing is checkpointed but links (and, where ids are made up, the rows these are
given to). A block's date of birth (and postcode) that is null or blank compares with nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import RowIdentityError, need_columns, need_frame
from ..functions import similarity as S
from ..functions.text import collapse, strip
from ..plans.session import checkpoint
from .blocks import pairs_in_blocks
from .components import connected_components

# Names of the result's columns.
RESULT = "Potential Duplicates"
OWN_ID = "Duplicate ID"


def with_ordinal(df: DataFrame, name: str, order_by: list[str] | None = None) -> DataFrame:
    """``df`` with row numbers from 1, in the order of ``order_by`` (or as stored), counted partition by partition."""
    if order_by:
        parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        df = df.repartitionByRange(parts, *order_by).sortWithinPartitions(*order_by)
    rows = checkpoint(df.withColumns({"__part": F.spark_partition_id(), "__at": F.monotonically_increasing_id()}))
    sizes = rows.groupBy("__part").agg(F.count(F.lit(1)).alias("__n"), F.min("__at").alias("__first"))
    before = sizes.select("__part", "__first", (F.sum("__n").over(Window.orderBy("__part")) - F.col("__n")).alias("__before"))  # a row a partition
    placed = rows.join(F.broadcast(before), "__part")
    return placed.withColumn(name, (F.col("__before") + F.col("__at") - F.col("__first") + 1).cast("long")).drop("__part", "__at", "__first", "__before")


def find_duplicates(df: DataFrame, name_col: str | list[str], dob_col: str, postcode_col: str, id_col: str | None = None, threshold: float = 80, fuzzy_type: str = "permissive", twin_protection: bool = True, twin_threshold: float = 70, order_by: list[str] | None = None, check_ids: bool = False, ordered: bool = False) -> DataFrame:
    """``df`` with ``Potential Duplicates``: the sorted ids of a row's cluster joined by ``, ``, or null.

    ``strict`` blocks on date of birth and postcode, ``permissive`` on date of birth. Twin protection takes away pairs whose first
    names are less alike than ``twin_threshold``; exact groups aren't affected. String key columns come back stripped
    and collapsed, null as empty. Without ``id_col`` rows get ``#1``, ``#2``, ... in the order of ``order_by`` or as stored.
    ``ordered``: rows come by clusters and ids, both descending, at the price of a global sort.
    """
    need_frame(df, "df")
    if not 0 <= threshold <= 100:
        raise ValueError("threshold must lie between 0 and 100")
    if fuzzy_type not in ("strict", "permissive"):
        raise ValueError("fuzzy_type must be 'strict' or 'permissive'")
    names = [name_col] if isinstance(name_col, str) else list(name_col)
    keys = [*names, dob_col, postcode_col]
    need_columns(df, [*keys, *([id_col] if id_col else [])], "the table")
    if check_ids and id_col and df.groupBy(f"`{id_col}`").count().where("count > 1").limit(1).count():
        raise RowIdentityError(f"{id_col!r} isn't unique")

    q = lambda c: F.col(f"`{c}`")
    joined = F.concat_ws(" ", *(F.coalesce(q(c).cast("string"), F.lit("")) for c in names)) if not isinstance(name_col, str) else q(name_col).cast("string")
    rows = df.withColumn("__name", joined)
    text = [c for c in keys if isinstance(df.schema[c].dataType, T.StringType)]
    rows = rows.withColumns({c: F.coalesce(collapse(strip(q(c))), F.lit("")) for c in dict.fromkeys(text)})
    if id_col is None:
        id_col, rows = OWN_ID, with_ordinal(rows, "__row", order_by)
        rows = rows.withColumn(OWN_ID, F.concat(F.lit("#"), F.col("__row"))).drop("__row")
    block = [dob_col] + ([postcode_col] if fuzzy_type == "strict" else [])
    compared = F.lit(True)
    for c in block:
        compared = compared & q(c).isNotNull() & (q(c).cast("string") != "")
    # what rows of one node share; the name as it was before cleaning decides the score
    key = F.to_json(F.struct(*(q(c).cast("string").alias(f"b{i}") for i, c in enumerate(block)), F.col("__name").alias("n")))
    rows = rows.withColumn("__node", F.when(compared, F.md5(key)))
    slim = rows.where(F.col("__node").isNotNull()).select("__node", "__name", *(q(c).alias(f"__b{i}") for i, c in enumerate(block)), F.struct(*(F.coalesce(q(c).cast("string"), F.lit("")) for c in keys)).alias("__exact"))
    b = [f"__b{i}" for i in range(len(block))]
    of_node = slim.groupBy("__node", "__name", *b, "__exact").agg(F.count(F.lit(1)).alias("__n"))

    nodes = of_node.where(F.col("__name").isNotNull()).select("__node", "__name", *b).distinct()
    named = nodes.select(*b, "__node", S.prepared(S.sorted_tokens("__name")).alias("__p"), S.prepared(F.substring_index("__name", " ", 1)).alias("__f"))
    left = named.withColumnsRenamed({"__node": "u", "__p": "pu", "__f": "fu"})
    right = named.withColumnsRenamed({"__node": "v", "__p": "pv", "__f": "fv"} | {c: c + "r" for c in b})
    on = (F.col("u") < F.col("v")) & S.may_reach(F.col("pu"), F.col("pv"), threshold)
    pairs = S.with_common(pairs_in_blocks(left, right, b, [c + "r" for c in b], on, "u"), F.col("pu"), F.col("pv"), "__lcs").where(S.reaches(F.col("__lcs"), F.col("pu"), F.col("pv"), threshold))
    if twin_protection:
        pairs = S.with_common(pairs, F.col("fu"), F.col("fv"), "__first")
        alike = F.when((F.col("fu")["size"] + F.col("fv")["size"]) == 0, F.lit(100 >= twin_threshold)).otherwise(S.reaches(F.col("__first"), F.col("fu"), F.col("fv"), twin_threshold))
        pairs = pairs.where(alike)
    links = pairs.select("u", "v")
    groups = of_node.groupBy("__exact").agg(F.min("__node").alias("u"), F.max("__node").alias("w")).where("u < w")
    exact = of_node.join(groups, "__exact").select("u", F.col("__node").alias("v")).where("u != v").distinct()
    components = connected_components(links.unionByName(exact), "u", "v").select(F.col("node").alias("__node"), F.col("component").alias("__component"))
    # a cluster is several nodes, or one that several rows share; only their rows give ids
    sizes = of_node.groupBy("__node").agg(F.sum("__n").alias("__n")).join(components, "__node", "left")
    shared = sizes.where((F.col("__n") > 1) | F.col("__component").isNotNull()).select("__node", F.coalesce("__component", "__node").alias("__cluster"))
    clusters = rows.select("__node", q(id_col).cast("string").alias("__id")).join(shared, "__node").groupBy("__cluster").agg(F.array_join(F.array_sort(F.collect_list("__id")), ", ").alias(RESULT))
    told = shared.join(clusters, "__cluster").select("__node", RESULT)
    out = rows.join(told, "__node", "left")
    columns = [*df.columns, *([OWN_ID] if OWN_ID not in df.columns and id_col == OWN_ID else [])]
    if ordered:
        out = out.orderBy(F.coalesce(F.col(f"`{RESULT}`"), F.lit("")).desc(), q(id_col).cast("string").desc())
    return out.select(*(q(c) for c in columns), q(RESULT))


def exact_groups(df: DataFrame, columns: list[str]) -> DataFrame:
    """``df`` with ``group_size``: how many rows share the columns' values (null equals null).

    Sizes are counted map-side and joined back, so that a group's rows may be split between tasks.
    """
    need_columns(df, columns, "the table")
    keys = [f"__g{i}" for i in range(len(columns))]
    sizes = df.select(*(F.col(f"`{c}`").alias(k) for c, k in zip(columns, keys))).groupBy(*keys).agg(F.count(F.lit(1)).alias("group_size"))
    return df.join(sizes, [F.col(f"`{c}`").eqNullSafe(F.col(k)) for c, k in zip(columns, keys)]).drop(*keys)
