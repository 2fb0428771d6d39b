"""Exact deduplication by progressive refinement: length, then prefix hash, then the hash of the whole text.

Texts are equal when they are identical after every white-space character of ``[\\x20\\x09-\\x0D]`` is deleted. Groups
of one by length are settled by a count; the rest are grouped by length and prefix hash; the whole text is hashed only
where that group still has more than one row. That is looked up in a broadcast while the keys of surviving groups fit one; beyond that every
row counts as surviving, since its hash costs less than a shuffle of its text. Groups are reduced map-side to one row before they are
shuffled. What goes is looked up by row numbers, which are spread evenly whatever the groups' sizes; the report joins
rows without their texts, and adaptive execution may split a group that holds a third of them.

Of equal texts the row with the most code points in the original text stays, then the smallest doc_id, then (repeated
rows) the first as stored, so exactly one row of a group stays.

Edge cases: null texts count as empty, and empty texts are equal to each other; a null doc_id sorts after all others;
an empty table gives an empty result; extra columns pass through ``deduplicate`` untouched whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fits, fresh, keep, small, store, temporary

PREFIX_CHARS = 64
_SPACES = " \t\n\v\f\r"


def normalised(text: Column) -> Column:
    """``text`` (null: empty) without white space. A chain of byte-level replacements beats a regular expression."""
    out = F.coalesce(text.cast("string"), F.lit(""))
    for c in _SPACES:
        out = F.replace(out, F.lit(c), F.lit(""))
    return out


def keyed(docs: DataFrame, names: dict[str, str], digest: bool) -> DataFrame:
    """``docs`` with norm, length, prefix hash and size of the original text; ``digest`` adds every row's SHA-256."""
    out = docs.withColumn(names["norm"], normalised(F.col("text")))
    norm = F.col(names["norm"])
    out = out.withColumns(
        {
            names["len"]: F.octet_length(norm).cast("long"),
            names["prefix"]: F.xxhash64(F.substring(norm, 1, PREFIX_CHARS)),
            names["size"]: F.length(F.coalesce(F.col("text").cast("string"), F.lit(""))).cast("long"),
        }
    )
    return out.withColumn(names["sha"], F.sha2(norm.cast("binary"), 256)) if digest else out


def _names(docs: DataFrame) -> dict[str, str]:
    return {k: fresh(f"_{k}", docs.columns) for k in ("norm", "len", "prefix", "size", "sha", "row", "full", "more", "group")}


def refine(docs: DataFrame, digest: bool = False, carry: bool = False) -> tuple[DataFrame, DataFrame, dict[str, str]]:
    """(rows, groups, column names): rows with the hash of the whole text where a group of more than one is left.

    ``carry``: rows keep the columns of ``docs``; otherwise only doc_id.
    """
    names = _names(docs)
    carried = docs.columns if carry else ["doc_id"]
    by_length, by_prefix = [names["len"]], [names["len"], names["prefix"]]
    with temporary():
        # rows are counted map-side by both keys; lengths are settled on the counts, so a common length is a row for each of its prefixes
        counts = store(keyed(docs, names, False).groupBy(*by_prefix).agg(F.count(F.lit(1)).alias("n_")), "dedup-counts")
        lengths = counts.groupBy(*by_length).agg(F.sum("n_").alias("n_")).where("n_ > 1").select(*by_length)
        prefixes = store(counts.join(lengths, by_length, "left_semi").where("n_ > 1").select(*by_prefix), "dedup-prefixes")
        rows = keyed(docs, names, digest)
        if fits(prefixes):
            rows = rows.join(F.broadcast(prefixes.withColumn(names["more"], F.lit(True))), by_prefix, "left")
        else:
            rows = rows.withColumn(names["more"], F.lit(True))
        full = F.when(F.col(names["more"]), F.col(names["sha"]) if digest else F.sha2(F.col(names["norm"]).cast("binary"), 256))
        rows = rows.withColumn(names["full"], full).withColumn(names["row"], F.monotonically_increasing_id())
        rows = store(rows.select(*carried, names["row"], names["size"], names["full"], *([names["sha"]] if digest else [])), "dedup-rows", keep=True)
    first = F.struct((-F.col(names["size"])).alias("s"), F.col("doc_id").isNull().alias("n"), F.col("doc_id").alias("doc_id"), F.col(names["row"]).alias("row"))
    groups = (
        rows.where(F.col(names["full"]).isNotNull())
        .groupBy(names["full"])
        .agg(F.min(first).alias("first_"), F.count(F.lit(1)).alias("n_"))
        .where("n_ > 1")
        .select(names["full"], F.struct(F.col("first_.doc_id").alias("keep_id"), F.col("first_.row").alias("row"), F.col("n_").alias("n")).alias(names["group"]))
    )
    return rows, store(groups, "dedup-groups"), names


def exact_groups(docs: DataFrame, digest: bool = False) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, keep_id, group_size, kept, and text_sha256 if ``digest``."""
    rows, groups, names = refine(docs, digest)
    group = F.col(names["group"])
    # rows that share a text with no other have keys of their own, so that they don't meet in one task
    key = F.coalesce(F.col(names["full"]), F.col(names["row"]).cast("string"))
    return rows.withColumn(names["full"], key).join(small(groups), names["full"], "left").select(
        F.col("doc_id"),
        F.when(group.isNull(), F.col("doc_id")).otherwise(group["keep_id"]).alias("keep_id"),
        F.coalesce(group["n"], F.lit(1)).cast("long").alias("group_size"),
        F.coalesce(group["row"] == F.col(names["row"]), F.lit(True)).alias("kept"),
        *([F.col(names["sha"]).alias("text_sha256")] if digest else []),
    )


def deduplicate(docs: DataFrame) -> DataFrame:
    """``docs`` without the rows that an equal text stands for; all columns as they were."""
    with temporary():
        rows, groups, names = refine(docs, carry=True)
        rows = keep(rows, "dedup-rows")
        slim = rows.where(F.col(names["full"]).isNotNull()).select(names["row"], names["full"])
        gone = slim.join(small(groups), names["full"]).where(F.col(names["group"])["row"] != F.col(names["row"])).select(names["row"])
        gone = store(gone, "dedup-gone", keep=True)
    return rows.join(small(gone), names["row"], "left_anti").select(*docs.columns)
