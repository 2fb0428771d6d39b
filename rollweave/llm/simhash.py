"""SimHash near-duplicates through deletion-variant signatures.

A fingerprint of 64 bits is cut into three segments. If two fingerprints differ in at most four bits, one of the
segments differs in at most one, so a signature of that segment with one bit deleted is equal for both. Every distinct
fingerprint is filed under its 64 signatures (segment, deleted bit, remaining bits), equal signatures meet by a shuffle on
the signature, and members of a bucket are verified by their Hamming distance.

A bucket that would hold more than LARGE members is not searched but filed again: its members' bits outside the bucket's
segment are cut into three once more, with the same argument. A bucket is the union of two values of its segment, so counts of segment values (three rows a fingerprint, reduced map-side) tell beforehand which buckets may be
large, and the 64-fold rows are shuffled once.

In a bucket, a search from member to member visits each once and gives a spanning forest of the bucket's links, never all
pairs: a group of near copies costs its size. Exact copies are one fingerprint. Links become components by distributed
label propagation (``operators.components``). Nothing is capped and nothing of all documents goes to the driver.

Edge cases: texts without words have fingerprint zero and are linked like any other; null texts are empty; fewer words than
a shingle make one shingle of what there is; repeated rows share their fingerprint's component; a null doc_id is never the
name of a component unless it has no other; empty tables give empty results; extra columns aren't read.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import reduce
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.components import connected_components
from ..plans.session import find_package
from .common import chunks, fresh, short_batches, small, store, temporary

SHINGLE = 4
DISTANCE = 4
#: Buckets with more members are filed again under finer signatures: about where comparing members costs more than filing them.
LARGE = 50_000
#: How often a fingerprint is filed at most. Members of a large bucket of the last level share 34 bits or more: near copies of one another, which the search takes in few steps.
LEVELS = 2
_BLOCK = 1 << 14


def fingerprint(text: str | None, shingle: int = SHINGLE, seed: int = 42) -> int:
    """SimHash of the word shingles of a text; memory is bounded by its words, shingles go through in blocks."""
    import xxhash

    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: A-Z and ASCII white space alone
    if not words:
        return 0
    if len(words) < shingle:
        shingles, total = iter([b" ".join(words)]), 1
    else:
        shingles, total = map(b" ".join, zip(*(words[i:] for i in range(shingle)))), len(words) - shingle + 1
    ones, digest = np.zeros(64, np.int64), xxhash.xxh64_intdigest
    while block := [digest(s, seed) for s in islice(shingles, _BLOCK)]:
        bits = np.unpackbits(np.array(block, "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int32)
    return int(np.packbits(ones * 2 > total, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int = SHINGLE, name: str = "fp") -> DataFrame:
    """``docs`` with the fingerprint of ``text`` in a column ``name``: a long that holds the 64 bits, signed."""
    find_package(docs.sparkSession)
    text = docs.columns.index("text")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches):
            fps = np.array([fingerprint(t, shingle) for t in batch.column(text).to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(fps, pa.int64())], [*batch.schema.names, name])

    return docs.mapInArrow(run, docs.withColumn(name, F.lit(None).cast("long")).schema)


def cut(bits: int) -> list[tuple[int, int]]:
    """(first bit, bits) of the three segments of ``bits`` bits."""
    a = -(-bits // 3)
    b = -(-(bits - a) // 2)
    return [(0, a), (a, b), (a + b, bits - a - b)]


def _bits(of, first: int, bits: int):
    return of if bits == 64 else F.shiftrightunsigned(of, first).bitwiseAND(F.lit((1 << bits) - 1))


def _keys(part, first: int, width: int, top: bool) -> list:
    """Keys of the buckets of a segment's value: one for each deleted bit.

    A key names the bucket before, segment, deleted bit and what is left of the segment. Below the top it is a hash; two buckets
    that share one only make verification look at more members.
    """
    out = []
    for b in range(width):
        sig = part.bitwiseAND(F.lit(~(1 << b)).cast("long"))
        out.append(sig.bitwiseOR(F.lit((first + b) << 32).cast("long")) if top else F.xxhash64("key", F.lit(first + b), sig))
    return out


def file(rows: DataFrame, bits: int, top: bool) -> DataFrame:
    """Rows (fp, key, rest, bits) under each signature of ``rest``: a new key, and the ``bits`` bits outside its segment."""
    out = []
    for first, width in cut(bits):
        none = F.lit(0).cast("long")
        below, above = _bits(F.col("rest"), 0, first) if first else none, _bits(F.col("rest"), first + width, bits - first - width) if first + width < bits else none
        rest, left = below.bitwiseOR(F.shiftleft(above, first)), F.lit(bits - width)
        out += [F.struct(key.alias("key"), rest.alias("rest"), left.alias("bits")) for key in _keys(_bits(F.col("rest"), first, width), first, width, top)]
    return rows.select("fp", F.inline(F.array(*out)))


def large_buckets(rows: DataFrame, bits: int, top: bool, large: int) -> DataFrame:
    """Keys of ``file`` whose bucket may have more than ``large`` members: one of its two segment values has more than half of that."""
    values = F.array(*(F.struct(F.lit(first).alias("first"), _bits(F.col("rest"), first, width).alias("value")) for first, width in cut(bits)))
    often = rows.select("key", F.inline(values)).groupBy("key", "first", "value").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > large // 2)
    of_segments = (often.where(F.col("first") == first).select(F.explode(F.array(*_keys(F.col("value"), first, width, top))).alias("key")) for first, width in cut(bits))
    return reduce(DataFrame.unionByName, of_segments).distinct()


def _differing(a: np.ndarray, b) -> np.ndarray:
    """Differing bits; bits of a signed number would be counted in its absolute value."""
    return np.bitwise_count((a ^ b).view(np.uint64))


def _forest(members: np.ndarray, distance: int) -> tuple[list[int], list[int]]:
    """Links of a spanning forest of distinct fingerprints at ``distance`` bits or fewer."""
    left, a, b = members, [], []
    while len(left) > 1:
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            at = queue.pop()
            near = _differing(left, at) <= distance
            if near.any():
                found = left[near]
                left = left[~near]
                a += [int(at)] * len(found)
                b += found.tolist()
                queue += list(found)
    return a, b


def bucket_links(batches: Iterable[pa.RecordBatch], distance: int = DISTANCE) -> Iterator[pa.RecordBatch]:
    """Links (a, b) of rows (key, fp) that arrive sorted by key; one bucket is held at a time."""
    held: list[tuple[np.ndarray, np.ndarray]] = []

    def links() -> Iterator[pa.RecordBatch]:
        key, fps = (np.concatenate(c) for c in zip(*held))
        held.clear()
        starts = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
        sizes = np.diff(starts, append=len(key))
        pairs = starts[sizes == 2]
        near = pairs[_differing(fps[pairs], fps[pairs + 1]) <= distance]
        a, b = [fps[near]], [fps[near + 1]]
        for s, n in zip(starts[sizes > 2].tolist(), sizes[sizes > 2].tolist()):
            x, y = _forest(np.unique(fps[s : s + n]), distance)
            a.append(np.array(x, np.int64))
            b.append(np.array(y, np.int64))
        x, y = np.concatenate(a), np.concatenate(b)
        if len(x):
            one = np.unique(np.stack([np.minimum(x, y), np.maximum(x, y)], axis=1), axis=0)
            one = one[one[:, 0] != one[:, 1]]
            yield pa.RecordBatch.from_arrays([pa.array(one[:, 0]), pa.array(one[:, 1])], ["a", "b"])

    for batch in batches:
        key, fps = (batch.column(n).to_numpy(zero_copy_only=False) for n in ("key", "fp"))
        if not len(key):
            continue
        # the last bucket may go on in the next batch
        last = int(np.searchsorted(key, key[-1]))
        if last or held and held[-1][0][-1] != key[0]:
            held.append((key[:last], fps[:last]))
            yield from links()
        held.append((key[last:], fps[last:]))
    if held:
        yield from links()


def links(fps: DataFrame, distance: int = DISTANCE, large: int = LARGE, levels: int = LEVELS) -> DataFrame:
    """Links (a, b) between distinct fingerprints that connect whatever chains of links connect; a stored table."""
    if distance > 5:
        raise ValueError("three segments with one deleted bit find distances up to 5")
    spark = fps.sparkSession
    find_package(spark)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def met(filed: DataFrame) -> DataFrame:
        buckets = filed.select("key", "fp").repartition(parts, "key").sortWithinPartitions("key")
        return buckets.mapInArrow(lambda batches: bucket_links(batches, distance), "a long, b long")

    found = []
    with temporary():
        # a row makes 64: the few files of fingerprints are dealt to all tasks before they grow
        level = [(fps.select("fp", F.lit(0).cast("long").alias("key"), F.col("fp").alias("rest")).repartition(parts), 64)]
        for depth in range(levels):
            top, below = depth == 0, []
            for rows, bits in level:
                filed, hot = file(rows, bits, top), None
                widths = {bits - width for _, width in cut(bits)}
                if depth + 1 < levels and rows.count() > large // 2:
                    hot = store(large_buckets(rows, bits, top, large), "large-buckets")
                if hot is not None and not hot.isEmpty():
                    again = store(filed.join(small(hot), "key", "left_semi"), "filed-again")
                    below += [(again.where(F.col("bits") == w).select("fp", "key", "rest"), w) for w in sorted(widths)]
                    filed = filed.join(small(hot), "key", "left_anti")
                found.append(store(met(filed), "bucket-links"))
            level = below
        return store(reduce(DataFrame.unionByName, found).distinct(), "fingerprint-links", keep=True)


def _first_of_each(rows: DataFrame, fp: str, first, distance: int) -> DataFrame:
    """(fp, first): the smallest ``first`` of the component of every distinct fingerprint; a stored table."""
    with temporary():
        groups = store(rows.select(F.col(fp).alias("fp"), first.alias("first")).groupBy("fp").agg(F.min("first").alias("first")), "distinct-fingerprints")
        labels = store(connected_components(links(groups.select("fp"), distance), "a", "b").select(F.col("node").alias("fp"), F.col("component").alias("root")), "fingerprint-roots")
        # names are made before they are joined, so that the join may split a root that very many fingerprints have
        names = store(groups.join(labels, "fp").groupBy("root").agg(F.min("first").alias("named")), "component-names")
        named = store(labels.join(small(names), "root").select("fp", "named"), "linked-names")
        out = groups.join(small(named), "fp", "left").select("fp", F.coalesce("named", "first").alias("first"))
        return store(out, "named-fingerprints", keep=True)


def components(docs: DataFrame, distance: int = DISTANCE, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, fp, component_id) of every row of ``docs``; component_id is the smallest doc_id that links reach."""
    short = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    with short_batches(docs.sparkSession):
        rows = store(fingerprints(short, shingle).select("doc_id", "fp"), "fingerprints")
    named = _first_of_each(rows, "fp", F.struct(F.col("doc_id").isNull().alias("null"), F.col("doc_id").alias("doc_id")), distance)
    return rows.join(small(named), "fp").select("doc_id", "fp", F.col("first.doc_id").alias("component_id"))


def one_of_each(docs: DataFrame, distance: int = DISTANCE, shingle: int = SHINGLE) -> DataFrame:
    """``docs`` with one row of each component, of the smallest doc_id (of repeated rows, the first as stored); columns as they were.

    Rows are stored once with a number and their fingerprint; only numbers of rows that go are looked up, by a broadcast while
    a count shows that they are few.
    """
    fp, row = fresh("_fp", docs.columns), fresh("_row", docs.columns)
    with short_batches(docs.sparkSession):
        rows = store(fingerprints(docs.withColumn(row, F.monotonically_increasing_id()), shingle, fp), "numbered-fingerprints")
    first = F.struct(F.col("doc_id").isNull().alias("null"), F.col("doc_id").alias("doc_id"), F.col(row).alias("row"))
    with temporary():
        named = _first_of_each(rows, fp, first, distance)
        stays = named.select(F.col("fp").alias(fp), F.col("first.row").alias("stays"))
        gone = store(rows.select(row, fp).join(small(stays, named), fp).where(F.col(row) != F.col("stays")).select(row), "near-copies", keep=True)
    return rows.join(small(gone), row, "left_anti").select(*docs.columns)
