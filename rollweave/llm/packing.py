"""Best-fit packing of tokenised documents into fixed-length training sequences.

Method: bounded-space online best-fit. A stream of pieces meets a fixed number of open bins; a bitset has bit ``f`` set while
some open bin has ``f`` tokens free, so the tightest bin that takes a piece is the lowest set bit at or above the
piece's length. When one bin too many is open, the fullest closes. Pieces arrive in waves of about WAVE_PIECES, each wave largest first
(one external sort by wave and length), and bins stay open from wave to wave, so what a wave's large pieces leave is filled by its small ones
and by the next wave's. There are at most as many streams as shuffle partitions, each as long as it has to be.

Edge cases: a null or empty text is a document of its end token alone; a text longer than a sequence is cut into whole
sequences after a first, shorter piece; repeated rows are packed once for each row; a null document id stays null; an
empty table gives an empty result; extra columns of the input are not read, so their names can't clash.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.session import find_package
from .common import chunks, short_batches, store
from .encode import encoder

CAPACITY = 2048
OPEN_BINS = 1024
#: Pieces of a wave, about. At most half of them open a bin for good, so that a wave alone doesn't overflow OPEN_BINS.
WAVE_PIECES = 2_048
#: Waves of a stream, at least: the bins that are still open at its end hold well under 0.1 % of its tokens.
STREAM_WAVES = 16
PIECE_SCHEMA = "doc_id long, piece int, start long, length long, ids_crc32 long, uid long"


class OpenBins:
    """At most ``limit`` open bins of ``capacity`` tokens."""

    def __init__(self, capacity: int, limit: int):
        if capacity < 1 or limit < 1:
            raise ValueError("capacity and limit must be positive")
        self.capacity, self.limit = capacity, limit
        self.by_free: list[list[int]] = [[] for _ in range(capacity + 1)]
        self.free = 0  # the bitset
        self.open = self.made = self.closed = 0

    def _put(self, bin_id: int, free: int) -> None:
        self.by_free[free].append(bin_id)
        self.free |= 1 << free
        self.open += 1

    def _take(self, free: int) -> int:
        stack = self.by_free[free]
        bin_id = stack.pop()
        if not stack:
            self.free &= ~(1 << free)
        self.open -= 1
        return bin_id

    def place(self, length: int) -> tuple[int, int]:
        """(bin, offset) of a piece of ``length`` tokens."""
        if not 0 < length <= self.capacity:
            raise ValueError(f"a piece of {length} tokens doesn't go into {self.capacity}")
        fitting = self.free >> length
        if fitting:
            free = length + (fitting & -fitting).bit_length() - 1
            bin_id = self._take(free)
        else:
            free, bin_id = self.capacity, self.made
            self.made += 1
        if free > length:
            self._put(bin_id, free - length)
            if self.open > self.limit:
                self._take((self.free & -self.free).bit_length() - 1)
                self.closed += 1
        return bin_id, self.capacity - free


def cuts(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of a document of ``n`` tokens."""
    if n <= capacity:
        return [(0, n)]
    first = n % capacity or capacity
    return [(0, first)] + [(s, capacity) for s in range(first, n, capacity)]


def tokenised_pieces(docs: DataFrame, tokenizer_path: str, end_id: int = 0, capacity: int = CAPACITY, keep_ids: bool = False) -> DataFrame:
    """Pieces of every whole text of ``docs`` (doc_id, text); ``keep_ids`` adds the ids as little-endian binary."""
    find_package(docs.sparkSession)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, uid = encoder(tokenizer_path), TaskContext.get().partitionId() << 36
        for batch in chunks(batches):
            ids, bounds = enc.encode(batch.column(1), end_id)
            rows, raw = [], []
            for doc_id, a, b in zip(batch.column(0).to_pylist(), bounds.tolist(), bounds[1:].tolist()):
                whole = ids[a:b].tobytes()
                for k, (s, n) in enumerate(cuts(b - a, capacity)):
                    part = whole[4 * s : 4 * (s + n)]
                    rows.append((doc_id, k, s, n, zlib.crc32(part), uid))
                    uid += 1
                    if keep_ids:
                        raw.append(part)
            columns = [pa.array(c, t) for c, t in zip(zip(*rows), types)] if rows else [pa.array([], t) for t in types]
            if keep_ids:
                columns.append(pa.array(raw, pa.binary()))
            yield pa.RecordBatch.from_arrays(columns, names)

    types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64()]
    names = [c.split()[0] for c in PIECE_SCHEMA.split(", ")] + ["ids"] * keep_ids
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, PIECE_SCHEMA + ", ids binary" * keep_ids)


def pack(pieces: DataFrame, capacity: int = CAPACITY, open_bins: int = OPEN_BINS, wave_pieces: int = WAVE_PIECES) -> DataFrame:
    """Adds ``sequence_id`` and ``offset`` to rows with ``uid`` (unique) and ``length`` (1 to ``capacity``).

    A piece that fills a sequence gets one of its own (a negative id) and is never shuffled. The number of waves
    follows the number of other pieces; a stream's rows are sorted on disk if need be and packed as they flow by.
    """
    spark = pieces.sparkSession
    find_package(spark)
    other = pieces.where(F.col("length") < capacity)
    waves = max(1, -(-other.count() // wave_pieces))
    streams = max(1, min(int(spark.conf.get("spark.sql.shuffle.partitions")), waves // STREAM_WAVES))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bins, first = OpenBins(capacity, open_bins), TaskContext.get().partitionId() << 40
        for batch in batches:
            placed = [bins.place(n) for n in batch.column("length").to_pylist()]
            kept = [n for n in batch.schema.names if n != "wave_"]
            columns = [pa.array([first + b for b, _ in placed], pa.int64()), pa.array([o for _, o in placed], pa.int64())]
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in kept), *columns], [*kept, "sequence_id", "offset"])

    schema = pieces.withColumns({"sequence_id": F.lit(0).cast("long"), "offset": F.lit(0).cast("long")}).schema
    packed = (
        other.withColumn("wave_", F.pmod(F.xxhash64("uid"), F.lit(waves)))
        .repartitionById(streams, F.pmod("wave_", F.lit(streams)).cast("int"))
        .sortWithinPartitions("wave_", F.desc("length"), "uid")
        .mapInArrow(run, schema)
    )
    full = pieces.where(F.col("length") == capacity).withColumns({"sequence_id": -1 - F.col("uid"), "offset": (F.col("uid") * 0).cast("long")})
    return packed.unionByName(full)


def pack_documents(docs: DataFrame, tokenizer_path: str, end_id: int = 0, capacity: int = CAPACITY, keep_ids: bool = False) -> DataFrame:
    """Tokenise once (the pieces are stored in the shared folder) and pack."""
    with short_batches(docs.sparkSession):
        pieces = store(tokenised_pieces(docs, tokenizer_path, end_id, capacity, keep_ids), "pieces")
    return pack(pieces, capacity).drop("uid")
