"""Shared plumbing of the training-data operators: scratch tables, size-checked broadcasts, chunks of Arrow batches."""

from __future__ import annotations

import atexit
import contextlib
import uuid
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.session import find_package, shared_folder

#: A side of a join is broadcast only if its table in the shared folder shows that it has no more rows and bytes than these.
BROADCAST_ROWS, BROADCAST_BYTES = 200_000, 4 << 20
#: Rows of the Arrow batches in which the JVM sends texts to Python: they are held on both sides at once.
ARROW_ROWS = 512
#: What a Python function works on at a time: at most so many rows, and about so many bytes (one row at least).
CHUNK_ROWS, CHUNK_BYTES = 512, 2 << 20

#: Paths of stored tables, by the blocks of ``temporary`` that are open; the first list is the session's.
_blocks: list[list[tuple[SparkSession, str]]] = [[]]


def store(df: DataFrame, name: str, keep: bool = False) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: lineage is cut and survives lost executors.

    The table goes when the innermost ``temporary`` block ends; with ``keep`` when the block around that one does.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/rollweave/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _blocks[-2 if keep and len(_blocks) > 1 else -1].append((spark, path))
    out = spark.read.schema(df.schema).parquet(path)
    out._stored_at = path
    return out


def keep(df: DataFrame, name: str) -> DataFrame:
    """``store(df, name, keep=True)``, but a table that ``store`` made is kept as it is."""
    path = vars(df).get("_stored_at")
    for block in _blocks[1:]:
        for entry in [t for t in block if t[1] == path]:
            block.remove(entry)
            _blocks[-2].append(entry)
            return df
    return store(df, name, keep=True)


def _delete(tables: list[tuple[SparkSession, str]]) -> None:
    while tables:
        spark, path = tables.pop()
        where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


@contextlib.contextmanager
def temporary() -> Iterator[None]:
    """Tables stored inside the block are deleted at its end, whether it succeeds or not."""
    mine: list[tuple[SparkSession, str]] = []
    _blocks.append(mine)
    try:
        yield
    finally:
        _blocks.remove(mine)
        _delete(mine)


@contextlib.contextmanager
def noted(tables: list[tuple[SparkSession, str]]) -> Iterator[None]:
    """What the innermost open block gets while this one runs is added to ``tables``."""
    before = list(_blocks[-1])
    try:
        yield
    finally:
        tables += [t for t in _blocks[-1] if t not in before]


def discard_unread(tables: list[tuple[SparkSession, str]], df: DataFrame) -> None:
    """Delete the tables, and forget them, but for those whose files ``df`` reads."""
    files = [f.split(":", 1)[-1].lstrip("/") for f in df.inputFiles()] if tables else []
    for table in list(tables):
        if not any(f.startswith(table[1].split(":", 1)[-1].lstrip("/") + "/") for f in files):
            tables.remove(table)
            for block in _blocks:
                if table in block:
                    block.remove(table)
                    _delete([table])


def discard(df: DataFrame) -> None:
    """Delete the table behind a stored DataFrame now, if it is one; nothing lazy may read it any more."""
    path = vars(df).get("_stored_at")
    for block in _blocks:
        mine = [t for t in block if t[1] == path]
        block[:] = [t for t in block if t[1] != path]
        _delete(mine)


def release(spark: SparkSession | None = None) -> None:
    """Delete all scratch tables that are left, of one session or of all; done at the end of the process in any case."""
    for block in _blocks:
        mine = [t for t in block if spark is None or t[0] is spark]
        block[:] = [t for t in block if t not in mine]
        _delete(mine)


@atexit.register
def _at_exit() -> None:
    for table in [t for block in _blocks for t in block]:
        with contextlib.suppress(Exception):  # its session may have ended already
            _delete([table])


def fits(table: DataFrame) -> bool:
    """Whether a stored table is within BROADCAST_ROWS and BROADCAST_BYTES."""
    spark = table.sparkSession
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(table._stored_at)
    size = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getContentSummary(where).getLength()
    return size <= BROADCAST_BYTES and table.count() <= BROADCAST_ROWS


def small(df: DataFrame, stored: DataFrame | None = None) -> DataFrame:
    """``df`` with a broadcast hint if its table fits, else unchanged: the planner shuffles.

    The table is the stored ``df`` itself, or ``stored``, from which ``df`` comes by a projection.
    """
    return F.broadcast(df) if fits(df if stored is None else stored) else df


@contextlib.contextmanager
def short_batches(spark: SparkSession) -> Iterator[None]:
    """Jobs inside the block send texts to Python in short Arrow batches; the session's own setting is restored after it."""
    find_package(spark)
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(min(ARROW_ROWS, int(before)) if int(before) > 0 else ARROW_ROWS))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def chunks(batches: Iterable[pa.RecordBatch], rows: int | None = None, size: int | None = None) -> Iterator[pa.RecordBatch]:
    """The rows of the batches in pieces of at most ``rows`` rows and about ``size`` bytes: short batches are joined, long ones cut."""
    rows, size = rows or CHUNK_ROWS, size or CHUNK_BYTES
    held, n, weight = [], 0, 0
    for batch in batches:
        each = max(1, batch.nbytes // max(1, batch.num_rows))
        at = 0
        while at < batch.num_rows:
            part = batch.slice(at, max(1, min(rows - n, (size - weight) // each)))
            at, n, weight = at + part.num_rows, n + part.num_rows, weight + part.num_rows * each
            held.append(part)
            if n >= rows or weight + each > size:
                yield pa.concat_batches(held) if len(held) > 1 else held[0]
                held, n, weight = [], 0, 0
    if held:
        yield pa.concat_batches(held) if len(held) > 1 else held[0]


def fresh(base: str, taken) -> str:
    """A column name that starts with ``base`` and clashes with none of ``taken`` (compared without case)."""
    have = {c.lower() for c in taken}
    name = base
    while name.lower() in have:
        name += "_"
    return name
