"""Token-id files under Re-Pair grammar compression, with random access.

A shard holds the ids of consecutive documents. Its ids become dense symbols; then the most frequent pairs of
neighbouring symbols are replaced by nonterminals, round after round, until no pair is frequent. A pair never
reaches over the end of a document, so every document stays a run of symbols of its own. A shard stores the rules
(two symbols each), the length of every rule's expansion, and where each document's symbols and ids begin:
any document, or any range of its ids, is decoded without the rest of the shard.

Files: Parquet below a path that only Spark opens, one row a shard, in ascending order of document id:
``part``, ``shard`` (order inside the part), ``n_docs``, ``n_tokens``, and binary columns, all little-endian:
``doc_ids`` (int64; ``doc_nulls``: one byte each), ``alphabet`` (uint32, the ids behind the first symbols), ``rules``
(uint32 pairs), ``symbols`` (uint16 where they fit, else uint32; ``wide`` says which), ``doc_symbols`` and
``doc_tokens`` (uint32, counts of each document).

Edge cases: a null or empty text is its end id alone; null ids of documents sort first; rows that repeat an id keep
all their copies, ordered by text; an empty table gives no shards and an empty result; extra columns aren't read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.session import find_package
from .common import chunks, short_batches, small, store
from .encode import encoder

SHARD_TOKENS = 1 << 19
#: Rows and bytes of text that are encoded at a time: distinct words are looked up once for all of them.
ENCODED_ROWS, ENCODED_BYTES = 2_048, 6 << 20
LEAST_COUNT = 16
FILE_SCHEMA = (
    "part int, shard int, n_docs long, n_tokens long, doc_ids binary, doc_nulls binary, alphabet binary, rules binary, "
    "expansions binary, wide boolean, symbols binary, doc_symbols binary, doc_tokens binary"
)


def _grouped(left: np.ndarray, right: np.ndarray, at: np.ndarray, n_symbols: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(pairs a << 32 | b, how often, their places, ascending within a pair) of the pairs seen LEAST_COUNT times."""
    wide, deep = max(1, n_symbols - 1).bit_length(), max(1, int(at.max(initial=0))).bit_length()
    if 2 * wide + deep <= 64:
        packed = np.sort((left.astype(np.uint64) << np.uint64(wide) | right.astype(np.uint64)) << np.uint64(deep) | at.astype(np.uint64))
        pairs, at = packed >> np.uint64(deep), (packed & np.uint64((1 << deep) - 1)).astype(np.int64)
    else:
        wide = 32
        pairs = left.astype(np.uint64) << np.uint64(32) | right.astype(np.uint64)
        order = np.lexsort((at, pairs))
        pairs, at = pairs[order], at[order]
    starts = np.flatnonzero(np.concatenate((np.ones(min(1, len(pairs)), bool), pairs[1:] != pairs[:-1])))
    n = np.diff(starts, append=len(pairs))
    often = n >= LEAST_COUNT
    pairs = pairs[starts[often]]
    return pairs >> np.uint64(wide) << np.uint64(32) | pairs & np.uint64((1 << wide) - 1), n[often], at[np.repeat(often, n)]


def disjoint_pairs(pairs: np.ndarray, counts: np.ndarray) -> list[int]:
    """Indices of disjoint pairs seen at least half as often as the most frequent and LEAST_COUNT times, by count."""
    likely = np.flatnonzero(counts >= max(LEAST_COUNT, int(counts.max(initial=0)) // 2))
    likely = likely[np.argsort(-counts[likely], kind="stable")]
    chosen, lefts, rights = [], set(), set()
    for k, key in zip(likely.tolist(), pairs[likely].tolist()):
        a, b = key >> 32, key & 0xFFFFFFFF
        # pairs of a round never overlap in the text: no symbol is right in one and left in another (a doubled one is alone)
        if a not in rights and b not in lefts and (a != b or a not in lefts):
            lefts.add(a)
            rights.add(b)
            chosen.append(k)
    return chosen


def compress(ids: np.ndarray, doc_tokens: np.ndarray) -> dict[str, np.ndarray]:
    """Grammar of one shard; ``doc_tokens``: how many of ``ids`` each document has (at least one).

    Counts are kept, not taken anew: a pair gets new occurrences only in the round that makes one of its symbols, so one
    that isn't frequent then never will be, and a replacement takes away at most the pairs at three places.
    """
    seen = np.zeros(int(ids.max()) + 1, bool)
    seen[ids] = True
    alphabet, n = np.flatnonzero(seen), len(ids)
    symbols = np.append((np.cumsum(seen) - 1)[ids], -1)  # place n stands for the end of a document on either side
    ends = np.cumsum(doc_tokens)
    after, before, alive = np.arange(1, n + 2), np.arange(-1, n), np.ones(n, bool)
    after[ends - 1] = n
    before[ends - np.asarray(doc_tokens)] = n
    pair_at = np.full(n + 1, -1)  # which frequent pair begins at a place
    rules: list[np.ndarray] = []
    made = len(alphabet)
    at = np.flatnonzero(after[:n] < n)
    pairs, counts, places = _grouped(symbols[at], symbols[after[at]], at, made)
    pair_at[places] = np.repeat(np.arange(len(pairs)), counts)
    # places of pair k: those of its round's array from begin[k], as many as it had then
    filed, rounds, begin, had = [places], np.zeros(len(pairs), np.int64), np.cumsum(counts) - counts, counts.copy()

    def forget(at: np.ndarray) -> None:
        gone = pair_at[at]
        np.subtract(counts, np.bincount(gone[gone >= 0], minlength=len(counts)), out=counts)
        pair_at[at] = -1

    while chosen := disjoint_pairs(pairs, counts):
        found = [filed[r][b : b + m] for r, b, m in zip(rounds[chosen].tolist(), begin[chosen].tolist(), had[chosen].tolist())]
        new = np.repeat(np.arange(len(chosen)), [len(f) for f in found])
        at = np.concatenate(found)
        still = pair_at[at] == np.array(chosen)[new]
        at, new = at[still], new[still]
        # only a doubled symbol can match at neighbouring places: every other one of such a run is taken, from its left
        new_run = np.append(True, at[1:] != after[at[:-1]])
        order = np.arange(len(at))
        take = (order - np.maximum.accumulate(np.where(new_run, order, 0))) % 2 == 0
        at, new = at[take], new[take]
        second = after[at]
        for x in (at, second, before[at]):  # in this order: what precedes one may be the second symbol of another
            forget(x)
        symbols[at], after[at], alive[second] = made + new, after[second], False
        before[after[at]] = at
        key = pairs[chosen]
        rules.append(np.stack([key >> np.uint64(32), key & np.uint64(0xFFFFFFFF)], axis=1).astype(np.uint32))
        left = before[at]
        at = np.concatenate((at[after[at] < n], left[(left < n) & (symbols[left] < made)]))
        made += len(chosen)
        more, often, places = _grouped(symbols[at], symbols[after[at]], at, made)
        if len(more):
            pair_at[places] = np.repeat(np.arange(len(pairs), len(pairs) + len(more)), often)
            rounds, begin = np.concatenate((rounds, np.full(len(more), len(filed)))), np.concatenate((begin, np.cumsum(often) - often))
            filed.append(places)
            pairs, counts, had = np.concatenate((pairs, more)), np.concatenate((counts, often)), np.concatenate((had, often))
    rule = np.concatenate(rules) if rules else np.zeros((0, 2), np.uint32)
    ends = np.flatnonzero(after[:n][alive] == n) + 1
    return {
        "alphabet": alphabet.astype("<u4"), "rules": rule, "expansions": expansion_lengths(len(alphabet), rule)[len(alphabet) :],
        "symbols": symbols[:n][alive].astype(np.uint32), "doc_symbols": np.diff(ends, prepend=0),
    }


def expansion_lengths(n_alphabet: int, rules: np.ndarray) -> np.ndarray:
    out = np.ones(n_alphabet + len(rules), np.uint32)
    for i, (a, b) in enumerate(rules.tolist(), n_alphabet):
        out[i] = out[a] + out[b]
    return out


def expansion_table(alphabet: np.ndarray, rules: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(pool, starts, lengths): symbol s stands for pool[starts[s]:starts[s] + lengths[s]]."""
    whole = [alphabet[i : i + 1] for i in range(len(alphabet))]
    for a, b in rules.tolist():
        whole.append(np.concatenate((whole[a], whole[b])))
    lengths = np.fromiter(map(len, whole), np.int64, len(whole))
    return (np.concatenate(whole) if whole else np.zeros(0, np.uint32)), np.cumsum(lengths) - lengths, lengths


def expand(symbols: np.ndarray, table: tuple[np.ndarray, np.ndarray, np.ndarray]) -> np.ndarray:
    pool, starts, lengths = table
    each = lengths[symbols]
    ends = np.cumsum(each)
    return pool[np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts[symbols] - ends + each, each)]


def _shard_row(part: int, shard: int, doc_ids: list, ids: np.ndarray, doc_tokens: np.ndarray) -> dict:
    g = compress(ids, doc_tokens)
    wide = len(g["alphabet"]) + len(g["rules"]) > 0xFFFF
    return {
        "part": part, "shard": shard, "n_docs": len(doc_ids), "n_tokens": len(ids),
        "doc_ids": np.array([d or 0 for d in doc_ids], "<i8").tobytes(), "doc_nulls": bytes(d is None for d in doc_ids),
        "alphabet": g["alphabet"].tobytes(), "rules": g["rules"].astype("<u4").tobytes(), "expansions": g["expansions"].astype("<u4").tobytes(), "wide": wide,
        "symbols": g["symbols"].astype("<u4" if wide else "<u2").tobytes(), "doc_symbols": g["doc_symbols"].astype("<u4").tobytes(), "doc_tokens": doc_tokens.astype("<u4").tobytes(),
    }


def encode_shards(docs: DataFrame, tokenizer_path: str, end_id: int = 0, shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """Rows of the file format for ``docs`` (doc_id, text), in ascending order of doc_id over parts and shards."""
    spark = docs.sparkSession
    find_package(spark)
    schema = pa.schema([(n, {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary(), "boolean": pa.bool_()}[t]) for n, t in (c.split() for c in FILE_SCHEMA.split(", "))])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, part, shard = encoder(tokenizer_path), TaskContext.get().partitionId(), 0
        held, doc_ids, tokens, size = [], [], [], 0

        def flush() -> pa.RecordBatch:
            return pa.RecordBatch.from_pylist([_shard_row(part, shard, doc_ids, np.concatenate(held), np.array(tokens, np.int64))], schema=schema)

        for batch in chunks(batches, ENCODED_ROWS, ENCODED_BYTES):
            ids, bounds = enc.encode(batch.column(1), end_id)
            names, at = batch.column(0).to_pylist(), 0
            while at < len(names):
                # as many documents as go into the shard, one at least
                upto = max(at + 1, int(np.searchsorted(bounds, bounds[at] + shard_tokens - size, "right")) - 1)
                upto = min(upto, len(names))
                held.append(ids[bounds[at] : bounds[upto]])
                doc_ids += names[at:upto]
                tokens += np.diff(bounds[at : upto + 1]).tolist()
                size += int(bounds[upto] - bounds[at])
                at = upto
                if size >= shard_tokens or at < len(names):
                    yield flush()
                    held, doc_ids, tokens, size, shard = [], [], [], 0, shard + 1
        if doc_ids:
            yield flush()

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartitionByRange(parts, F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "text").mapInArrow(run, FILE_SCHEMA)


def read_documents(shards: DataFrame, told: Callable[[bytes], int] | None = None) -> DataFrame:
    """(doc_id, start, n_tokens, ids binary) of every document of stored shards, decoded from the grammar.

    ``told`` replaces the ids by a number made of their bytes, where they were decoded. Only one number a part (there are as
    many as shuffle partitions) meets at the driver: its ids. Shards aren't shuffled: their places are broadcast after a check.
    """
    spark = shards.sparkSession
    find_package(spark)
    totals = shards.groupBy("part").agg(F.sum("n_tokens").alias("n")).collect()
    base, before = 0, []
    for part, n in sorted(map(tuple, totals)):
        before.append((part, base))
        base += n
    starts = spark.createDataFrame(before, "part int, base_ long")
    earlier = Window.partitionBy("part").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    places = shards.select("part", "shard", F.coalesce(F.sum("n_tokens").over(earlier), F.lit(0)).alias("before_")).join(F.broadcast(starts), "part")
    placed = shards.join(small(store(places.select("part", "shard", (F.col("base_") + F.col("before_")).alias("start_")), "shard-places")), ["part", "shard"])
    columns = ["start_", "doc_ids", "doc_nulls", "doc_tokens", "alphabet", "rules", "wide", "symbols"]
    return placed.select(*columns).mapInArrow(lambda b: _decode(b, told), "doc_id long, start long, n_tokens long, " + ("ids binary" if told is None else "told long"))


def _decode(batches: Iterable[pa.RecordBatch], told: Callable[[bytes], int] | None) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for k in range(batch.num_rows):
            row = batch.slice(k, 1).to_pylist()[0]
            table = expansion_table(np.frombuffer(row["alphabet"], "<u4"), np.frombuffer(row["rules"], "<u4").reshape(-1, 2))
            symbols = np.frombuffer(row["symbols"], "<u4" if row["wide"] else "<u2")
            raw = memoryview(expand(symbols, table).astype("<u4", copy=False).tobytes())
            names, nulls = np.frombuffer(row["doc_ids"], "<i8"), np.frombuffer(row["doc_nulls"], np.bool_)
            n = np.frombuffer(row["doc_tokens"], "<u4").astype(np.int64)
            ends = np.cumsum(n)
            for at in range(0, len(n), 512):
                e, m = ends[at : at + 512], n[at : at + 512]
                parts = (raw[4 * (b - k) : 4 * b] for b, k in zip(e.tolist(), m.tolist()))
                last = pa.array(list(parts), pa.binary()) if told is None else pa.array([told(p) for p in parts], pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(names[at : at + 512], pa.int64(), mask=nulls[at : at + 512]), pa.array(row["start_"] + e - m), pa.array(m), last], ["doc_id", "start", "n_tokens", "ids" if told is None else "told"])


def decode_range(row: dict, k: int, first: int, last: int) -> np.ndarray:
    """Random access: ids ``first`` up to ``last`` of document ``k`` of one shard row.

    Expansion lengths tell which symbols reach into the range; level by level only those are expanded.
    """
    alphabet, rules = np.frombuffer(row["alphabet"], "<u4"), np.frombuffer(row["rules"], "<u4").reshape(-1, 2)
    lengths = np.concatenate((np.ones(len(alphabet), np.int64), np.frombuffer(row["expansions"], "<u4").astype(np.int64)))
    ends = np.cumsum(np.frombuffer(row["doc_symbols"], "<u4").astype(np.int64))
    symbols = np.frombuffer(row["symbols"], "<u4" if row["wide"] else "<u2")[ends[k - 1] if k else 0 : ends[k]].astype(np.int64)
    first = max(0, first)
    while True:
        each = lengths[symbols]
        starts = np.cumsum(each) - each
        inside = (starts + each > first) & (starts < last)
        if first >= last or not inside.any():
            return alphabet[:0]
        before = int(starts[inside][0])
        symbols, first, last = symbols[inside], first - before, last - before
        deep = symbols >= len(alphabet)
        if not deep.any():
            return alphabet[symbols]
        pair = rules[symbols[deep] - len(alphabet)]
        at = (np.cumsum(1 + deep) - 1 - deep)[deep]
        symbols = np.repeat(symbols, 1 + deep)
        symbols[at], symbols[at + 1] = pair[:, 0], pair[:, 1]


def decode_document(row: dict, k: int) -> np.ndarray:
    """Random access: the ids of document ``k`` of one shard row, from its own symbols alone."""
    return decode_range(row, k, 0, int(np.frombuffer(row["doc_tokens"], "<u4")[k]))


def write_and_read(docs: DataFrame, tokenizer_path: str, end_id: int = 0, told: Callable[[bytes], int] | None = None) -> DataFrame:
    """Encode, write the files into the shared folder, and read every document back from them."""
    with short_batches(docs.sparkSession):
        shards = store(encode_shards(docs, tokenizer_path, end_id), "repair")
    return read_documents(shards, told)
