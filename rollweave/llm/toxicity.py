"""Toxicity by non-negative positive-unlabelled learning (Kiryo et al., 2017) with numpy.

Confirmed toxic texts are the positives; a sample of all texts, whatever their labels, is the unlabelled set, of which a
share ``prior`` is toxic. The classifier is linear over a text's distinct words and word beginnings (which catch the
inflected forms of a word). Its risk is  prior * R_P(+) + max(0, R_U(-) - prior * R_P(-)): when the corrected negative
part falls below zero, the step climbs back instead of fitting the toxic texts inside the unlabelled set.

Features are looked for in at most MAX_POSITIVE positives and weights are fitted on these and MAX_UNLABELLED texts (documented bounds; chosen
by a hash of the id, so the sample is the same at every run). How often the negatives have a feature, which decides whether it tells
anything, is counted over all texts but the held-out ones; scoring reads every whole text of the table. Texts stay on the executors: the
driver holds counts of features and the chosen features of the chosen texts.

Edge cases: a null or empty text gets the score of a text without toxic features; without any positive (an empty table, no
labels) every score is the prior; several labels of one id count as toxic if one is; null labels say nothing; repeated rows
are scored each; extra columns of either table aren't read.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import chunks, short_batches, small, store, temporary

MAX_POSITIVE = 4_000
MAX_UNLABELLED = 8_000
THRESHOLD = 0.7
#: Lengths of the word beginnings that are features besides whole words.
PREFIXES = (4, 5, 6)
_WORD = re.compile(r"[^\W_]+")


def features(text: str | None) -> set[str]:
    """Distinct words in lower case, and word beginnings marked by a hyphen."""
    words = set(_WORD.findall((text or "").lower()))
    return words.union(*({w[:k] + "-" for w in words if len(w) > k} for k in PREFIXES))


@dataclass
class Model:
    """Weights of features; ``bias`` is the logit of a text without any."""

    bias: float
    weights: dict[str, float] = field(default_factory=dict)

    def __post_init__(self):
        self._whole = {f for f in self.weights if f[-1] != "-"}
        self._begin = {k: {f[:-1]: w for f, w in self.weights.items() if f[-1] == "-" and len(f) == k + 1} for k in PREFIXES}

    def score(self, text: str | None) -> float:
        words = set(_WORD.findall(text.lower())) if text else set()
        logit = self.bias + sum(self.weights[w] for w in words & self._whole)
        for k, begin in self._begin.items():
            if begin:
                logit += sum(begin[b] for b in {w[:k] for w in words if len(w) > k} & begin.keys())
        return float(1 / (1 + np.exp(-np.clip(logit, -30, 30))))


LEAST_POSITIVES = 3
#: Features that a task counts before it passes them on.
HELD_FEATURES = 200_000
_INDEX_SCHEMA = "feature string, n long"


class Lookup:
    """Numbers of the features that a text has, of those in ``index``."""

    def __init__(self, index: dict[str, int]):
        self.whole = {f: i for f, i in index.items() if f[-1] != "-"}
        self.begin = {k: {f[:-1]: i for f, i in index.items() if f[-1] == "-" and len(f) == k + 1} for k in PREFIXES}

    def __call__(self, text: str | None) -> list[int]:
        words = set(_WORD.findall(text.lower())) if text else set()
        found = [self.whole[w] for w in words & self.whole.keys()]
        for k, of in self.begin.items():
            found += [of[b] for b in {w[:k] for w in words if len(w) > k} & of.keys()]
        return found


def _pairs(found: list) -> tuple[np.ndarray, np.ndarray]:
    """(row, feature) of all features of all texts."""
    return np.repeat(np.arange(len(found)), [len(f) for f in found]), np.concatenate([np.zeros(0, np.int64), *(np.array(f, np.int64) for f in found)])


def telling(in_p: np.ndarray, n_p: int, in_u: np.ndarray, n_u: int, prior: float) -> np.ndarray:
    """Which features positives have far more often than the negatives, whose share follows from the prior."""
    negative = np.maximum((in_u / n_u - prior * in_p / n_p) / (1 - prior), 0) + 0.25 / n_u
    expected = n_p * negative
    return (in_p >= 6 * expected) & (in_p > expected + 4 * np.sqrt(expected) + 2)


def scores(w: np.ndarray, pos: tuple[np.ndarray, np.ndarray], n_pos: int, unl: tuple[np.ndarray, np.ndarray], n_unl: int) -> tuple[np.ndarray, np.ndarray]:
    """Scores of the positives and of the unlabelled texts, given as (row, feature) pairs; the last weight is the bias."""
    return tuple(1 / (1 + np.exp(-np.clip(w[-1] + np.bincount(r, w[c], n), -30, 30))) for (r, c), n in ((pos, n_pos), (unl, n_unl)))


def gradient(w: np.ndarray, pos: tuple[np.ndarray, np.ndarray], n_pos: int, unl: tuple[np.ndarray, np.ndarray], n_unl: int, prior: float, decay: float) -> np.ndarray:
    """Direction of steepest ascent of the non-negative risk; of its corrected negative part, climbing, where that is below zero.

    R_P(+) = mean(1 - sp); R_U(-) = mean(su); R_P(-) = mean(sp). A small ridge holds the weights.
    """
    sp, su = scores(w, pos, n_pos, unl, n_unl)
    dp, du = sp * (1 - sp) / n_pos, su * (1 - su) / n_unl  # slopes of the mean of a sigmoid
    by_p, by_u = (-2 * prior, 1.0) if su.mean() - prior * sp.mean() >= 0 else (prior, -1.0)
    m = len(w) - 1
    out = np.empty_like(w)
    out[:-1] = by_p * np.bincount(pos[1], dp[pos[0]], m) + by_u * np.bincount(unl[1], du[unl[0]], m) + decay * prior * w[:-1] / max(1, m)
    out[-1] = by_p * dp.sum() + by_u * du.sum()
    return out


def signs(in_p: dict[str, int], n_p: int, in_u: np.ndarray, n_u: int, prior: float) -> dict[str, int]:
    """Numbers for the features that tell toxicity; ``in_u`` counts the unlabelled texts that have each of the sorted features of ``in_p``."""
    names = sorted(in_p)
    if not names or not n_u:
        return {}
    chosen = telling(np.array([in_p[f] for f in names]), n_p, in_u, n_u, prior)
    return {f: i for i, f in enumerate(f for f, yes in zip(names, chosen) if yes)}


def clipped(prior: float) -> float:
    return float(np.clip(prior, 1e-3, 0.9))


def fit(positive: Iterable[str | None], unlabelled: Iterable[str | None], prior: float, **options) -> Model:
    """``fit_rows`` on texts in memory; positives that repeat count once."""
    pos, unl = list(dict.fromkeys(positive)), list(unlabelled)
    in_p = {f: n for f, n in Counter(f for t in pos for f in features(t)).items() if n >= LEAST_POSITIVES}
    every = Lookup({f: i for i, f in enumerate(sorted(in_p))})
    in_u = np.bincount(_pairs([every(t) for t in unl])[1], minlength=len(in_p))
    index = signs(in_p, len(pos), in_u, len(unl), clipped(prior))
    find = Lookup(index)
    return fit_rows(index, _pairs([find(t) for t in pos]), len(pos), _pairs([find(t) for t in unl]), len(unl), prior, **options)


def fit_rows(index: dict[str, int], pos: tuple[np.ndarray, np.ndarray], n_pos: int, unl: tuple[np.ndarray, np.ndarray], n_unl: int, prior: float, steps: int = 600, rate: float = 0.05, decay: float = 1e-4) -> Model:
    """nnPU with the sigmoid loss, full batches and Adam, on the (row, feature) pairs of the positives and of the unlabelled texts."""
    prior = clipped(prior)
    start = float(np.log(prior / (1 - prior)))
    if not n_pos or not n_unl:
        return Model(start)
    w, m, v = (np.zeros(len(index) + 1) for _ in range(3))
    w[-1] = start
    for step in range(1, steps + 1):
        grad = gradient(w, pos, n_pos, unl, n_unl, prior, decay)
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad * grad
        w = w - rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-10)
        w[:-1] = np.maximum(w[:-1], 0)  # the features were chosen as signs of toxicity
        w[-1] = min(w[-1], start)
    return Model(float(w[-1]), {f: float(x) for f, x in zip(index, w) if x > 0})


def common_features(texts: DataFrame) -> dict[str, int]:
    """How many of a bounded number of texts have each feature that LEAST_POSITIVES have; counted per task, then over all tasks."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter[str] = Counter()

        def told() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(counts.keys(), pa.string()), pa.array(counts.values(), pa.int64())], ["feature", "n"])

        for batch in chunks(batches):
            for text in batch.column(0).to_pylist():
                counts.update(features(text))
                if len(counts) > HELD_FEATURES:
                    yield told()
                    counts.clear()
        yield told()

    with short_batches(texts.sparkSession):
        totals = texts.select(F.col("text").cast("string")).mapInArrow(run, _INDEX_SCHEMA).groupBy("feature").agg(F.sum("n").alias("n"))
        found = totals.where(F.col("n") >= LEAST_POSITIVES).toArrow()
    return dict(zip(found.column(0).to_pylist(), found.column(1).to_pylist()))


def feature_rows(texts: DataFrame, index: dict[str, int]) -> tuple[np.ndarray, np.ndarray]:
    """(row, feature) of all indexed features of a bounded number of numbered texts; texts without any have no pair and no row."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = Lookup(index)
        for batch in chunks(batches):
            found = [find(t) for t in batch.column(1).to_pylist()]
            rows = np.repeat(np.arange(len(found)), [len(f) for f in found])
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows, pa.int64())), pa.array([i for f in found for i in f], pa.int32())], ["row", "feature"])

    with short_batches(texts.sparkSession):
        found = texts.select("row", F.col("text").cast("string")).mapInArrow(run, "row long, feature int").toArrow()
    row, feature = (found.column(i).to_numpy() for i in (0, 1))
    order = np.lexsort((feature, row))
    return np.unique(row[order], return_inverse=True)[1].reshape(-1), feature[order].astype(np.int64)


def feature_counts(docs: DataFrame, index: dict[str, int]) -> tuple[np.ndarray, int]:
    """(how many texts of ``docs`` have each feature of ``index``, number of texts): added up per task, then over all tasks."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find, n, seen = Lookup(index), 0, np.zeros(len(index), np.int64)
        for batch in chunks(batches):
            for text in batch.column(0).to_pylist():
                n += 1
                seen[find(text)] += 1
        at = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1), pa.int64()), pa.array(np.append(seen[at], n), pa.int64())], ["feature", "n"])

    totals = docs.select(F.col("text").cast("string")).mapInArrow(run, "feature long, n long").groupBy("feature").agg(F.sum("n").alias("n"))
    with short_batches(docs.sparkSession):
        found = dict(map(tuple, totals.collect()))  # a row a feature of the index at most
    return np.array([found.get(i, 0) for i in range(len(index))], np.int64), found.get(-1, 0)


def held_out(doc_id: Column) -> Column:
    """Rows whose labels are never learnt from."""
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(3)) == 1


def sample(docs: DataFrame, rows: int, most: int, salt: int) -> DataFrame:
    """About ``most`` of ``rows`` rows, by a hash of the id (all where there are fewer)."""
    share = min(1.0, most / max(1, rows))
    return docs if share == 1 else docs.where(F.pmod(F.xxhash64("doc_id", F.lit(salt)), F.lit(1 << 30)) < int(share * (1 << 30)))


def learn(docs: DataFrame, labels: DataFrame) -> Model:
    """Model from (doc_id, text) and (doc_id, toxic), without the labels of held-out rows."""
    own = docs.select("doc_id", "text").where(F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    known = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    n, positives = known.agg(F.count(F.lit(1)), F.coalesce(F.sum("toxic"), F.lit(0))).first()
    # a label says whether its text is toxic; the share of such labels is the class prior
    with temporary():
        chosen = store(sample(known.where("toxic = 1"), positives, MAX_POSITIVE, 1).select("doc_id"), "positives")
        # copies of a text are one example, however many there are
        texts = own.join(small(chosen), "doc_id").select("text").distinct()
        texts = store(texts.select(F.monotonically_increasing_id().alias("row"), "text"), "positive-texts")
        in_p, n_p, prior = common_features(texts), texts.count(), positives / n if n else 0.01
        every = {f: i for i, f in enumerate(sorted(in_p))}
        index = signs(in_p, n_p, *feature_counts(own, every), clipped(prior))
        unlabelled = sample(own, own.count(), MAX_UNLABELLED, 2)
        unlabelled = store(unlabelled.select(F.monotonically_increasing_id().alias("row"), "text"), "unlabelled-texts")
        return fit_rows(index, feature_rows(texts, index), n_p, feature_rows(unlabelled, index), unlabelled.count(), prior)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, held_out, score) of every whole text; a stored table."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches):
            scores = [model.score(t) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(scores, pa.float64())], ["doc_id", "held_out", "score"])

    rows = docs.select(F.col("doc_id").cast("long"), F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), F.col("text").cast("string"))
    with short_batches(docs.sparkSession):
        return store(rows.mapInArrow(run, "doc_id long, held_out boolean, score double"), "toxicity")


def drop_toxic(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` without texts scored at ``threshold`` or more; all columns as they were. A stored table."""
    at = docs.columns.index("text")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches):
            yield batch.filter(pa.array([model.score(t) < threshold for t in batch.column(at).to_pylist()], pa.bool_()))

    with short_batches(docs.sparkSession):
        return store(docs.mapInArrow(run, docs.schema), "not-toxic")
