"""Document quality by hierarchical empirical Bayes over hosts and paths.

A document's own evidence is the log-odds of a logistic model over binned text statistics, fitted by numpy on a bounded
sample of labelled rows (MAX_LABELLED, chosen by a hash of the id) and applied as plain column expressions. A host's
posterior is a Beta mean: the global rate counts as many documents as the spread between hosts warrants (method of
moments), so a host with few documents stays near the global rate; a path is shrunk towards its host in the same way. A
document's score replaces the global log-odds in its evidence by its path's.

Groups are reduced by map-side sums: a host with a third of all rows sends one row a task. The groups' posteriors come back by a
broadcast if a count shows that they are few, else by a join that adaptive execution may split.

Edge cases: null or empty text has the statistics of an empty one; null hosts and paths are a host and a path of their own;
without labels, or with one class only, evidence is zero and scores are the prior; repeated rows count each; an empty
table gives an empty result; extra columns aren't read.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import small, store, temporary

MAX_LABELLED = 20_000
BINS = 16
KEEP = 0.5


def host_of(url: Column) -> Column:
    """Host of a URL in lower case, without ``www.`` and port."""
    return F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?(?:www\.)?([^/:?#]*)", 1))


def path_of(url: Column) -> Column:
    """First segment of a URL's path."""
    return F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*/([^/?#]*)", 1)


def statistics(text: Column) -> dict[str, Column]:
    """Text statistics by name; all of them read the whole text."""
    text = F.coalesce(text.cast("string"), F.lit(""))
    n = F.greatest(F.length(text), F.lit(1)).cast("double")
    words = F.split(F.trim(text), r"\s+")
    return {
        "length": F.log1p(n),
        "upper": F.regexp_count(text, F.lit(r"\p{Lu}")) / n,
        "digits": F.regexp_count(text, F.lit(r"\p{Nd}")) / n,
        "marks": F.regexp_count(text, F.lit(r"[^\p{L}\p{N}\s]")) / n,
        "word": n / F.size(words),
        "variety": F.size(F.array_distinct(words)) / F.size(words),
    }


def _one_hot(values: np.ndarray, edges: list[np.ndarray]) -> np.ndarray:
    out = np.zeros((len(values), sum(len(e) + 1 for e in edges)))
    at = 0
    for j, e in enumerate(edges):
        out[np.arange(len(values)), at + np.searchsorted(e, values[:, j], "right")] = 1
        at += len(e) + 1
    return out


def fit(values: np.ndarray, labels: np.ndarray, ridge: float = 1.0, steps: int = 25) -> tuple[float, list[np.ndarray], list[np.ndarray]]:
    """(bias, edges, weights) of a ridge-penalised logistic model over quantile bins, by Newton's method."""
    if not len(labels) or labels.min() == labels.max():
        rate = float(np.clip(labels.mean() if len(labels) else 0.5, 0.01, 0.99))
        return float(np.log(rate / (1 - rate))), [], []
    edges = [np.unique(np.quantile(values[:, j], np.linspace(0, 1, BINS + 1)[1:-1])) for j in range(values.shape[1])]
    x = np.hstack([_one_hot(values, edges), np.ones((len(values), 1))])
    penalty = np.diag([ridge] * (x.shape[1] - 1) + [1e-6])
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve(x.T @ (x * (p * (1 - p))[:, None]) + penalty, x.T @ (labels - p) - penalty @ w)
        w = w + step
        if np.abs(step).max() < 1e-8:
            break
    ends = np.cumsum([len(e) + 1 for e in edges])
    return float(w[-1]), edges, np.split(w[:-1], ends[:-1])


def evidence(columns: list[Column], model: tuple[float, list[np.ndarray], list[np.ndarray]]) -> Column:
    """Log-odds as an expression."""
    bias, edges, weights = model
    out = F.lit(bias)
    for c, e, w in zip(columns, edges, weights):
        step = F.lit(float(w[-1]))
        for edge, weight in zip(e[::-1], w[-2::-1]):
            step = F.when(c < float(edge), F.lit(float(weight))).otherwise(step)
        out = out + step
    return out


def _strength(mean: float, spread: float) -> float:
    """Documents that a prior with this mean counts for, if groups spread by this variance around it."""
    return float(np.clip(mean * (1 - mean) / spread - 1 if spread > 0 else 1e6, 1.0, 1e6))


def _logit(p: Column) -> Column:
    p = F.least(F.greatest(p, F.lit(1e-6)), F.lit(1 - 1e-6))
    return F.log(p / (1 - p))


def _spread(groups: DataFrame, parent: str) -> float:
    """Variance of groups' rates around their parents', beyond what their own sizes explain."""
    rate = F.col("good") / F.col("n")
    between = F.sum(F.col("n") * (rate - F.col(parent)) ** 2) / F.sum("n")
    within = F.sum(F.col("spread")) / F.sum("n")  # n times the variance of a mean of n
    return groups.agg((between - within).alias("v")).first()[0] or 0.0


def score(docs: DataFrame, labels: DataFrame, host: Column, path: Column) -> DataFrame:
    """(doc_id, evidence, host_rate, path_rate, score, keep) of every row of ``docs`` (doc_id, text and what host and path read)."""
    stats = statistics(F.col("text"))
    none = F.lit("")
    base = docs.select(F.col("doc_id"), F.coalesce(host.cast("string"), none).alias("host"), F.coalesce(path.cast("string"), none).alias("path"), *(c.cast("double").alias(k) for k, c in stats.items()))
    with temporary():
        base = store(base, "quality-statistics", keep=True)
        known = labels.where(F.col("quality").isNotNull()).groupBy("doc_id").agg(F.max(F.col("quality").cast("int")).alias("y"))
        known = known.where(F.col("doc_id").isNotNull())
        share = min(1.0, MAX_LABELLED / max(1, known.count()))
        chosen = known if share == 1 else known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < int(share * (1 << 30)))
        rows = np.array([tuple(r) for r in base.join(chosen, "doc_id").orderBy("doc_id").select(*stats, "y").collect()], float).reshape(-1, len(stats) + 1)
        model = fit(rows[:, :-1], rows[:, -1])
        own = base.select("doc_id", "host", "path", evidence([F.col(k) for k in stats], model).alias("evidence"))
        own = own.withColumn("p", 1 / (1 + F.exp(-F.col("evidence"))))

        paths = store(own.groupBy("host", "path").agg(F.sum("p").alias("good"), F.count(F.lit(1)).alias("n"), F.sum(F.col("p") ** 2).alias("squares")), "quality-paths")
        n, good = paths.agg(F.sum("n"), F.sum("good")).first()
        mean = float(np.clip(good / n, 1e-6, 1 - 1e-6)) if n else 0.5
        rate = F.col("good") / F.col("n")
        spread = F.greatest(F.col("squares") / F.col("n") - rate * rate, F.lit(0.0))
        hosts = paths.groupBy("host").agg(*(F.sum(c).alias(c) for c in ("good", "n", "squares"))).withColumn("spread", spread).withColumn("global", F.lit(mean))
        s = _strength(mean, _spread(hosts, "global"))
        hosts = hosts.select("host", ((s * mean + F.col("good")) / (s + F.col("n"))).alias("host_rate"))
        paths = paths.withColumn("spread", spread).join(small(store(hosts, "quality-hosts")), "host")
        s = _strength(mean, _spread(paths, "host_rate"))
        rates = store(paths.select("host", "path", "host_rate", ((s * F.col("host_rate") + F.col("good")) / (s + F.col("n"))).alias("path_rate")), "quality-rates", keep=True)
    out = own.join(small(rates), ["host", "path"])
    logit = F.col("evidence") - float(np.log(mean / (1 - mean))) + _logit(F.col("path_rate"))
    out = out.withColumn("score", 1 / (1 + F.exp(-logit)))
    return out.select("doc_id", "evidence", "host_rate", "path_rate", "score", (F.col("score") >= KEEP).alias("keep"))
