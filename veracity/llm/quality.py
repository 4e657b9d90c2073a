"""Operator 3: hierarchical empirical Bayes quality classifier.

Evidence of a document is the log-odds of a small logistic classifier on its byte statistics,
without the base rate. Hosts and paths get posteriors by grouped aggregation: soft counts of good
documents, shrunk toward the level above (path to host, host to all) with prior strengths
estimated from the spread between hosts and between paths (method of moments). A document's
posterior adds its evidence to the log-odds of its path; below `threshold` it is rejected.

Cases: an id may be missing (such rows teach nothing); a very long text is read whole, in a slice of its own; a null text is empty; an empty text carries no evidence (it gets its path's rate); a null
host or path is a value of its own; ties at the threshold are kept; repeated rows are judged one
by one and each counts; without labels of both classes all rows carry no evidence; an empty table
gives an empty result; further columns pass through, those named like results are replaced.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import can_checkpoint, flat, repeated, slices, small_batches, word_hashes, words

#: Rows of the labelled sample that the classifier is fitted on, at most.
TRAIN_ROWS = 20_000
#: A table of path posteriors is broadcast up to so many rows (about 100 bytes each).
BROADCAST_ROWS = 50_000
THRESHOLD = 0.5
N_FEATURES = 9

_B = np.arange(256)
_CLASSES = np.stack([
    np.isin(_B, list(b"#*$%&|<>")), np.isin(_B, list(b"!?")), _B == ord("|"), (_B >= 48) & (_B <= 57),
    (_B >= 65) & (_B <= 90), (_B >= 97) & (_B <= 122), _B >= 128, np.isin(_B, [9, 10, 11, 12, 13, 32]),
]).astype(np.float64)


def byte_statistics(rows: pa.Table) -> np.ndarray:
    """Shares of byte classes in each text (smoothed, so that short texts say little), its share of
    repeated words and its log length."""
    raw, offsets = flat(rows["text"])
    start, end, doc = words(raw, offsets)
    n_words = np.bincount(doc, minlength=len(offsets) - 1)
    twice = repeated(doc, word_hashes(raw, start, end), len(n_words)) / (n_words + 20)
    hist = np.array([np.bincount(raw[a:b], minlength=256) for a, b in zip(offsets[:-1], offsets[1:], strict=True)])
    sign, shout, bar, digit, upper, lower, high, space = (hist @ _CLASSES.T).T
    n, gaps, letters = np.diff(offsets) + 50.0, space + 10, upper + lower + 50
    return np.stack([sign / n, np.minimum(shout / gaps, 2), np.minimum(bar / gaps, 2), digit / n, upper / letters, high / n, space / n, twice, np.log1p(np.diff(offsets))], 1)


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def byte_features(text: pd.Series) -> pd.Series:
    rows = pa.table({"text": pa.array(text, pa.string(), from_pandas=True)})
    return pd.Series([x for part in slices(rows) for x in byte_statistics(part)])


@dataclass
class Evidence:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    base: float  # share of good rows

    def log_odds(self, features: Column, length: Column) -> Column:
        """Evidence of a row without the base rate, as a native expression."""
        total = F.lit(0.0)
        for i in range(N_FEATURES):
            z = (F.get(features, i) - float(self.mean[i])) / float(self.scale[i])
            total = total + F.least(F.greatest(z, F.lit(-8.0)), F.lit(8.0)) * float(self.weights[i])
        return F.when(length > 0, total + float(self.weights[-1])).otherwise(0.0)


def fit(x: np.ndarray, good: np.ndarray, l2: float = 1.0) -> Evidence:
    """Ridge logistic regression by Newton's method, classes weighted alike: the intercept then
    holds no base rate."""
    if not len(good) or good.min() == good.max():
        return Evidence(np.zeros(N_FEATURES), np.ones(N_FEATURES), np.zeros(N_FEATURES + 1), 0.5)
    mean, scale = x.mean(0), x.std(0) + 1e-9
    z = np.c_[np.clip((x - mean) / scale, -8, 8), np.ones(len(x))]
    weight = np.where(good, 0.5 / good.mean(), 0.5 / (1 - good.mean()))
    w, ridge = np.zeros(N_FEATURES + 1), np.diag([l2] * N_FEATURES + [1e-6])
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve(z.T @ (z * (weight * p * (1 - p))[:, None]) + ridge, z.T @ (weight * (p - good)) + ridge @ w)
        w = w - np.clip(step, -1, 1)
        if np.abs(step).max() < 1e-9:
            break
    return Evidence(mean, scale, w, float(good.mean()))


def train(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> Evidence:
    """Fit on at most `rows` labelled ids, chosen by a hash of the id, and one text of each (of repeated ids the one of
    the smallest hash)."""
    marked = labels.where(F.col("quality").isNotNull()).groupBy("doc_id").agg(F.min("quality").alias("quality"))
    chosen = marked.where("doc_id is not null").orderBy(F.xxhash64("doc_id", F.lit(3)), "doc_id").limit(rows)
    described = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("doc_id", "quality", F.xxhash64("text").alias("hash"), byte_features("text").alias("x"))
    one = described.groupBy("doc_id").agg(F.min("quality").alias("quality"), F.min_by("x", "hash").alias("x"))
    found = one.toPandas().sort_values("doc_id")
    return fit(np.array(found["x"].tolist()).reshape(-1, N_FEATURES), found["quality"].to_numpy() > 0)


def logit(p: Column) -> Column:
    p = F.least(F.greatest(p, F.lit(1e-6)), F.lit(1 - 1e-6))
    return F.log(p / (1 - p))


def sigmoid(x: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-x))


def site_counts(judged: DataFrame) -> DataFrame:
    """host, path, good (soft count), n: the one grouped pass over judged(host, path, p), kept by a
    checkpoint because the posteriors read it several times."""
    can_checkpoint(judged.sparkSession)
    return judged.groupBy("host", "path").agg(F.sum("p").alias("good"), F.count("*").alias("n")).checkpoint()


def site_posteriors(paths: DataFrame) -> DataFrame:
    """Posteriors of site_counts(): each path's good rate shrunk to its host's, that to the rate of
    all. Prior strength: m(1-m)/v - 1, v the variance between groups net of sampling noise."""
    hosts = paths.groupBy("host").agg(F.sum("good").alias("host_good"), F.sum("n").alias("host_n"))

    def rate_and_strength(groups: DataFrame, good: str, n: str) -> tuple[float, float]:
        r = groups.agg(F.sum(good).alias("g"), F.sum(n).alias("n"), F.count("*").alias("k"), F.sum(F.col(good) * F.col(good) / F.col(n)).alias("q")).first()
        if not r["n"]:
            return 0.5, 1.0
        m = r["g"] / r["n"]
        between = (r["q"] - r["n"] * m * m - m * (1 - m) * (r["k"] - 1)) / r["n"]
        return m, float(min(max(m * (1 - m) / between - 1, 1.0), 1e4)) if between > 0 else 1e4

    m, host_k = rate_and_strength(hosts, "host_good", "host_n")
    _, path_k = rate_and_strength(paths, "good", "n")
    hosts = hosts.select(F.col("host").alias("h"), ((F.col("host_good") + host_k * m) / (F.col("host_n") + host_k)).alias("host_posterior"))
    path_posterior = (F.col("good") + path_k * F.col("host_posterior")) / (F.col("n") + path_k)
    return paths.join(hosts, F.col("host").eqNullSafe(F.col("h"))).select("host", "path", "host_posterior", path_posterior.alias("path_posterior"))


def classify(docs: DataFrame, labels: DataFrame, host: Column | None = None, path: Column | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """docs with evidence, host_posterior, path_posterior, quality_posterior and kept. Hosts are
    `source` and paths `source`/`lang` unless given."""
    spark = docs.sparkSession
    small_batches(spark)
    host = F.col("source") if host is None else host
    path = F.col("lang") if path is None else path
    model = train(docs, labels)
    added = ("evidence", "host_posterior", "path_posterior", "quality_posterior", "kept")
    base = docs.drop(*added)
    evidence = lambda d: d.withColumn("evidence", model.log_odds(byte_features("text"), F.coalesce(F.octet_length("text"), F.lit(0))))
    odds = float(np.log(max(model.base, 1e-6) / max(1 - model.base, 1e-6)))
    judged = evidence(base.select("text", host.alias("host"), path.alias("path"))).select("host", "path", sigmoid(F.col("evidence") + odds).alias("p"))
    sites = site_posteriors(site_counts(judged)).select(F.col("host").alias("_h"), F.col("path").alias("_p"), "host_posterior", "path_posterior")
    if sites.count() <= BROADCAST_ROWS:
        sites = F.broadcast(sites)
    joined = evidence(base).join(sites, host.eqNullSafe(F.col("_h")) & path.eqNullSafe(F.col("_p")), "left").drop("_h", "_p")
    posterior = sigmoid(F.col("evidence") + logit(F.col("path_posterior")))
    return joined.withColumn("quality_posterior", posterior).withColumn("kept", F.col("quality_posterior") >= threshold)
