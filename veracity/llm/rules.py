"""Operator 7: quality rules.

Exact surface counts, and a hashed word and character n-gram logistic regression trained on
labelled rows, probability-calibrated (Platt), scored in Arrow batches against a fixed threshold.

Cases: a null or empty text has no words and fails the base rules; whole texts are scored, a very long one in a
slice of its own; an id may be missing; a probability equal to the threshold keeps; repeated rows are judged one by one; without usable labels (none, or one class) the verdict of the model is to keep; an empty
table gives an empty result; further columns of the input are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BASE, BYTE_CODE, IS_SPACE, U64, flat, grams, mix, per_text, piece_of, repeated, slices, small_batches, word_hashes, words

#: Hash buckets of the model, half for words and half for character n-grams.
BUCKETS = 1 << 16
#: Character n-gram length, in bytes.
CHARS = 4
#: Bounds of the training sample: rows, and characters that one of them gives.
TRAIN_ROWS, TRAIN_TEXT = 2500, 20_000
#: Rows are kept from this calibrated probability of good quality on.
THRESHOLD = 0.5

SYMBOL = np.zeros(256, bool)
SYMBOL[list(b"#*$%&|<>")] = True


@dataclass
class Model:
    weights: np.ndarray  # BUCKETS values
    scale: float  # Platt: p = 1 / (1 + exp(-(scale * raw + shift)))
    shift: float

    def probability(self, raw: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.scale * raw + self.shift, -40, 40)))


def features(raw: np.ndarray, offsets: np.ndarray, start: np.ndarray, end: np.ndarray, doc: np.ndarray):
    """Hashed n-grams of every text: (text number, bucket) of the words and pairs of words, and of the character
    n-grams that lie within one text."""
    half = BUCKETS // 2
    hashes = word_hashes(raw, start, end)
    same = doc[1:] == doc[:-1]
    with np.errstate(over="ignore"):
        pairs = mix(hashes[:-1][same] * BASE + hashes[1:][same])
    of_words = (np.concatenate([hashes, pairs]) % U64(half)).astype(np.int32)
    codes = grams(BYTE_CODE[raw], CHARS)
    text = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    within = text[: len(codes)] == text[CHARS - 1 :] if len(codes) else np.zeros(0, bool)
    of_chars = (mix(codes[within]) % U64(half)).astype(np.int32) + half
    return (np.concatenate([doc, doc[1:][same]]), of_words), (text[: len(codes)][within], of_chars), hashes


def mean_weight(weights: np.ndarray, where, n: int) -> np.ndarray:
    doc, bucket = where
    return np.bincount(doc, weights[bucket], n) / np.maximum(np.bincount(doc, minlength=n), 1)


def fit(texts: list[str | None], good: np.ndarray, steps: int = 120, l2: float = 1e-4) -> Model:
    """Logistic regression on mean n-gram indicators, three quarters of the rows; Platt scaling
    with class-balanced targets on the rest."""
    model = Model(np.zeros(BUCKETS), 0.0, 40.0)
    if len(texts) < 8 or good.min() == good.max():
        return model
    raw, offsets = flat(pa.array(texts, pa.string()))
    n = len(texts)
    rows, cols, vals = [], [], []
    for doc, bucket in features(raw, offsets, *words(raw, offsets))[:2]:
        key, count = np.unique(doc.astype(np.int64) * BUCKETS + bucket, return_counts=True)
        size = np.bincount(doc, minlength=n)
        rows.append(key // BUCKETS), cols.append(key % BUCKETS), vals.append(count / size[key // BUCKETS])
    row, col, val = map(np.concatenate, (rows, cols, vals))
    hold = np.arange(n) % 4 == 3
    if good[hold].min() == good[hold].max() or good[~hold].min() == good[~hold].max():
        hold[:] = False
    fitted = ~hold
    # Both classes weigh the same while fitting; Platt scaling then sets the real odds.
    weight = np.where(good, 0.5 / max(good[fitted].mean(), 1e-9), 0.5 / max(1 - good[fitted].mean(), 1e-9)) * fitted
    use = fitted[row]
    r, c, v = row[use], col[use], val[use]
    w, bias = np.zeros(BUCKETS), 0.0
    spread = np.sqrt(np.bincount(c, v * v, BUCKETS) / fitted.sum()) + 1e-3
    first, second = np.zeros(BUCKETS + 1), np.zeros(BUCKETS + 1)
    for step in range(1, steps + 1):  # Adam on features scaled by their spread
        raw_score = np.bincount(r, v * (w / spread)[c], n) + bias
        error = (1 / (1 + np.exp(-np.clip(raw_score, -40, 40))) - good) * weight / fitted.sum()
        g = np.append(np.bincount(c, v * error[r], BUCKETS) / spread + l2 * w, error.sum())
        first, second = 0.9 * first + 0.1 * g, 0.999 * second + 0.001 * g * g
        move = 0.05 * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
        w, bias = w - move[:-1], bias - move[-1]
    w = w / spread
    score = np.bincount(row, val * w[col], n) + bias
    part = hold if hold.any() else fitted
    s, y = score[part], good[part].astype(float)
    y = np.where(y > 0, (y.sum() + 1) / (y.sum() + 2), 1 / (len(y) - y.sum() + 2))
    a, b = 1.0, 0.0
    for _ in range(50):  # Newton
        p = 1 / (1 + np.exp(-np.clip(a * s + b, -40, 40)))
        d, g = p * (1 - p), np.array([((p - y) * s).sum(), (p - y).sum()])
        h = np.array([[(d * s * s).sum() + 1e-6, (d * s).sum()], [(d * s).sum(), d.sum() + 1e-6]])
        a, b = np.array([a, b]) - np.clip(np.linalg.solve(h, g), -2, 2)
    return Model(w, a, a * bias + b)


def train(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS, chars: int = TRAIN_TEXT) -> Model:
    """Fit on at most `rows` labelled ids, chosen by a hash of the id, and one text of each (of repeated ids the one of
    the smallest hash); a longer text gives `chars` characters from anywhere."""
    marked = labels.where(F.col("quality").isNotNull()).groupBy("doc_id").agg(F.min("quality").alias("quality"))
    chosen = marked.where("doc_id is not null").orderBy(F.xxhash64("doc_id", F.lit(7)), "doc_id").limit(rows)
    hash_ = F.xxhash64("doc_id", "text", F.lit(9))
    text = docs.select("doc_id", hash_.alias("hash"), piece_of(F.col("text"), hash_, chars).alias("text"))
    one = text.join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.min("quality").alias("quality"), F.min_by("text", "hash").alias("text"))
    got = one.toPandas().sort_values("doc_id")
    return fit(got["text"].tolist(), (got["quality"].to_numpy() > 0))


def repeated_lines(text: str | None) -> int:
    """Lines (split at \\n) with a word that equal an earlier line of the text."""
    if not text or "\n" not in text:
        return 0
    seen, found = set(), 0
    for line in text.split("\n"):
        if line.strip(" \t\n\v\f\r"):
            found += line in seen
            seen.add(line)
    return found


SCHEMA = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, quality_probability double"


def score(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """The counts, base verdict, probability and verdict of every row of docs(doc_id, text)."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # BUCKETS doubles: 512 KB at any input size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            for rows in slices(batch):
                raw, offsets = flat(rows["text"])
                n = len(offsets) - 1
                start, end, doc = words(raw, offsets)
                of_words, of_chars, hashes = features(raw, offsets, start, end, doc)
                count = np.bincount(doc, minlength=n)
                twice = repeated(doc, hashes, n)
                p = model.probability(mean_weight(model.weights, of_words, n) + mean_weight(model.weights, of_chars, n))
                failed = (count < 50) | (100 * twice > 50 * count)
                chars = per_text(offsets, ((raw & 0xC0) != 0x80) & ~IS_SPACE[raw])
                yield pa.RecordBatch.from_arrays(
                    [rows["doc_id"].combine_chunks().cast(pa.int64()), pa.array(count, pa.int64()), pa.array(chars, pa.int64()), pa.array(per_text(offsets, SYMBOL[raw]), pa.int64()),
                     pa.array([repeated_lines(t) for t in rows["text"].to_pylist()], pa.int64()), pa.array(twice, pa.int64()), pa.array(failed), pa.array(~failed & (p >= threshold)), pa.array(p)],
                    names=["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "quality_probability"],
                )

    return docs.select("doc_id", "text").mapInArrow(run, SCHEMA)


def quality_rules(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    return score(docs, train(docs, labels), threshold)
