"""Toxicity by a linear classifier over character n-grams scaled by naive Bayes log-count ratios.

A document's features are the distinct n-grams of its lower-cased words, boundaries included, hashed
into 2^BITS places. Each feature counts as its log ratio between the classes' smoothed document
shares; logistic regression with an L2 penalty, both classes weighing the same, is trained on top.

Training takes at most SAMPLE[c] labelled rows of class c, in the order of a hash of their keys, so it
needs the same memory at any size; scoring covers all rows. Labels, language, source and key are
never inputs of a score. Null texts count as empty; a text without features scores the bias alone. With one class or no
labels the score is the smoothed share of the class. A key labelled twice counts as toxic if any label
says so; of texts that repeat a key the smallest trains.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import map_arrow

BITS, SHORTEST, LONGEST = 20, 3, 6
#: Most training rows of class 0 and of class 1.
SAMPLE = (2000, 1000)
LEAST_DOCUMENTS, SMOOTHING, LEAST_RATIO, PENALTY, STEPS, RATE = 5, 1.0, 1.5, 5.0, 150, 0.05
#: Words whose features a worker keeps; beyond it, the half that came last goes.
CACHE = 400_000
_EDGES = ".,!?;:*#$%&|\"'()[]"


def word_features(word: str) -> np.ndarray:
    s = f"<{word.strip(_EDGES)}>"
    grams = {s[i : i + n] for n in range(SHORTEST, LONGEST + 1) for i in range(len(s) - n + 1)}
    return np.fromiter((xxhash.xxh3_64_intdigest(g) & ((1 << BITS) - 1) for g in grams), np.uint32)


class Features:
    """Distinct features of texts, with a cache of words; `chosen`, if given, is a mask of those that matter."""

    def __init__(self, chosen: np.ndarray | None = None):
        self.chosen, self.cache = chosen, {}
        self.none = np.zeros(0, np.uint32)

    def of_word(self, word: str) -> np.ndarray:
        found = word_features(word)
        if self.chosen is not None:
            found = found[self.chosen[found]]
        return found if len(found) else self.none

    def of(self, text: str | None) -> np.ndarray:
        cache = self.cache
        if len(cache) > CACHE:
            for w in list(cache)[CACHE // 2 :]:
                del cache[w]
        words = set((text or "").lower().split())
        for w in words.difference(cache):
            cache[w] = self.of_word(w)
        found = [x for x in map(cache.__getitem__, words) if len(x)]
        return np.unique(np.concatenate(found)) if found else self.none


def train(texts: list[str | None], labels: list[int]) -> tuple[np.ndarray, np.ndarray, float]:
    """Features that matter, their weights and the bias."""
    y = np.array(labels, np.float64)
    n, n1 = len(y), float(y.sum())
    if not n1 or n1 == n:
        return np.zeros(0, np.int64), np.zeros(0), float(np.log((n1 + 1) / (n - n1 + 1)))
    features = Features()
    rows = [features.of(t) for t in texts]
    sizes = [len(x) for x in rows]
    flat = np.concatenate(rows).astype(np.int64)
    df = np.bincount(flat, minlength=1 << BITS)
    df1 = np.bincount(flat, np.repeat(y, sizes), 1 << BITS)
    ratio = np.log((df1 + SMOOTHING) / (n1 + 2 * SMOOTHING)) - np.log((df - df1 + SMOOTHING) / (n - n1 + 2 * SMOOTHING))
    chosen = np.flatnonzero((df >= LEAST_DOCUMENTS) & (np.abs(ratio) > LEAST_RATIO))
    place = np.full(1 << BITS, -1)
    place[chosen] = np.arange(len(chosen))
    row = np.repeat(np.arange(n), sizes)[place[flat] >= 0]
    at = place[flat][place[flat] >= 0]
    value = ratio[chosen][at]
    share = np.where(y == 1, n / (2 * n1), n / (2 * (n - n1)))
    theta, mean, square = (np.zeros(len(chosen) + 1) for _ in range(3))
    for step in range(1, STEPS + 1):  # Adam
        z = np.bincount(row, value * theta[at], n) + theta[-1]
        error = share * (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y)
        slope = np.append(np.bincount(at, value * error[row], len(chosen)) / n + PENALTY * theta[:-1] / n, error.mean())
        mean, square = 0.9 * mean + 0.1 * slope, 0.999 * square + 0.001 * slope**2
        theta = theta - RATE * (mean / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.999**step)) + 1e-8)
    return chosen, theta[:-1] * ratio[chosen], float(theta[-1])


def sample(df: DataFrame, labels: DataFrame, learn: Column, key: str, text: str, label: str) -> DataFrame:
    known = labels.where(F.col(label).isNotNull() & learn).groupBy(F.col(key).alias("_key")).agg(F.max(label).alias("_label"))
    rows = [known.where(F.col("_label") == c).orderBy(F.xxhash64("_key"), "_key").limit(n) for c, n in enumerate(SAMPLE)]
    chosen = rows[0].union(rows[1])  # at most sum(SAMPLE) rows
    return df.select(F.col(key).alias("_key"), F.col(text).alias("_text")).join(F.broadcast(chosen), "_key").groupBy("_key").agg(F.min("_text").alias("_text"), F.max("_label").alias("_label"))


def fit(df: DataFrame, labels: DataFrame, learn: Column, key: str = "doc_id", text: str = "text", label: str = "toxic") -> tuple[np.ndarray, np.ndarray, float]:
    """The model, trained by one task on the bounded sample; its size is bounded by 2^BITS."""
    schema = T.StructType([T.StructField("feature", T.LongType()), T.StructField("weight", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts, ys = [], []
        for b in batches:
            texts += b.column(1).to_pylist()
            ys += b.column(2).to_pylist()
        chosen, weights, bias = train(texts, ys)
        yield pa.record_batch([pa.array(np.append(chosen, -1)), pa.array(np.append(weights, bias))], names=["feature", "weight"])

    rows = sample(df, labels, learn, key, text, label).repartition(1).mapInArrow(run, schema).toPandas()
    bias = rows.feature == -1
    return rows.feature[~bias].to_numpy(), rows.weight[~bias].to_numpy(), float(rows.weight[bias].sum())


@functools.lru_cache(maxsize=2)
def _scorer(model_id: str) -> Features:
    return Features(None)


def score(df: DataFrame, model: tuple[np.ndarray, np.ndarray, float], key: str = "doc_id", text: str = "text") -> DataFrame:
    """key and score, from 0 to 1, of every row."""
    chosen, weights, bias = model
    shared = df.sparkSession.sparkContext.broadcast((chosen.astype(np.uint32), weights.astype(np.float64)))
    name = xxhash.xxh3_128_hexdigest(chosen.tobytes() + weights.tobytes())
    schema = T.StructType([df.schema[key], T.StructField("score", T.DoubleType())])

    def step(rows: dict) -> dict:
        features = _scorer(name)
        if features.chosen is None:
            ids, values = shared.value
            features.weights = np.zeros(1 << BITS)
            features.weights[ids] = values
            features.chosen = np.zeros(1 << BITS, bool)
            features.chosen[ids] = True
        z = np.array([features.weights[features.of(t)].sum() for t in rows[text]]) + bias
        return {key: rows[key], "score": 1 / (1 + np.exp(-np.clip(z, -700, 700)))}

    return map_arrow(df.select(key, text), step, schema, text)


def classify(df: DataFrame, labels: DataFrame, held_out: Column, key: str = "doc_id", text: str = "text", label: str = "toxic") -> DataFrame:
    """key, held_out, score and predicted of every row; learns from labels whose key is not held out."""
    scored = score(df, fit(df, labels, ~held_out, key, text, label), key, text)
    return scored.select(key, held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
