"""Quality classifier: hashed word n-gram logistic regression, learned by follow-the-regularised-leader.

Features are shares of a text's n-grams, hashed to 2^BITS places: words, word
pairs, and 1- to 3-grams of word shapes (case, closing signs, and whether the
word ends a word triple that the text had before). A score is one sparse dot product.

Learning is FTRL-proximal on SHARDS parts of a sample bounded by MAX_TRAIN rows;
the parts' weights are averaged. The model has at most 2^BITS weights.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import doc_hash, packed

BITS = 18
MAX_TRAIN = 20_000   # expected number of labelled rows learned from, at most
SHARDS = 4
EPOCHS = 8
ALPHA, BETA, L1, L2 = 0.5, 1.0, 1e-4, 1e-4
ACCEPT = 0.7
MEMO = 400_000       # words remembered by a Python worker
STOPS = ".,;:!?"


class _Words(dict):
    """Word to (hash of the word) * 16 + shape."""

    def __missing__(self, word: str) -> int:
        if len(self) >= MEMO:
            self.clear()
        core = word.rstrip("".join(set(word) - {c for c in word if c.isalnum()}) or " ")
        tail = word[len(core):]
        end = 0 if not tail else 1 if len(tail) == 1 and tail in STOPS else 2
        if not core:
            shape = 15
        else:
            case = 2 if len(core) > 1 and core.isupper() else 1 if core[:1].isupper() else 0 if core.islower() else 3
            shape = case * 3 + end
        self[word] = got = (zlib.crc32(word.encode("utf-8", "replace")) << 4) | shape
        return got


_WORDS = _Words()
_MIX = np.uint64(0x9E3779B97F4A7C15)


def _mixed(*parts: np.ndarray) -> np.ndarray:
    h = np.zeros(len(parts[0]), np.uint64)
    for p in parts:
        h = (h ^ p) * _MIX
        h ^= h >> np.uint64(29)
    return h


def features(text: str | None, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """Places and shares of the n-grams of a whole text; none for a null or blank text."""
    words = (text or "").split()
    n = len(words)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0)
    packed_words = np.fromiter(map(_WORDS.__getitem__, words), np.int64, n).astype(np.uint64)
    word, shape = packed_words >> np.uint64(4), packed_words & np.uint64(15)
    if n > 2:
        _, first = np.unique(_mixed(word[:-2], word[1:-1], word[2:]), return_index=True)
        again = np.ones(n - 2, bool)
        again[first] = False
        shape[2:] += np.uint64(16) * again.astype(np.uint64)
    grams = [(1, 1.0, (word,)), (2, 1.0, (word[:-1], word[1:])), (3, 4.0, (shape,)), (4, 4.0, (shape[:-1], shape[1:])),
             (5, 4.0, (shape[:-2], shape[1:-1], shape[2:]))]
    places, shares = [], []
    for family, scale, parts in grams:
        if m := len(parts[-1]):
            places.append((_mixed(np.full(m, family, np.uint64), *[p[:m] for p in parts]) >> np.uint64(64 - bits)).astype(np.int64))
            shares.append(np.full(m, scale / m))
    return np.concatenate(places), np.concatenate(shares)


class Ftrl:
    """FTRL-proximal for logistic loss on sparse rows; place 2^bits is the intercept."""

    def __init__(self, bits: int = BITS):
        self.z, self.n = np.zeros((1 << bits) + 1), np.zeros((1 << bits) + 1)
        self.bias = 1 << bits

    def weights(self, at=slice(None)) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        return np.where(np.abs(z) <= L1, 0.0, -(z - np.sign(z) * L1) / ((BETA + np.sqrt(n)) / ALPHA + L2))

    def learn(self, at: np.ndarray, x: np.ndarray, label: int) -> None:
        w = self.weights(at)
        g = (1 / (1 + np.exp(-np.clip(w @ x, -35, 35))) - label) * x
        sigma = (np.sqrt(self.n[at] + g * g) - np.sqrt(self.n[at])) / ALPHA
        self.z[at] += g - sigma * w
        self.n[at] += g * g


def _rows(texts, bits):
    for text in texts:
        at, x = features(text, bits)
        places, inverse = np.unique(at, return_inverse=True)
        yield np.append(places, 1 << bits), np.append(np.bincount(inverse, x, len(places)), 1.0)


def fit(rows: DataFrame, bits: int = BITS, max_train: int = MAX_TRAIN) -> np.ndarray:
    """Weights, intercept last, from ``rows`` (doc_id, text, label 0/1). No rows: all zero.

    Of more than ``max_train`` rows a share is learned from that the hash of doc_id chooses.
    """
    n = rows.count()
    sample = rows.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < int((1 << 20) * min(1.0, max_train / max(n, 1))))

    def learn(batches):
        data = [(at.astype(np.int32), x.astype(np.float32), label) for pdf in batches
                for (at, x), label in zip(_rows(pdf["text"], bits), pdf["label"])]
        if not data:
            return
        model, order = Ftrl(bits), np.random.default_rng(7)
        for _ in range(EPOCHS):
            for i in order.permutation(len(data)):
                model.learn(*data[i])
        w = model.weights()
        at = np.flatnonzero(w)
        yield pd.DataFrame({"at": at, "w": w[at] * len(data), "n": 0})
        yield pd.DataFrame({"at": [-1], "w": [float(len(data))], "n": [1]})

    parts = (sample.select("doc_id", "text", "label").repartition(SHARDS, F.xxhash64("doc_id"))
             .sortWithinPartitions("doc_id").mapInPandas(learn, "at long, w double, n long"))
    got = parts.groupBy("at").agg(F.sum("w").alias("w")).toPandas()   # 2^bits + 2 rows at most
    out = np.zeros((1 << bits) + 1)
    total = got.loc[got["at"] < 0, "w"].sum()
    got = got[got["at"] >= 0]
    if total:
        out[got["at"].to_numpy()] = got["w"].to_numpy() / total
    return out


def scorer(spark: SparkSession, weights: np.ndarray):
    """A column function: score (0 to 1) of a text column."""
    bits = int(len(weights) - 1).bit_length() - 1
    shared = spark.sparkContext.broadcast(weights)   # 2^bits + 1 numbers

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        w, logits = shared.value, np.empty(len(texts))
        for i, text in enumerate(texts):
            at, x = features(text, bits)
            logits[i] = w[at] @ x + w[-1]
        return pd.Series(1 / (1 + np.exp(-np.clip(logits, -35, 35))))

    return score


def _fitted(docs: DataFrame, labels: DataFrame):
    marks = (labels.filter("doc_id is not null and quality is not null").groupBy("doc_id")
             .agg(F.avg(F.col("quality").cast("double")).alias("mark")).filter("mark <> 0.5")
             .select("doc_id", (F.col("mark") > 0.5).cast("int").alias("label")))
    teach = docs.select("doc_id", "text").filter(doc_hash() % 4 != 2).join(marks, "doc_id")
    return scorer(docs.sparkSession, fit(teach))


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, held_out, score, predicted.

    Learns from rows that ``labels`` (doc_id, quality) marks and whose crc32(doc_id)
    mod 4 is not 2. Null labels and ids teach nothing; an id labelled more than once
    counts by majority, and not at all on a tie. Null and blank texts get the
    intercept's score. Repeated rows are kept; other columns are ignored.
    """
    scored = docs.select("doc_id", _fitted(docs, labels)("text").alias("score"))
    return scored.select("doc_id", (doc_hash() % 4 == 2).alias("held_out"), "score",
                         (F.col("score") >= ACCEPT).cast("int").alias("predicted"))


def accepted(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``docs`` with its own columns, without the rows that ``classify`` rejects (score under ACCEPT)."""
    good = packed(docs, _fitted(docs, labels)("text").alias("__score"))
    return good.filter(F.col("__score") >= ACCEPT).select("__row.*")
