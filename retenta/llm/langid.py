"""Language identification by segmentation-marginalised unigrams.

Each language has probabilities for the pieces of a fixed public vocabulary. A
word's probability is the sum over all ways to cut it into pieces, by the
forward algorithm; a text's is the product over its words. The probabilities
are learned by expectation-maximisation over all segmentations of the words of
a bounded training sample. The vocabulary is read from a parameter's path and never trained.
"""

from __future__ import annotations

import re
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import doc_hash, written

VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
TRAIN_DOCS = 1000      # expected number of documents learned from in each language, at most
ROUNDS = 2             # of expectation-maximisation
SMOOTHING = 0.1        # added to the expected count of each piece
SIGNS = 10_000         # an unknown sign is one of so many, equally likely
MEMO = 1_000_000         # words remembered by a Python worker
LONGEST = 32           # letters of a word taken at once; longer ones are read in parts of this length
MARK = "▁"        # begins a word
WORD = re.compile(r"[^\W\d_]+")


@lru_cache(2)
def pieces(path: str) -> dict[str, int]:
    """Piece to number: the vocabulary's pieces of letters, lower-cased, with or without the word mark."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    found = sorted({p.lower() for p in map(model.id_to_piece, range(model.get_piece_size()))})
    kept = [p for p in found if p != MARK and (p.lstrip(MARK).isalpha() and p.count(MARK) <= 1)]
    return {p: i for i, p in enumerate(kept)}


def words(text: str) -> list[str]:
    return [w[i:i + LONGEST] for w in WORD.findall(text.lower()) for i in range(0, len(w), LONGEST)]


class Lattice:
    """All pieces of many words of one length at once, as arrays.

    A piece is looked up by a 64-bit hash of its signs; the vocabulary is checked to have no two alike.
    """

    def __init__(self, vocabulary: dict[str, int]):
        self.size = len(vocabulary)
        self.longest = max(map(len, vocabulary), default=1)
        hashed = np.zeros(self.size, np.uint64)
        for piece, i in vocabulary.items():
            h = 0
            for c in piece:
                h = (h * 1_000_003 + ord(c)) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF
            hashed[i] = h
        self.order = np.argsort(hashed)
        self.sorted = hashed[self.order]
        assert len(np.unique(hashed)) == self.size

    def cuts(self, group: list[str]):
        """(start, end, piece of each word) with start ascending; size + 1 where there is none. Words are marked here."""
        n = len(group[0]) + 1
        signs = np.frombuffer("".join(MARK + w for w in group).encode("utf-32-le"), np.uint32).reshape(-1, n).astype(np.uint64)
        for start in range(n):
            h = np.zeros(len(group), np.uint64)
            for end in range(start + 1, min(n, start + self.longest) + 1):
                h = (h * np.uint64(1_000_003) + signs[:, end - 1]) * np.uint64(0x9E3779B97F4A7C15)
                at = np.minimum(np.searchsorted(self.sorted, h), self.size - 1)
                yield start, end, np.where(self.sorted[at] == h, self.order[at], self.size + 1)

    def forward(self, group: list[str], p: np.ndarray) -> np.ndarray:
        """alpha[place, word, language]: the summed probability of all segmentations up to each place."""
        n = len(group[0]) + 1
        alpha = np.zeros((n + 1, len(group), p.shape[1]))
        alpha[0] = 1.0
        for start, end, piece in self.cuts(group):
            if end == start + 1:
                alpha[end] += alpha[start] * p[self.size]      # any one sign, which keeps every word readable
            alpha[end] += alpha[start] * p[piece]
        return alpha

    def expected(self, group: list[str], times: np.ndarray, p: np.ndarray) -> np.ndarray:
        """Expected count of each piece (and the unknown sign) over ``times`` readings of the words; p has one column."""
        alpha, out = self.forward(group, p)[:, :, 0], np.zeros(self.size + 2)
        share = np.divide(times, alpha[-1], out=np.zeros(len(group)), where=alpha[-1] > 0)
        beta = np.zeros_like(alpha)
        beta[-1] = 1.0
        for start, end, piece in reversed(list(self.cuts(group))):
            if end == start + 1:
                beta[start] += p[self.size, 0] * beta[end]
                out[self.size] += (share * alpha[start] * p[self.size, 0] * beta[end]).sum()
            q = p[piece, 0]
            beta[start] += q * beta[end]
            out += np.bincount(piece, share * alpha[start] * q * beta[end], self.size + 2)
        return out[:-1]


def by_length(found: list[str], part: int = 20_000):
    """Indices of the words of one length, at most ``part`` at once."""
    lengths = np.fromiter(map(len, found), np.int64, len(found))
    for n in np.unique(lengths):
        at = np.flatnonzero(lengths == n)
        yield from (at[i:i + part] for i in range(0, len(at), part))


class Model:
    """p: (pieces + 2) x languages; the last rows are those of an unknown sign and of none."""

    def __init__(self, path: str, langs: list[str], p: np.ndarray):
        self.langs, self.lattice, self.p = langs, Lattice(pieces(path)), p
        self.forget()

    def forget(self) -> None:
        self.number: dict[str, int] = {}
        self.logs = np.zeros((0, max(len(self.langs), 1)))

    def predict(self, texts) -> list[tuple[str, float]]:
        """Language and its posterior under equal priors; ``und`` and 0 for texts without a letter."""
        if len(self.number) > MEMO:
            self.forget()
        number, known = self.number, len(self.number)
        rows = [np.fromiter((number.setdefault(w, len(number)) for w in words(t or "")), np.int64) for t in texts]
        new = list(number)[known:]
        logs = np.zeros((len(new), self.logs.shape[1]))
        for at in by_length(new):
            ends = self.lattice.forward([new[i] for i in at], self.p)[-1]
            logs[at] = np.log(np.maximum(ends, 1e-300))
        self.logs = np.concatenate([self.logs, logs])
        out = []
        for ids in rows:
            if not len(ids) or not self.langs:
                out.append(("und", 0.0))
                continue
            total = self.logs[ids].sum(axis=0)
            best = int(total.argmax())
            out.append((self.langs[best], float(1 / np.exp(total - total[best]).sum())))
        return out


def fit(rows: DataFrame, path: str = VOCABULARY, train_docs: int = TRAIN_DOCS) -> tuple[list[str], np.ndarray]:
    """Languages and piece probabilities from ``rows`` (doc_id, text, lang), lang not null."""
    vocabulary = pieces(path)
    size = len(vocabulary) + 1
    sizes = rows.groupBy("lang").agg(F.count("*").alias("n"))
    langs = sorted(r["lang"] for r in sizes.select("lang").collect())          # one row per language
    share = sizes.select(F.col("lang").alias("l"), F.least(F.lit(1.0), F.lit(float(train_docs)) / F.col("n")).alias("share"))
    sample = rows.join(F.broadcast(share), F.col("lang") == F.col("l")).filter(
        F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < F.col("share") * (1 << 20))

    def count(batches):
        for pdf in batches:
            for lang, texts in pdf.groupby("lang")["text"]:
                got: dict[str, int] = {}
                for text in texts:
                    for w in words(text or ""):
                        got[w] = got.get(w, 0) + 1
                yield pd.DataFrame({"lang": lang, "word": list(got), "n": list(got.values())})

    counted = written(sample.select("lang", "text").mapInPandas(count, "lang string, word string, n long")
                      .groupBy("lang", "word").agg(F.sum("n").alias("n")), "lang-words")
    def probabilities(counts: np.ndarray) -> np.ndarray:
        p = counts / counts.sum(axis=0)
        p[-1] /= SIGNS
        return np.vstack([p, np.zeros((1, p.shape[1]))])

    p = probabilities(np.ones((size, max(len(langs), 1))))
    number = {lang: i for i, lang in enumerate(langs)}
    for _ in range(ROUNDS if langs else 0):
        shared = rows.sparkSession.sparkContext.broadcast(p)                   # pieces x languages

        def expect(batches, shared=shared):
            lattice, p = Lattice(pieces(path)), shared.value
            out = np.zeros((p.shape[1], size))
            for pdf in batches:
                for lang, part in pdf.groupby("lang"):
                    found, n, i = part["word"].tolist(), part["n"].to_numpy(float), number[lang]
                    for at in by_length(found):
                        out[i] += lattice.expected([found[j] for j in at], n[at], p[:, i:i + 1])
            at, piece = np.nonzero(out)
            yield pd.DataFrame({"l": at, "piece": piece, "n": out[at, piece]})

        got = counted.mapInPandas(expect, "l long, piece long, n double").groupBy("l", "piece").agg(F.sum("n").alias("n")).toPandas()
        counts = np.full((size, len(langs)), SMOOTHING)
        np.add.at(counts, (got["piece"].to_numpy(), got["l"].to_numpy()), got["n"].to_numpy())
        p = probabilities(counts)
        shared.unpersist()
    return langs, p


_MODELS: dict[str, Model] = {}


def identify(docs: DataFrame, path: str = VOCABULARY, train_docs: int = TRAIN_DOCS) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text, lang): doc_id, held_out, lang_pred, score.

    Learns from rows whose crc32(doc_id) mod 5 is not 0 and whose lang is not null.
    lang_pred is ``und`` with score 0 for null texts and those without a letter, and for
    all where nothing could be learned. Null ids and repeated rows are kept; other columns are ignored.
    """
    import uuid

    teach = docs.select("doc_id", "text", "lang").filter((doc_hash() % 5 != 0) & F.col("lang").isNotNull())
    langs, p = fit(teach, path, train_docs)
    name, shared = uuid.uuid4().hex, docs.sparkSession.sparkContext.broadcast(p)   # pieces x languages

    @F.pandas_udf("lang_pred string, score double")
    def predict(texts: pd.Series) -> pd.DataFrame:
        if name not in _MODELS:                      # a worker keeps one model and its words
            _MODELS.clear()
            _MODELS[name] = Model(path, langs, shared.value)
        return pd.DataFrame(_MODELS[name].predict(texts), columns=["lang_pred", "score"])

    scored = docs.select("doc_id", predict("text").alias("x"))
    return scored.select("doc_id", (doc_hash() % 5 == 0).alias("held_out"), "x.lang_pred", "x.score")
