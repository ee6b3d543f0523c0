"""Toxicity: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Features are the words, word pairs and pairs with one word between, as they occur or not, hashed
into a fixed number of coordinates.  A word also counts by its first letters, as a stem, so that
forms of a word that no labelled text holds are judged by those that some do.  Training takes a bounded sample of labelled rows through one
task, coordinate by coordinate at its own rate; the L1 term keeps most weights at zero, so what
the driver gets and broadcasts is a short list whose length the number of coordinates bounds.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_WORD = re.compile(r"[^\W_]+")
_PAIR, _SKIP = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
_MIX = np.uint64(0xFF51AFD7ED558CCD)
CACHE_WORDS = 1 << 18
#: Letters of the stems.
STEMS = (3, 4, 5)


def _hash(data: bytes) -> bytes:
    return (zlib.crc32(data) | zlib.crc32(data, 0x5BD1E995) << 32).to_bytes(8, "little")


@dataclass(frozen=True)
class Settings:
    """max_train bounds the labelled rows that training sees, whatever the corpus has."""

    bits: int = 20
    alpha: float = 0.5
    beta: float = 1.0
    l1: float = 5.0
    l2: float = 1.0
    max_train: int = 20_000
    epochs: int = 3


@dataclass(frozen=True)
class Model:
    """Intercept, and the non-zero weights by their coordinates."""

    bits: int
    intercept: float
    at: np.ndarray
    weight: np.ndarray

    def dense(self) -> np.ndarray:
        out = np.zeros(1 << self.bits, np.float64)
        out[self.at] = self.weight
        return out


class Features:
    """Coordinates of a text's features, each once."""

    def __init__(self, bits: int):
        self.shift = np.uint64(64 - bits)
        self.known: dict[str, bytes] = {}

    def _new(self, words: list[str]) -> None:
        if len(self.known) > CACHE_WORDS:
            self.known.clear()
        for w in set(words):
            if w not in self.known:
                forms = (w, *(f"{w[:k]}-" if len(w) > k else f"{w}--{k}" for k in STEMS))
                self.known[w] = b"".join(_hash(f.encode("utf-8", "surrogatepass")) for f in forms)

    def coordinates(self, text: str | None) -> np.ndarray:
        words = _WORD.findall((text or "").lower())
        if not words:
            return np.zeros(0, np.int64)
        try:
            data = b"".join(map(self.known.__getitem__, words))
        except KeyError:
            self._new(words)
            data = b"".join(map(self.known.__getitem__, words))
        forms = np.frombuffer(data, "<u8").reshape(len(words), -1)
        one = forms[:, 0]
        every = np.concatenate([forms.reshape(-1), one[:-1] * _PAIR + one[1:], one[:-2] * _SKIP + one[2:]])
        every ^= every >> np.uint64(29)
        return ((every * _MIX) >> self.shift).astype(np.int64)


class Ftrl:
    def __init__(self, s: Settings):
        self.s = s
        # the last coordinate is the intercept, which L1 does not hold back
        self.z = np.zeros((1 << s.bits) + 1)
        self.n = np.zeros((1 << s.bits) + 1)

    def weights(self, at: np.ndarray) -> np.ndarray:
        z, n, s = self.z[at], self.n[at], self.s
        l1 = np.where(at == len(self.z) - 1, 0.0, s.l1)
        held = np.sign(z) * np.maximum(np.abs(z) - l1, 0.0)
        return -held / ((s.beta + np.sqrt(n)) / s.alpha + s.l2)

    def learn(self, at: np.ndarray, label: int) -> None:
        at = np.append(np.unique(at), len(self.z) - 1)
        w = self.weights(at)
        g = 1.0 / (1.0 + np.exp(-np.clip(w.sum(), -35.0, 35.0))) - label
        n = self.n[at]
        self.z[at] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / self.s.alpha * w
        self.n[at] = n + g * g


def train(labelled: DataFrame, settings: Settings = Settings()) -> Model:
    """A model of rows (doc_id, text, label 0 or 1).

    Rows with another or a null label are left out.  At most settings.max_train rows are used, those
    that come first by a hash of doc_id and text; all run through one task, which so has a bounded
    input.  Without rows the model has no weights and scores 0.5.
    """
    order = F.xxhash64("doc_id", "text")
    sample = (
        labelled.where(F.col("label").isin(0, 1))
        .select("text", F.col("label").cast("int").alias("label"), order.alias("o"), "doc_id")
        .orderBy("o", "doc_id")
        .limit(settings.max_train)
        .select("text", "label")
    )

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make, model, seen = Features(settings.bits), Ftrl(settings), []
        for batch in batches:
            for text, label in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                at = np.unique(make.coordinates(text)).astype(np.int32)
                seen.append((at, label))
                model.learn(at.astype(np.int64), label)
        for _ in range(settings.epochs - 1):
            for at, label in seen:
                model.learn(at.astype(np.int64), label)
        every = np.flatnonzero(np.abs(model.z) > settings.l1)
        every = np.union1d(every, [len(model.z) - 1])
        yield pa.RecordBatch.from_arrays([pa.array(every), pa.array(model.weights(every))], ["at", "weight"])

    rows = sample.coalesce(1).mapInArrow(fit, "at long, weight double").collect()  # coordinates bound it
    got = {r["at"]: r.weight for r in rows}
    intercept = got.pop(1 << settings.bits, 0.0)
    at = np.array(sorted(got), np.int64)
    return Model(settings.bits, intercept, at, np.array([got[a] for a in at.tolist()]))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id and score, from 0 to 1, of each row's whole text; a null or empty text scores by the intercept.  No rows give no rows."""
    known = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = known.value
        make, weight = Features(m.bits), m.dense()
        for batch in batches:
            out = np.empty(batch.num_rows)
            for i, text in enumerate(batch.column(1)):
                at = make.coordinates(text.as_py())
                hit = np.unique(at[weight[at] != 0.0])
                out[i] = m.intercept + weight[hit].sum()
            out = 1.0 / (1.0 + np.exp(-np.clip(out, -700.0, 700.0)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out)], ["doc_id", "score"])

    cols = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return cols.mapInArrow(run, "doc_id long, score double")


def held_out(doc_id: str = "doc_id") -> F.Column:
    """Whether a document is in the fifth that training never sees."""
    return F.coalesce(F.crc32(F.encode(F.col(doc_id).cast("string"), "UTF-8")) % 5 == 0, F.lit(False))


def labelled_rows(docs: DataFrame, labels: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """(doc_id, text, label) of labelled documents that are not held out, settings.max_train ids at most.

    A doc_id with several labels counts as toxic if one of them says so.  The ids are chosen by a
    hash from the labels alone; as the setting bounds them they are broadcast, and no other text
    moves.
    """
    known = (
        labels.where(F.col("toxic").isin(0, 1) & ~held_out() & F.col("doc_id").isNotNull())
        .groupBy("doc_id")
        .agg(F.max("toxic").alias("label"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(settings.max_train)
    )
    return docs.select("doc_id", "text").join(F.broadcast(known), "doc_id")


def scored(docs: DataFrame, labels: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """doc_id, held_out, score and predicted (1 from 0.5 on) of every row of docs.

    A row without a doc_id is scored like any other and not held out.  No rows of docs give no rows; without labels all score 0.5.
    """
    model = train(labelled_rows(docs, labels, settings), settings)
    return score(docs, model).select(
        "doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")
    )


def drop_toxic(docs: DataFrame, model: Model, threshold: float = 0.5) -> DataFrame:
    """docs whose text scores below the threshold, with their columns as they are.

    Texts are judged one by one, so repeated rows go or stay together and null texts stay unless
    the intercept alone reaches the threshold.  No rows give no rows.
    """
    known = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("boolean")
    def toxic(texts):
        import pandas as pd

        m = known.value
        make, weight = Features(m.bits), m.dense()
        edge = np.log(threshold / (1 - threshold))
        out = []
        for text in texts:
            at = make.coordinates(text)
            out.append(m.intercept + weight[np.unique(at[weight[at] != 0.0])].sum() >= edge)
        return pd.Series(out, dtype=bool)

    return docs.where(~toxic(F.col("text").cast("string")))
