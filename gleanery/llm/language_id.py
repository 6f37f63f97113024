"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

Letters of a lower-cased text form n-grams of one to three characters, hashed into 2**16 features.  A text's features are term
frequencies times inverse document frequencies, scaled to unit length.  Document frequencies are counted over all training
documents.  The weights are trained with follow-the-regularised-leader (FTRL-proximal) under an elastic-net penalty, which
leaves most of them zero, on at most ``PER_LANGUAGE`` documents a language (those whose ids have the smallest hashes); a part of these is set
aside to calibrate the temperature of the softmax.  Model and frequencies are two broadcasts of fixed size.

Texts that are null or have no letter are ``und`` with score 0.  Without training rows every text is ``und``.  Rows with a null
language teach nothing.  Ties go to the language that sorts first.  Repeated rows are predicted each for itself.  Language,
source and id never enter a prediction.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleanery.llm import words as W

BITS = 16
ORDERS = (1, 2, 3)
PER_LANGUAGE = 1_000
EPOCHS = 3
ALPHA, BETA, L1, L2 = 0.5, 1.0, 0.5, 0.05
HELD_FOR_TEMPERATURE = 5
UNDETERMINED = "und"
_LETTER = re.compile(r"[^\W\d_]")
_OTHER = re.compile(r"[\W\d_]+")


def features(text: str | None) -> tuple[np.ndarray, np.ndarray] | None:
    """(indexes, counts) of a text's n-grams; None without letters."""
    # The pattern also finds numbers such as fractions and Roman numerals, which aren't letters.
    if not text or not any(found[0].isalpha() for found in _LETTER.finditer(text)):
        return None
    plain = f" {_OTHER.sub(' ', text.lower()).strip()} "
    count = np.zeros(1 << BITS, np.float32)
    for at in range(0, len(plain), 1 << 20):  # pieces that overlap by the longest n-gram less one
        codes = np.frombuffer(plain[at : at + (1 << 20) + ORDERS[-1] - 1].encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
        own = min(1 << 20, len(plain) - at)
        key = np.zeros(len(codes), np.uint64)
        for order in range(1, ORDERS[-1] + 1):
            with np.errstate(over="ignore"):
                key = key[: len(codes) - order + 1] * W.BASE + codes[order - 1 :] * W.STEP[50]
                if order in ORDERS:
                    index = ((key + W.U64(order)) * W.STEP[51] >> W.U64(64 - BITS)).astype(np.int64)[:own]
                    count += np.bincount(index, minlength=1 << BITS)
    index = np.flatnonzero(count)
    return index, count[index]


class Model:
    def __init__(self, languages: list[str], idf: np.ndarray, weights: np.ndarray, bias: np.ndarray, temperature: float):
        self.languages, self.idf, self.weights, self.bias, self.temperature = languages, idf, weights, bias, temperature

    def vector(self, found: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        index, count = found
        value = count / count.sum() * self.idf[index]
        return index, value / max(1e-12, float(np.sqrt(value @ value)))

    def logits(self, found: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
        index, value = self.vector(found)
        return value @ self.weights[index] + self.bias

    def predict(self, text: str | None) -> tuple[str, float]:
        found = features(text) if self.languages else None
        if found is None:
            return UNDETERMINED, 0.0
        z = self.logits(found) / self.temperature
        p = np.exp(z - z.max())
        k = int(np.argmax(p))
        return self.languages[k], float(p[k] / p.sum())


def _ftrl(rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, classes: int, epochs: int) -> tuple[np.ndarray, np.ndarray]:
    """FTRL-proximal, one row at a time; the bias is a feature that is always on and not penalised by L1."""
    size = (1 << BITS) + 1
    z, n = np.zeros((size, classes), np.float32), np.zeros((size, classes), np.float32)
    l1 = np.full((size, 1), L1, np.float32)
    l1[-1] = 0

    def weights(at) -> np.ndarray:
        return np.where(np.abs(z[at]) <= l1[at], 0, -(z[at] - np.sign(z[at]) * l1[at]) / ((BETA + np.sqrt(n[at])) / ALPHA + L2))

    order = np.random.default_rng(11)
    for _ in range(epochs):
        for k in order.permutation(len(rows)):
            at = np.append(rows[k][0], size - 1)
            value = np.append(rows[k][1], 1.0).astype(np.float32)
            w = weights(at)
            s = value @ w
            p = np.exp(s - s.max())
            p /= p.sum()
            p[labels[k]] -= 1
            g = value[:, None] * p[None, :]
            sigma = (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / ALPHA
            z[at] += g - sigma * w
            n[at] += g * g
    every = weights(np.arange(size)).astype(np.float32)
    return every[:-1], every[-1]


def _temperature(logits: np.ndarray, labels: np.ndarray) -> float:
    """The temperature of least cross-entropy on rows that training did not see."""
    if not len(logits):
        return 1.0
    best = (np.inf, 1.0)
    for t in np.exp(np.linspace(np.log(0.05), np.log(20), 121)):
        z = logits / t
        z = z - z.max(1, keepdims=True)
        loss = float((np.log(np.exp(z).sum(1)) - z[np.arange(len(z)), labels]).mean())
        best = min(best, (loss, float(t)))
    return best[1]


def _document_frequencies() -> Callable:
    schema = pa.schema([("feature", pa.int32()), ("docs", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        docs = np.zeros((1 << BITS) + 1, np.int64)
        for batch in batches:
            for text in batch.column(0).to_pylist():
                found = features(text)
                if found is not None:
                    docs[found[0]] += 1
                    docs[-1] += 1
        at = np.flatnonzero(docs)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(docs[at])], schema=schema)

    return run


def train(docs: DataFrame, teaches: Column, id_column: str = "doc_id", text_column: str = "text", lang_column: str = "lang",
          per_language: int = PER_LANGUAGE) -> Model:
    """Learn from the rows for which ``teaches`` holds and whose language is known."""
    known = docs.where(teaches & F.col(lang_column).isNotNull())
    texts = known.select(F.col(text_column).cast("string").alias("text"))
    counts = texts.mapInArrow(_document_frequencies(), "feature int, docs bigint").groupBy("feature").agg(F.sum("docs").alias("docs")).toArrow()
    df = np.zeros((1 << BITS) + 1)
    df[counts["feature"].to_numpy()] = counts["docs"].to_numpy()
    idf = np.log((1 + df[-1]) / (1 + df[:-1])).astype(np.float32) + 1
    # The group limit is applied before the shuffle, so a frequent language sends few rows.
    lowest = Window.partitionBy("lang").orderBy("h", "id")
    chosen = (
        known.select(F.col(id_column).alias("id"), F.col(lang_column).cast("string").alias("lang"), F.xxhash64(id_column).alias("h"))
        .withColumn("k", F.row_number().over(lowest)).where(F.col("k") <= per_language).select("id", "lang").distinct()
    )
    sample = (
        known.select(F.col(id_column).alias("id"), F.col(lang_column).cast("string").alias("lang"), F.col(text_column).cast("string").alias("text"))
        .join(F.broadcast(chosen), ["id", "lang"]).orderBy(F.xxhash64("id"), "id", "lang", "text").toLocalIterator()
    )
    rows, names, model = [], [], Model([], idf, np.empty(0), np.empty(0), 1.0)
    for row in sample:
        found = features(row["text"])
        if found is not None:
            rows.append(model.vector(found))
            names.append(row["lang"])
    languages = sorted(set(names))
    if not languages:
        return model
    labels = np.array([languages.index(n) for n in names])
    aside = np.arange(len(rows)) % HELD_FOR_TEMPERATURE == 0 if len(rows) >= 20 else np.zeros(len(rows), bool)
    weights, bias = _ftrl([r for r, a in zip(rows, aside) if not a], labels[~aside], len(languages), EPOCHS)
    logits = np.array([value @ weights[index] + bias for (index, value), a in zip(rows, aside) if a])
    return Model(languages, idf, weights, bias, _temperature(logits, labels[aside]))


def _predict(model) -> Callable:
    schema = pa.schema([("lang_pred", pa.string()), ("score", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [model.value.predict(t) for t in batch.column(1).to_pylist()]
            columns = [pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], schema=pa.schema([batch.schema.field(0), *schema]))

    return run


def identified(docs: DataFrame, model: Model, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(id, lang_pred, score) of every row, from its text alone."""
    held = docs.sparkSession.sparkContext.broadcast(model)
    pairs = docs.select(F.col(f"`{id_column}`").cast("bigint").alias(id_column), F.col(f"`{text_column}`").cast("string").alias("text"))
    return pairs.mapInArrow(_predict(held), f"`{id_column}` bigint, lang_pred string, score double")
