"""Quality classifier: ordinal cumulative-link regression on graded ratings.

Grades are 0 (rated as poor), 1 (rated as good but toxic) and 2 (rated as good and not toxic).  One set of weights over hashed
text features gives a position s on the grade scale, and ordered thresholds t0 < t1 give P(grade <= k) = logistic(t_k - s).
From these follow the expected grade and the tail probability P(grade >= 2), by which documents are selected.

Features: lower-cased words and their first bytes, byte trigrams, and a few counts (distinct words, symbols, repeated lines, length) in steps; each
kind is a vector of logarithmic counts of fixed length, hashed into 2**18 weights.  A further kind, in 2**20 weights of its own, says which words
are present and is not divided by the length; of these, training uses words that are far more frequent in toxic documents than in good ones.  Training takes at most ``TRAIN`` rated
documents: rare grades whole, of the others those whose ids have the smallest hashes, weighted to the shares of all ratings; their sparse features are all that the driver sees.  Weights are one broadcast of
5 MB; every whole text is scored in one pass without a shuffle.

Nulls, empty texts and texts without words get expected grade 0, probability 0 and are rejected.  Repeated rows are scored
each for itself.  Several ratings of one id all count.  Without any rating every text with words keeps probability 1.  All columns
of the documents are kept.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from gleanery.llm import words as W

BITS = 18
TRAIN = 10_000
EPOCHS = 12
RATE = 3.0
DECAY = 1e-6
GRADES = 3
SELECT = 0.8
LEAST_DOCS = 6
_SYMBOL = np.zeros(256, bool)
_SYMBOL[[ord(c) for c in "#*$%&|<>@^~_=+{}[]\\"]] = True
# Length of each kind's vector: words, trigrams, counts, heads.
SCALE = np.array([6.0, 2.0, 2.0, 6.0], np.float32)
# Bytes of a word's head.
HEAD = 5
# Slots of words that are present, beyond those of the other kinds, and their value.
PRESENT_BITS = 20
SLOTS = (1 << BITS) + (1 << PRESENT_BITS)
PRESENT = 1.0
# A present word is used if it is in so many toxic documents of the sample, and so many times as frequent in them as in good ones.
TELLING_DOCS = 3
TELLING = 5.0


def _index(keys: np.ndarray, kind: int, bits: int = BITS) -> np.ndarray:
    with np.errstate(over="ignore"):
        return (W.mix(keys ^ W.STEP[40 + kind]) >> W.U64(64 - bits)).astype(np.int64)


def _steps(words: np.ndarray, text: bytes) -> np.ndarray:
    """Counts of a text as step numbers, one feature each."""
    n = len(words)
    lines = [line for line in text.split(b"\n") if line.strip()]
    data = np.frombuffer(text, np.uint8)
    values = (
        len(np.unique(words)) / n, 1 - len(set(lines)) / max(1, len(lines)), min(1.0, 5 * float(_SYMBOL[data].mean())),
        min(1.0, np.log2(n) / 16), min(1.0, len(data) / n / 20), min(1.0, len(lines) / n * 4),
    )
    return np.array([k * 64 + int(v * 20) + 1 for k, v in enumerate(values)], np.uint64)


# Characters of text whose features are made together.
WINDOW = 500_000


def features(texts: list[str | None]) -> Iterator[tuple[np.ndarray, ...] | None]:
    """Per text the indexes of its words, trigrams, counts, word heads and present words; None for texts without words."""
    at = 0
    while at < len(texts):
        to, held = at, 0
        while to < len(texts) and (to == at or held < WINDOW):
            held += len(texts[to] or "")
            to += 1
        data, begin = W.joined(texts[at:to])
        buffer = np.frombuffer(data, np.uint8)
        starts, ends = W.spans(buffer)
        hashed, first = W.hashes(buffer, starts, ends), np.searchsorted(starts, begin)
        wide = buffer.astype(np.uint64)
        grams = _index(wide[:-2] | wide[1:-1] << W.U64(8) | wide[2:] << W.U64(16), 1) if len(wide) > 2 else np.empty(0, np.int64)
        word_index, heads = _index(hashed, 0), _index(W.hashes(buffer, starts, np.minimum(ends, starts + HEAD)), 3)
        present = _index(hashed, 4, PRESENT_BITS) + (1 << BITS)
        for k in range(to - at):
            a, b = first[k], first[k + 1]
            if b == a:
                yield None
                continue
            x, y = begin[k], begin[k + 1] - 1
            yield word_index[a:b], grams[x : max(x, y - 2)], _index(_steps(hashed[a:b], data[x:y]), 2), heads[a:b], present[a:b]
        at = to


def _weighted(parts: tuple[np.ndarray, ...]) -> tuple[np.ndarray, np.ndarray]:
    """Sparse vector of a text."""
    index, value = [], []
    for k, part in enumerate(parts[:4]):
        keys, count = np.unique(part, return_counts=True)
        raw = np.log1p(count.astype(np.float32))
        index.append(keys)
        value.append(raw * (SCALE[k] / max(1e-9, float(np.sqrt(raw @ raw)))))
    # That a word is there weighs the same in a text of any length.
    index.append(np.unique(parts[4]))
    value.append(np.full(len(index[-1]), PRESENT, np.float32))
    return np.concatenate(index), np.concatenate(value).astype(np.float32)


class Ordinal:
    """Shared weights and ordered thresholds."""

    def __init__(self, weights: np.ndarray, thresholds: np.ndarray):
        self.weights, self.thresholds = weights, thresholds

    def tails(self, position: np.ndarray) -> np.ndarray:
        """P(grade > k) for every k below the highest grade."""
        return 1 / (1 + np.exp(np.clip(self.thresholds[None, :] - position[:, None], -60, 60)))

    def positions(self, texts: list[str | None]) -> np.ndarray:
        """Place of each text on the grade scale; not a number for texts without words."""
        out = np.full(len(texts), np.nan)
        for k, parts in enumerate(features(texts)):
            if parts is not None:
                index, value = _weighted(parts)
                out[k] = self.weights[index] @ value
        return out


def fit(rows: list[tuple[np.ndarray, np.ndarray]], grades: np.ndarray, weight: np.ndarray, epochs: int = EPOCHS, rate: float = RATE, batch: int = 32) -> Ordinal:
    """Weighted maximum likelihood by stochastic gradient steps over small batches in a fixed order."""
    weights = np.zeros(SLOTS, np.float32)
    share = np.clip(np.cumsum(np.bincount(grades, weight, GRADES))[:-1] / max(1e-9, weight.sum()), 0.01, 0.99)
    base = np.log(share / (1 - share))
    theta = np.concatenate((base[:1], np.log(np.maximum(np.diff(base), 0.05))))
    theta_seen = np.full(len(theta), 1e-4)
    # Features of few documents would only learn those documents by heart.
    held = np.zeros((GRADES, SLOTS), np.int32)
    for (keys, _), grade in zip(rows, grades):
        held[grade, keys] += 1
    spread = held.sum(0) >= LEAST_DOCS
    toxic, good = (held[k, 1 << BITS :] for k in (1, 2))
    n_toxic, n_good = (max(1, int((grades == k).sum())) for k in (1, 2))
    spread[1 << BITS :] = (toxic >= TELLING_DOCS) & (toxic * n_good >= TELLING * n_toxic * (good + 1))
    full = np.array([spread[keys].any() for keys, _ in rows], bool)
    rows, grades, weight = [row for row, some in zip(rows, full) if some], grades[full], weight[full]
    order = np.random.default_rng(7)
    for _ in range(epochs):
        places = order.permutation(len(rows))
        for at in range(0, len(rows), batch):
            some = places[at : at + batch]
            index = np.concatenate([rows[k][0] for k in some])
            owner = np.repeat(np.arange(len(some)), [len(rows[k][0]) for k in some])
            known = spread[index]
            index, owner, value = index[known], owner[known], np.concatenate([rows[k][1] for k in some])[known]
            edge = np.searchsorted(owner, np.arange(len(some)))
            s = np.add.reduceat(weights[index] * value, edge).astype(np.float64)
            cuts = np.concatenate((theta[:1], theta[0] + np.cumsum(np.exp(theta[1:]))))
            F_ = 1 / (1 + np.exp(np.clip(s[:, None] - cuts[None, :], -60, 60)))
            F_ = np.concatenate((np.zeros((len(s), 1)), F_, np.ones((len(s), 1))), 1)
            slope = F_ * (1 - F_)
            y = grades[some]
            r = np.arange(len(s))
            p = np.maximum(F_[r, y + 1] - F_[r, y], 1e-9)
            up, down = weight[some] * slope[r, y + 1] / p, weight[some] * slope[r, y] / p
            # Of the negative log-likelihood: up - down, in a form that stays right where p is too small to divide by.
            d_s = weight[some] * (1 - F_[r, y + 1] - F_[r, y])
            g = np.repeat(d_s, np.diff(np.append(edge, len(index)))).astype(np.float32) * value
            keys, back = np.unique(index, return_inverse=True)
            # Plain steps: a feature gains by how consistently it pulls, not by how rare it is.
            weights[keys] -= rate * (np.bincount(back, g).astype(np.float32) / len(s) + DECAY * weights[keys])
            d_cut = np.zeros(len(cuts))
            np.add.at(d_cut, y[y < len(cuts)], -up[y < len(cuts)])
            np.add.at(d_cut, y[y > 0] - 1, down[y > 0])
            d_theta = np.cumsum(d_cut[::-1])[::-1] / len(s)
            d_theta[1:] *= np.exp(theta[1:])
            theta_seen += d_theta * d_theta
            theta -= 0.1 * d_theta / np.sqrt(theta_seen)
    cuts = np.concatenate((theta[:1], theta[0] + np.cumsum(np.exp(theta[1:]))))
    return Ordinal(weights, cuts)


def _sparse() -> Callable:
    schema = pa.schema([("id", pa.int64()), ("grade", pa.int64()), ("index", pa.list_(pa.int32())), ("value", pa.list_(pa.float32()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [_weighted(p) if p is not None else None for p in features(batch.column(2).to_pylist())]
            keep = [k for k, m in enumerate(made) if m is not None]
            ids, grade = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            yield pa.RecordBatch.from_arrays([
                pa.array([ids[k] for k in keep], pa.int64()), pa.array([grade[k] for k in keep], pa.int64()),
                pa.array([made[k][0].astype(np.int32) for k in keep], pa.list_(pa.int32())),
                pa.array([made[k][1] for k in keep], pa.list_(pa.float32()))], schema=schema)

    return run


def train(docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text_column: str = "text", most: int = TRAIN) -> Ordinal:
    """Fit on at most ``most`` rated documents."""
    grade = F.when(F.col("quality") == 0, 0).when(F.col("toxic") == 1, 1).otherwise(2)
    rated = (
        labels.where("quality is not null").select(F.col(id_column).cast("bigint").alias("id"), grade.cast("bigint").alias("grade"))
        .where("id is not null")
    )
    # Rare grades whole, the others by equal shares of what is left; weights give every grade its share of all ratings.
    count = {g: c for g, c in rated.groupBy("grade").count().collect()}
    room, taken = most, {}
    for k, g in enumerate(sorted(count, key=lambda g: (count[g], g))):
        taken[g] = min(count[g], room // (len(count) - k))
        room -= taken[g]
    drawn = [rated.where(F.col("grade") == g).orderBy(F.xxhash64("id"), "id").limit(n) for g, n in sorted(taken.items())]
    rated = reduce(DataFrame.unionAll, drawn) if drawn else rated.limit(0)
    texts = docs.select(F.col(f"`{id_column}`").cast("bigint").alias("id"), F.col(f"`{text_column}`").cast("string").alias("text"))
    # At most ``most`` ids: a broadcast of known size.
    sample = texts.join(F.broadcast(rated), "id").select("id", "grade", "text").mapInArrow(
        _sparse(), "id bigint, grade bigint, index array<int>, value array<float>").toArrow()
    order = np.lexsort((sample["grade"].to_numpy(), sample["id"].to_numpy()))
    if not len(order):
        return Ordinal(np.zeros(SLOTS, np.float32), np.full(GRADES - 1, -60.0))
    grades = sample["grade"].to_numpy()[order].astype(np.int64)
    index, value = sample["index"].combine_chunks(), sample["value"].combine_chunks()
    del sample
    edge, keys, values = index.offsets.to_numpy(), index.values.to_numpy(), value.values.to_numpy()
    rows = [(keys[edge[k] : edge[k + 1]], values[edge[k] : edge[k + 1]]) for k in order]  # views, not copies
    share = np.array([count.get(g, 0) / max(1, taken.get(g, 0)) for g in range(GRADES)])[grades]
    return fit(rows, grades, share / share.mean())


def _score(model):
    """A scalar Arrow function of the text, so that all other columns stay in the JVM."""
    def run(texts: pa.Array) -> pa.Array:
        m: Ordinal = model.value
        position = m.positions(texts.to_pylist())
        tails = np.where(np.isnan(position)[:, None], 0.0, m.tails(np.nan_to_num(position)))
        W.release()
        return pa.StructArray.from_arrays([pa.array(tails.sum(1)), pa.array(tails[:, -1])], names=["e", "p"])

    # Not repeated where a filter or a second column asks for the result again.
    return arrow_udf(run, "e double, p double").asNondeterministic()


def scored(docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text_column: str = "text", most: int = TRAIN, select: float = SELECT) -> DataFrame:
    """All columns of ``docs``, _expected_grade, _p_top and _kept."""
    model = docs.sparkSession.sparkContext.broadcast(train(docs, labels, id_column, text_column, most))
    named = [f"c{k}" for k in range(len(docs.columns))]
    plain = docs.toDF(*named)
    out = plain.withColumn("found", _score(model)(F.col(named[docs.columns.index(text_column)]).cast("string")))
    return out.select(*[F.col(n).alias(c) for n, c in zip(named, docs.columns)], F.col("found.e").alias("_expected_grade"),
                      F.col("found.p").alias("_p_top"), (F.col("found.p") >= select).alias("_kept"))
