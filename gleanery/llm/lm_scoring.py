"""Language-model scores: a log-bilinear neural model trained with noise-contrastive estimation.

Tokens are words in lower case (A-Z) and one end mark per text.  The base score is the add-one unigram model over all training
tokens.  The log-bilinear model has a row of its own for the ``OWN`` most frequent words that occur at least ``LEAST`` times in
the training texts and for the end mark; all other words share rows by their hashes, about ``SHARING`` to a row and ``SHARED_ROWS`` rows
at most.  The vectors of the two tokens before, each times a matrix of its place, sum to a prediction.  The output has two levels.
The rows are cut into classes of about sqrt(n) of n rows; P(row | before) = P(class | before) P(row | class, before), each from
products of the prediction with vectors plus biases, so that normalising a token takes about 2 sqrt(n) products.  A word of a shared
row takes the row's probability times its share of the base model among the row's words and one unseen word, so the scores are
probabilities over all texts.

Work on the cluster:
1. Documents are dealt into buckets of bounded size by a hash of their ids; compressed packs of documents travel.  A bucket sends
   its distinct words with their counts in training texts, one packed row for each deal of words; a deal adds up the counts of
   its words over the whole corpus and sends each bucket the totals alone, in the order in which the words came.
2. The n-grams (two tokens before, token) of the training texts are dealt to parts of about ``PART_GRAMS`` tokens and counted
   there; in each round every part trains on its counts by NCE from the same start.  A part sends what it changed in the rows
   that it touched, in slices of rows; the next start is changed, row by row, by the mean weighted by how often each part touched
   the row.  Means are taken of ``FAN`` parts at a time, level by level, so that no task reads more than that.
3. A bucket's documents meet the totals of just the words of that bucket.  Tokens are normalised class by class in matrix
   products of bounded size.

Counts of words and n-grams grow with the corpus; the model has a bounded number of rows of ``2 * SIZE + 1`` numbers, which every
worker holds and every part sends once a round, so what is sent stays in proportion to the corpus.
A null text is an empty one: it has the end mark alone.  Repeated rows are scored each for itself, and count each in training.
Extra columns are not read.  Words are held by 64-bit hashes.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleanery.llm import words as W
from gleanery.session import stored

# Base of the numbers of (two before, one before, token) where they are packed into one.
VOCABULARY = 1 << 21
# Training occurrences of a word with a vector of its own.
LEAST = 5
# Most frequent words with a row of their own; words that share a row, and rows that are shared at most.
OWN = 1 << 15
SHARING = 64
SHARED_ROWS = 1 << 15
SIZE = 24
NOISE = 64
# Noise words of a run of tokens of one class, drawn in that class, and tokens in a run.
WITHIN = 16
RUN = 32
PART_GRAMS = 1 << 22
# Rows of the model that are averaged in one task, and parts averaged at a time.
SLICE = 1 << 12
FAN = 64
ROUNDS = 2
EPOCHS = 1
BATCH = 8192
RATE = 0.1
# Adagrad's sum of squares at the start.
START = 1e-8
LEAST_STEPS = 100
BUCKET_BYTES = 8 << 20
# Buckets of documents for each deal of words.
BUCKETS_A_DEAL = 2
# Characters of training texts counted together.
TOGETHER = 6 << 20
END = 0
END_KEY = np.int64(-7046029254386353131)


def _tokens(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of all texts with an end mark after each, and the edges of the texts."""
    hashed, first = W.word_hashes(texts)
    edge = first + np.arange(len(first))
    out = np.full(edge[-1], END_KEY, np.int64)
    inside = np.ones(edge[-1], bool)
    inside[edge[1:] - 1] = False
    out[inside] = hashed.view(np.int64)
    return out, edge


def _squeezed(*numbers: np.ndarray) -> bytes:
    """Columns of 64-bit numbers of one length as compressed byte planes."""
    planes = np.stack([n.astype(np.int64) for n in numbers]).view(np.uint8).reshape(len(numbers), -1, 8).transpose(0, 2, 1)
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(planes).tobytes())


def _widened(data: bytes, columns: int) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8).reshape(columns, 8, -1)
    return planes.transpose(0, 2, 1).copy().view(np.int64)[:, :, 0]


def _packs(buckets: int) -> Callable:
    """Documents (bucket, id, teaches, text) of a batch, compressed in one row per bucket."""
    schema = pa.schema([("bucket", pa.int64()), ("pack", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        options = pa.ipc.IpcWriteOptions(compression="zstd")
        for batch in batches:
            bucket = batch.column(0).to_numpy()
            order = np.argsort(bucket, kind="stable")
            bound = np.searchsorted(bucket[order], np.arange(buckets + 1))
            docs = batch.select([1, 2, 3])
            for k in np.flatnonzero(np.diff(bound)):
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, docs.schema, options=options) as out:
                    out.write_batch(docs.take(pa.array(order[bound[k] : bound[k + 1]])))
                yield pa.RecordBatch.from_arrays([pa.array([k], pa.int64()), pa.array([sink.getvalue().to_pybytes()], pa.binary())], schema=schema)

    return run


def _unpacked_docs(packs: Iterator) -> pa.Table:
    return pa.concat_tables([pa.ipc.open_stream(p.as_buffer()).read_all() for p in packs]).combine_chunks()


def _deal(words: np.ndarray, deals: int) -> np.ndarray:
    return (words.view(np.uint64) >> np.uint64(8)) % np.uint64(deals)


def _word_rows(deals: int) -> Callable:
    """Of one bucket: its distinct words, in order, and their counts in the training documents, packed in one row per deal of words."""
    def run(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        docs = _unpacked_docs(p for batch in batches for p in batch.column(1))
        tokens, edge = _tokens(docs["text"].to_pylist())
        words, back = np.unique(tokens, return_inverse=True)
        teaches = docs["teaches"].to_numpy(zero_copy_only=False)
        times = np.bincount(back, np.repeat(teaches, np.diff(edge)).astype(np.float64), len(words)).astype(np.int64)
        deal = _deal(words, deals)
        for k in np.unique(deal):
            mine = deal == k
            packed = _squeezed(np.diff(words[mine], prepend=np.int64(0)), times[mine])
            yield pa.RecordBatch.from_arrays([pa.array([int(k)]), pa.array([key[0].as_py()], pa.int64()), pa.array([packed], pa.binary())],
                                             names=["deal", "bucket", "packed"])
        W.release()

    return run


def _sums(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of one deal: the totals of each bucket's words, one packed row each, and under bucket -1 all words with their totals."""
    buckets, words, times = [], [], []
    for batch in batches:
        for bucket, packed in zip(batch.column(1).to_pylist(), batch.column(2)):
            gap, count = _widened(packed.as_buffer(), 2)
            buckets.append(bucket), words.append(np.cumsum(gap)), times.append(count)
    every, back = np.unique(np.concatenate(words), return_inverse=True)
    total = np.bincount(back, np.concatenate(times).astype(np.float64), len(every)).astype(np.int64)
    edge = np.cumsum([0, *map(len, words)])
    for bucket, a, b in zip(buckets, edge, edge[1:]):
        yield pa.RecordBatch.from_arrays([pa.array([bucket], pa.int64()), pa.array([key[0].as_py()], pa.int64()),
                                          pa.array([_squeezed(total[back[a:b]])], pa.binary())], names=["bucket", "deal", "packed"])
    yield pa.RecordBatch.from_arrays([pa.array([-1], pa.int64()), pa.array([key[0].as_py()], pa.int64()),
                                      pa.array([_squeezed(np.diff(every, prepend=np.int64(0)), total)], pa.binary())], names=["bucket", "deal", "packed"])
    W.release()


def _all_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for packed in batch.column(0):
            gap, total = _widened(packed.as_buffer(), 2)
            yield pa.RecordBatch.from_arrays([pa.array(np.cumsum(gap)), pa.array(total)], names=["word", "total"])


def _numbers(tokens: np.ndarray, keys: np.ndarray, number: np.ndarray, shared: int) -> np.ndarray:
    """Row of each token; ``keys`` is sorted and has the end mark.  The shared rows follow the end mark's."""
    at = np.minimum(np.searchsorted(keys, tokens), len(keys) - 1)
    return np.where(keys[at] == tokens, number[at], 1 + tokens % shared)


def _contexts(ids: np.ndarray, edge: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The number two and the number one before each token; the end mark stands before a text."""
    one, two = np.empty_like(ids), np.empty_like(ids)
    one[1:], two[2:] = ids[:-1], ids[:-2]
    starts = edge[:-1]
    one[starts] = END
    two[starts] = END
    second = starts[np.diff(edge) > 1] + 1
    two[second] = END
    return two, one


def _packed(gram: np.ndarray) -> bytes:
    """Columns of numbers sorted by their third row, as compressed byte planes with differences in that row."""
    gram = gram.astype(np.int32)
    gram[2, 1:] -= gram[2, :-1].copy()
    planes = np.ascontiguousarray(gram).view(np.uint8).reshape(len(gram), -1, 4).transpose(0, 2, 1)
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(planes).tobytes())


def _unpacked(data: bytes, rows: int) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8).reshape(rows, 4, -1)
    gram = planes.transpose(0, 2, 1).copy().view(np.int32)[:, :, 0]
    gram[2] = np.cumsum(gram[2])
    return gram


def _joined(gram: np.ndarray) -> np.ndarray:
    """One number per n-gram, in order of the token, then of the tokens before."""
    two, one, token = gram.astype(np.int64)
    return (token * VOCABULARY + one) * VOCABULARY + two


def _dealt(vocabulary, parts: int) -> Callable:
    """(two before, one before, token) of all tokens of the training texts, packed in one row per part and run of texts."""
    schema = pa.schema([("part", pa.int64()), ("grams", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, number, shared = vocabulary.value
        for batch in batches:
            texts, at = batch.column(0).to_pylist(), 0
            while at < len(texts):
                to, held = at, 0
                while to < len(texts) and (to == at or held + len(texts[to]) <= TOGETHER):
                    held += len(texts[to])
                    to += 1
                tokens, edge = _tokens(texts[at:to])
                ids = _numbers(tokens, keys, number, shared).astype(np.int32)
                gram = np.stack((*_contexts(ids, edge), ids))
                with np.errstate(over="ignore"):
                    part = W.mix((gram.astype(np.uint64) * W.STEP[:3, None]).sum(0)) % W.U64(parts)
                order = np.argsort(_joined(gram))
                order = order[np.argsort(part[order], kind="stable")]
                bound = np.searchsorted(part[order], np.arange(parts + 1))
                some = np.flatnonzero(np.diff(bound))
                yield pa.RecordBatch.from_arrays([
                    pa.array(some), pa.array([_packed(gram[:, order[bound[k] : bound[k + 1]]]) for k in some], pa.binary())], schema=schema)
                at = to

    return run


def _counted(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The different n-grams of one part in a fixed order, whatever the order of arrival, with their counts, packed in one row."""
    gram = np.concatenate([_unpacked(g, 3) for batch in batches for g in batch.column(1).to_pylist()], 1)
    joined, times = np.unique(_joined(gram), return_counts=True)
    rest, two = np.divmod(joined, VOCABULARY)
    token, one = np.divmod(rest, VOCABULARY)
    packed = _packed(np.stack((two, one, token, times)))
    yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()]), pa.array([packed], pa.binary())], names=["part", "grams"])


def _chance(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(np.clip(-x, -30, 30)))


def _log_sums(r: np.ndarray, target: np.ndarray, bias: np.ndarray) -> np.ndarray:
    """Log of the sum over all targets of the exponential of product plus bias, for each row; in strips that fit a core's cache."""
    out, ones = np.empty(len(r), np.float32), np.ones(len(bias), np.float32)
    both = np.ascontiguousarray(np.concatenate((target, bias[:, None]), 1).T)
    full = np.concatenate((r, np.ones((len(r), 1), np.float32)), 1)
    small = len(r) and np.sqrt((r * r).sum(1).max() * (target * target).sum(1).max()) + np.abs(bias).max() < 60
    for x in range(0, len(r), 1 << 9):
        s = full[x : x + (1 << 9)] @ both
        if small:
            out[x : x + len(s)] = np.log(np.exp(s, out=s) @ ones)
        else:
            top = s.max(1)
            out[x : x + len(s)] = np.log(np.exp(s - top[:, None]) @ ones) + top
    return out


class LogBilinear:
    """Vectors of preceding tokens, matrices of their places, and target vectors and biases of tokens and of their classes."""

    NAMES = ("before", "near", "far", "target", "bias", "class_target", "class_bias")

    def __init__(self, **arrays: np.ndarray):
        self.__dict__.update(arrays)
        self.width = self.shapes(len(self.bias))[0]
        # How often training touched each row, as context and as target or noise.
        self.used = np.zeros((2, len(self.bias)), np.float32)

    @staticmethod
    def shapes(n: int) -> tuple[int, tuple]:
        """Numbers in a class, and the shape of every array."""
        width = math.isqrt(n - 1) + 1
        classes = -(-n // width)
        return width, ((n, SIZE), (SIZE, SIZE), (SIZE, SIZE), (n, SIZE), (n,), (classes, SIZE), (classes,))

    @classmethod
    def start(cls, unigram: np.ndarray) -> LogBilinear:
        rng = np.random.default_rng(5)
        small = lambda *shape: rng.normal(0, 0.1, shape).astype(np.float32)
        n = len(unigram)
        width = cls.shapes(n)[0]
        mass = np.add.reduceat(unigram, np.arange(0, n, width))
        return cls(before=small(n, SIZE), near=np.eye(SIZE, dtype=np.float32), far=0.5 * np.eye(SIZE, dtype=np.float32),
                   target=small(n, SIZE), bias=(np.log(unigram) - np.log(mass)[np.arange(n) // width]).astype(np.float32),
                   class_target=small(len(mass), SIZE), class_bias=np.log(mass).astype(np.float32))

    def train(self, gram: np.ndarray, times: np.ndarray, unigram: np.ndarray, epochs: int, seed: int) -> None:
        """``learn`` from packed numbers."""
        context, token = np.divmod(gram, VOCABULARY)
        self.learn(*np.divmod(context, VOCABULARY), token, times, unigram, epochs, seed)

    def learn(self, two: np.ndarray, one: np.ndarray, token: np.ndarray, times: np.ndarray, unigram: np.ndarray, epochs: int, seed: int) -> None:
        """NCE of the class with NOISE samples shared by a batch, and of the token with WITHIN samples of its class shared
        by up to RUN tokens of the class in the batch; batches are drawn by how often (context, token) occurs."""
        rng = np.random.default_rng(seed)
        order = np.argsort(token, kind="stable")
        two, one, token, times = two[order], one[order], token[order], times[order]
        n, width = len(unigram), self.width
        mass = np.add.reduceat(unigram, np.arange(0, n, width))
        low, reach_word = np.append(0.0, np.cumsum(unigram))[np.arange(0, n, width)], np.cumsum(unigram)
        log_word = (np.log(unigram) - np.log(mass)[np.arange(n) // width] + np.log(WITHIN)).astype(np.float32)
        log_class = (np.log(mass) + np.log(NOISE)).astype(np.float32)
        reach_class, reach = np.cumsum(mass), np.cumsum(times)
        seen = {name: np.full_like(getattr(self, name), START) for name in self.NAMES}

        def step(name, rows, grads):
            held, sums = getattr(self, name), seen[name]
            total = sums[rows]
            total += grads * grads
            sums[rows] = total
            np.sqrt(total, out=total)
            grads = grads / total
            grads *= -RATE
            held[rows] += grads

        def edges(ordered):
            return np.flatnonzero(np.append(True, ordered[1:] != ordered[:-1]))

        def added(rows, grads):
            by = np.argsort(rows, kind="stable")
            rows = rows[by]
            first = edges(rows)
            return rows[first], np.add.reduceat(grads[by], first), np.diff(np.append(first, len(rows)))

        weight = np.float32(1 / BATCH)
        for _ in range(max(LEAST_STEPS, epochs * -(-len(token) // BATCH))):
            # In order of the tokens, hence of the classes.
            some = np.searchsorted(reach, np.sort(rng.integers(0, reach[-1], BATCH)), "right")
            r1, r2, y = one[some], two[some], token[some]
            k = y // width
            start, y_start = edges(k), edges(y)
            place = np.arange(BATCH) - np.repeat(start, np.diff(np.append(start, BATCH)))
            start = np.flatnonzero(place % RUN == 0)
            size, here = np.diff(np.append(start, BATCH)), k[start]
            run, slot = np.repeat(np.arange(len(start)), size), place % RUN
            other = np.minimum(np.searchsorted(reach_class, rng.random(NOISE) * reach_class[-1], "right"), len(mass) - 1)
            drawn = np.searchsorted(reach_word, low[here][:, None] + rng.random((len(here), WITHIN)) * mass[here][:, None], "right")
            drawn = np.clip(drawn, (here * width)[:, None], np.minimum((here + 1) * width, n)[:, None] - 1)
            b1, b2 = self.before[r1], self.before[r2]
            r = np.ones((BATCH, SIZE + 1), np.float32)
            r[:, :-1] = b1 @ self.near
            r[:, :-1] += b2 @ self.far
            x = r[:, :-1]
            q, qn, t, tn = self.class_target[k], self.class_target[other], self.target[y], self.target[drawn]
            g = (_chance(np.einsum("bd,bd->b", x, q) + self.class_bias[k] - log_class[k]) - 1) * weight
            b = _chance(x @ qn.T + (self.class_bias[other] - log_class[other])) * weight
            w = (_chance(np.einsum("bd,bd->b", x, t) + (self.bias[y] - log_word[y])) - 1) * weight
            # Runs side by side, filled up with zeros.
            rows = np.zeros((len(start), RUN, SIZE + 1), np.float32)
            rows[run, slot] = r
            v = _chance(np.matmul(rows[:, :, :-1], tn.transpose(0, 2, 1)) + (self.bias[drawn] - log_word[drawn])[:, None, :])
            v *= (rows[:, :, -1] * weight)[:, :, None]
            d_r = np.matmul(v, tn)[run, slot]
            d_r += g[:, None] * q
            d_r += b @ qn
            d_r += w[:, None] * t
            by_noise = np.matmul(v.transpose(0, 2, 1), rows).reshape(-1, SIZE + 1)
            at, grads, _ = added(np.append(y[y_start], drawn.ravel()), np.concatenate((np.add.reduceat(w[:, None] * r, y_start), by_noise)))
            step("target", at, grads[:, :-1])
            step("bias", at, grads[:, -1])
            at, grads, _ = added(np.append(here, other), np.concatenate((np.add.reduceat(g[:, None] * r, start), b.T @ r)))
            step("class_target", at, grads[:, :-1])
            step("class_bias", at, grads[:, -1])
            near, far = b1.T @ d_r, b2.T @ d_r
            at, grads, uses = added(np.append(r1, r2), np.concatenate((d_r @ self.near.T, d_r @ self.far.T)))
            step("before", at, grads)
            step("near", slice(None), near)
            step("far", slice(None), far)
            self.used[0, at] += uses
            self.used[1] += np.bincount(y, minlength=n) + np.bincount(drawn.ravel(), np.repeat(size, WITHIN), n)

    def log_probabilities(self, context: np.ndarray, token: np.ndarray) -> np.ndarray:
        """``log_p`` of packed contexts."""
        return self.log_p(*np.divmod(context, VOCABULARY), token)

    def log_p(self, two: np.ndarray, one: np.ndarray, token: np.ndarray) -> np.ndarray:
        """Natural log of P(token | two, one before), worked in slices of bounded size."""
        out = np.empty(len(token))
        for at in range(0, len(token), 1 << 17):
            t = token[at : at + (1 << 17)]
            r = self.before[one[at : at + len(t)]] @ self.near + self.before[two[at : at + len(t)]] @ self.far
            k = t // self.width
            p = np.einsum("ij,ij->i", r, self.class_target[k] + self.target[t]) + self.class_bias[k] + self.bias[t]
            p -= _log_sums(r, self.class_target, self.class_bias)
            order = np.argsort(k, kind="stable")
            edge = np.searchsorted(k[order], np.arange(len(self.class_bias) + 1))
            for c in np.flatnonzero(np.diff(edge)):
                some, mine = order[edge[c] : edge[c + 1]], slice(c * self.width, (c + 1) * self.width)
                p[some] -= _log_sums(r[some], self.target[mine], self.bias[mine])
            out[at : at + len(t)] = p
        return out

    def packed(self) -> bytes:
        return b"".join(np.ascontiguousarray(getattr(self, n), np.float32).tobytes() for n in self.NAMES)

    @classmethod
    def unpacked(cls, data: bytes, n: int) -> LogBilinear:
        flat, out, at = np.frombuffer(data, np.float32), {}, 0
        for name, shape in zip(cls.NAMES, cls.shapes(n)[1]):
            size = int(np.prod(shape))
            out[name] = flat[at : at + size].reshape(shape).copy()
            at += size
        return cls(**out)


ROWS = "slice long, part long, at binary, used binary, value binary"
SHARED = ("near", "far", "class_target", "class_bias")


def _train_parts(model, unigram, n: int, turn: int) -> Callable:
    """What each part changed in the rows that it touched, in slices; slice -1 has the arrays that all tokens share."""
    schema = pa.schema([("slice", pa.int64()), ("part", pa.int64()), ("at", pa.binary()), ("used", pa.binary()), ("value", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, packed in zip(batch.column(0).to_pylist(), batch.column(1)):
                two, one, token, times = _unpacked(packed.as_buffer(), 4).astype(np.int64)
                start, own = LogBilinear.unpacked(model.value, n), LogBilinear.unpacked(model.value, n)
                own.learn(two, one, token, times, unigram.value, EPOCHS, 1_000_003 * turn + part)
                for name in LogBilinear.NAMES:
                    held = getattr(own, name)
                    held -= getattr(start, name)
                shared = np.concatenate([getattr(own, name).ravel() for name in SHARED])
                out = [(-1, part, b"", np.float32(times.sum()).tobytes(), shared.tobytes())]
                for first in range(0, n, SLICE):
                    used = own.used[:, first : first + SLICE]
                    at = np.flatnonzero(used.any(0))
                    if len(at):
                        value = np.concatenate((own.before[first + at], own.target[first + at], own.bias[first + at, None]), 1).astype(np.float16)
                        out.append((first // SLICE, part, at.astype(np.int32).tobytes(), np.ascontiguousarray(used[:, at]).tobytes(), value.tobytes()))
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)

    return run


def _mean(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Weighted mean of the changes of one slice over some parts, which arrive one at a time, and the sums of the weights."""
    number, part = key[0].as_py(), key[1].as_py()
    total, used = 0, 0
    if number >= 0:
        total, used = np.zeros((SLICE, 2 * SIZE + 1)), np.zeros((2, SLICE))
    for batch in batches:
        for at, weights, value in zip(*(batch.column(k).to_pylist() for k in (2, 3, 4))):
            weights = np.frombuffer(weights, np.float32).astype(np.float64)
            if number < 0:
                total, used = total + weights * np.frombuffer(value, np.float32), used + weights
                continue
            at, weights = np.frombuffer(at, np.int32), weights.reshape(2, -1)
            value = np.frombuffer(value, np.float16).reshape(-1, 2 * SIZE + 1).astype(np.float64)
            total[at, :SIZE] += weights[0][:, None] * value[:, :SIZE]
            total[at, SIZE:] += weights[1][:, None] * value[:, SIZE:]
            used[:, at] += weights
    if number < 0:
        at, value = b"", (total / used).astype(np.float32)
    else:
        at = np.flatnonzero(used.any(0)).astype(np.int32)
        total, used = total[at], used[:, at]
        value = np.concatenate((total[:, :SIZE] / np.maximum(used[0], 1)[:, None], total[:, SIZE:] / np.maximum(used[1], 1)[:, None]), 1).astype(np.float16)
        at = at.tobytes()
    out = [pa.array([c], t) for c, t in ((number, pa.int64()), (part, pa.int64()), (at, pa.binary()), (used.astype(np.float32).tobytes(), pa.binary()),
                                         (value.tobytes(), pa.binary()))]
    yield pa.RecordBatch.from_arrays(out, names=["slice", "part", "at", "used", "value"])


def _averaged(trained: DataFrame, parts: int) -> pa.Table:
    """One row per slice: the mean changes over all parts."""
    while True:
        trained = trained.withColumn("part", F.floor(F.col("part") / FAN)).groupBy("slice", "part").applyInArrow(_mean, ROWS)
        parts = -(-parts // FAN)
        if parts == 1:
            return trained.toArrow()


def _next_start(model: LogBilinear, rows: pa.Table) -> None:
    """Adds the mean changes to the model; rows that no part touched stay."""
    for number, at, value in zip(*(rows[c].to_pylist() for c in ("slice", "at", "value"))):
        if number < 0:
            value = np.frombuffer(value, np.float32)
            for name in SHARED:
                held = getattr(model, name)
                held += value[: held.size].reshape(held.shape)
                value = value[held.size :]
            continue
        at = number * SLICE + np.frombuffer(at, np.int32)
        value = np.frombuffer(value, np.float16).reshape(-1, 2 * SIZE + 1).astype(np.float32)
        model.before[at] += value[:, :SIZE]
        model.target[at] += value[:, SIZE:-1]
        model.bias[at] += value[:, -1]


def train(
    texts: DataFrame, words: DataFrame, least: int = LEAST, own: int = OWN,
) -> tuple[np.ndarray, np.ndarray, LogBilinear, np.ndarray, np.ndarray]:
    """(sorted keys of words with a row of their own, their rows, model, unigram, base mass of the shared rows) from training
    texts and the total counts of words."""
    spark = texts.sparkSession
    inside = words.where(F.col("word") != int(END_KEY))
    top = inside.where(F.col("total") >= least).orderBy(F.desc("total"), "word").limit(own).toArrow()
    rest = F.col("total") < least
    if len(top) == own:
        last_total, last_word = top["total"][-1].as_py(), top["word"][-1].as_py()
        rest = (F.col("total") < last_total) | ((F.col("total") == last_total) & (F.col("word") > last_word))
    rest = inside.where(rest & (F.col("total") > 0))
    shared = min(SHARED_ROWS, max(1, -(-rest.count() // SHARING)))
    rest = rest.groupBy(F.pmod("word", F.lit(shared)).alias("row")).agg(F.sum("total").alias("total"), F.count("*").alias("words")).toArrow()
    row, rare, members = rest["row"].to_numpy(), np.zeros(shared), np.zeros(shared)
    rare[row], members[row] = rest["total"].to_numpy(), rest["words"].to_numpy()
    ends = words.where(F.col("word") == int(END_KEY)).agg(F.coalesce(F.sum("total"), F.lit(0))).first()[0]
    keys = np.append(int(END_KEY), top["word"].to_numpy())
    number = np.append(END, np.arange(1 + shared, len(keys) + shared)).astype(np.int32)
    count = np.concatenate(([ends], rare, top["total"].to_numpy())) + 1.0
    order = np.argsort(keys)
    keys, number = keys[order], number[order]
    n = len(count)
    parts = max(1, -(-int(count.sum()) // PART_GRAMS))
    # Every part is one packed row.
    grams = stored(
        texts.mapInArrow(W.released(_dealt(spark.sparkContext.broadcast((keys, number, shared)), parts)), "part long, grams binary")
        .repartition(parts * 4, "part").groupBy("part").applyInArrow(_counted, "part long, grams binary"), "grams")
    unigram = count / count.sum()
    model = LogBilinear.start(unigram)
    noise = spark.sparkContext.broadcast(unigram)
    for turn in range(ROUNDS):
        start = spark.sparkContext.broadcast(model.packed())
        trained = grams.mapInArrow(W.released(_train_parts(start, noise, n, turn)), ROWS)
        _next_start(model, _averaged(trained, parts))
    return keys, number, model, unigram, rare + members + 1


# The model of the last broadcast that this worker has used, by the broadcast's own token.
_models: dict[str, LogBilinear] = {}


def _scorer(held, trained_tokens: int, distinct: int, deals: int) -> Callable:
    schema = pa.schema([("id", pa.int64()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())])

    def run(key: tuple, packs: pa.Table, totals: pa.Table) -> pa.Table:
        W.release()
        token, keys, number, packed, n, mass = held.value
        if token not in _models:
            _models.clear()
            _models[token] = LogBilinear.unpacked(packed, n)
        model = _models[token]
        docs = _unpacked_docs(packs["pack"])
        tokens, edge = _tokens(docs["text"].to_pylist())
        word = np.unique(tokens)
        deal, total = _deal(word, deals), np.zeros(len(word), np.int64)
        for k, data in zip(totals["deal"].to_pylist(), totals["packed"]):
            total[deal == k] = _widened(data.as_buffer(), 1)[0]
        c = total[np.searchsorted(word, tokens)]
        base = np.log10((c + 1) / (trained_tokens + distinct + 1))
        ids = _numbers(tokens, keys, number, len(mass)).astype(np.int64)
        score = model.log_p(*_contexts(ids, edge), ids) / np.log(10)
        # Words of a shared row share its probability in proportion to the base model.
        rare = np.flatnonzero((ids > END) & (ids <= len(mass)))
        score[rare] += np.log10((c[rare] + 1) / mass[ids[rare] - 1])
        at = edge[:-1]
        out = [docs["id"].combine_chunks() if isinstance(docs["id"], pa.ChunkedArray) else docs["id"], pa.array(np.diff(edge)),
               pa.array(np.add.reduceat((c > 0).astype(np.int64), at)), pa.array(np.add.reduceat(base, at)), pa.array(np.add.reduceat(score, at))]
        return pa.Table.from_arrays(out, schema=schema)

    return run


def scored(docs: DataFrame, teaches: Column, id_column: str = "doc_id", text_column: str = "text", bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """(id, n_tokens, n_known, train_tokens, base_score, score) of every row; the model learns where ``teaches`` holds."""
    spark = docs.sparkSession
    text = F.coalesce(F.col(f"`{text_column}`").cast("string"), F.lit(""))
    rows = docs.select(F.col(f"`{id_column}`").cast("bigint").alias("id"), F.coalesce(teaches, F.lit(False)).alias("teaches"), text.alias("text"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(1, -(-size // bucket_bytes))
    # The text is part of the hash, so that rows that repeat an id don't meet in one bucket.
    dealt = rows.select(F.pmod(F.xxhash64("id", F.octet_length("text"), F.substring("text", 1, 64)), F.lit(buckets)).alias("bucket"), "id", "teaches", "text")
    packs = dealt.mapInArrow(W.released(_packs(buckets)), "bucket bigint, pack binary").repartition(2 * buckets, "bucket")
    deals = -(-buckets // BUCKETS_A_DEAL)
    totals = stored(
        packs.groupBy("bucket").applyInArrow(_word_rows(deals), "deal bigint, bucket bigint, packed binary")
        .repartition(2 * deals, "deal").groupBy("deal").applyInArrow(_sums, "bucket bigint, deal bigint, packed binary"), "totals")
    words = totals.where("bucket = -1").select("packed").mapInArrow(W.released(_all_words), "word bigint, total bigint")
    trained, distinct = words.agg(F.coalesce(F.sum("total"), F.lit(0)), F.coalesce(F.sum((F.col("total") > 0).cast("bigint")), F.lit(0))).first()
    keys, number, model, _, mass = train(rows.where("teaches").select("text"), words)
    held = spark.sparkContext.broadcast((uuid.uuid4().hex, keys, number, model.packed(), len(model.bias), mass))
    out = packs.groupBy("bucket").cogroup(totals.where("bucket >= 0").repartition(2 * buckets, "bucket").groupBy("bucket")).applyInArrow(
        _scorer(held, int(trained), int(distinct), deals), "id bigint, n_tokens bigint, n_known bigint, base_score double, score double")
    return out.withColumn("train_tokens", F.lit(int(trained)).cast("bigint"))
