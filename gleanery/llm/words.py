"""Words of UTF-8 texts and their 64-bit hashes, vectorised over an Arrow batch.

Words are runs of bytes other than 0x20 and 0x09-0x0D.  These bytes never occur inside a longer UTF-8 sequence, so byte
runs are character runs.  A word's hash is a polynomial over its bytes modulo 2**64 with a random value per byte, then
mixed; two different words share a hash with a probability of about 2**-64.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
BASE = U64(0x9E3779B97F4A7C15 | 1)
WINDOW = 1 << 20
SPACE = np.zeros(256, bool)
SPACE[[0x20, 9, 10, 11, 12, 13]] = True
_seed = np.random.default_rng(20240917)
VALUE = _seed.integers(1, 2**63, 256, dtype=np.uint64) * U64(2) + U64(1)
STEP = _seed.integers(1, 2**63, 64, dtype=np.uint64) * U64(2) + U64(1)
_powers: dict[str, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
        return x ^ (x >> U64(31))


def _tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if "up" not in _powers or len(_powers["up"]) < n:
        n = max(n, WINDOW + 4096)
        with np.errstate(over="ignore"):
            for name, base in (("up", BASE), ("down", U64(pow(int(BASE), -1, 1 << 64)))):
                steps = np.full(n, base, np.uint64)
                steps[0] = 1
                _powers[name] = np.cumprod(steps, dtype=np.uint64)
    return _powers["up"], _powers["down"]


def spans(buffer: np.ndarray, space: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of every word of a byte buffer."""
    flags = np.ones(len(buffer) + 2, np.int8)
    flags[1:-1] = space[buffer]
    edges = np.flatnonzero(np.diff(flags))
    return edges[0::2], edges[1::2]


def hashes(buffer: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of every span; the buffer is worked through in windows that end between spans."""
    out = np.empty(len(starts), np.uint64)
    at = 0
    while at < len(starts):
        first = starts[at]
        to = max(int(np.searchsorted(ends, first + WINDOW, "right")), at + 1)
        last = ends[to - 1]
        up, down = _tables(int(last - first) + 1)
        with np.errstate(over="ignore"):
            sums = np.zeros(int(last - first) + 1, np.uint64)
            np.cumsum(VALUE[buffer[first:last]] * up[: last - first], out=sums[1:])
            s, e = starts[at:to] - first, ends[at:to] - first
            out[at:to] = mix((sums[e] - sums[s]) * down[s] + (e - s).astype(np.uint64))
        at = to
    return out


def joined(texts: Iterable[str | None], lower: bool = True) -> tuple[bytes, np.ndarray]:
    """All texts in one buffer with a line break after each, and the place where each begins."""
    parts = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    begin = np.zeros(len(parts) + 1, np.int64)
    np.cumsum([len(p) + 1 for p in parts], out=begin[1:])
    data = b"\n".join(parts) + b"\n"
    return (data.lower() if lower else data), begin  # bytes.lower() changes A-Z only


def word_hashes(texts: Iterable[str | None], lower: bool = True, space: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words in reading order, and the index of each text's first word (one more at the end)."""
    data, begin = joined(texts, lower)
    buffer = np.frombuffer(data, np.uint8)
    starts, ends = spans(buffer, space)
    return hashes(buffer, starts, ends), np.searchsorted(starts, begin)


def windows(words: np.ndarray, size: int) -> np.ndarray:
    """Hash of the ``size`` words from each position on; positions too near the end are left out."""
    n = len(words) - size + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    with np.errstate(over="ignore"):
        total = words[:n] * STEP[0]
        for k in range(1, size):
            total = total + words[k : k + n] * STEP[k]
        return mix(total + U64(size))


def bounded(batches: Iterable[pa.RecordBatch], column: int, most: int = WINDOW) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of at most ``most`` bytes of one text column, or of a single row."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        total, at = np.cumsum(sizes, dtype=np.int64), 0
        while at < len(sizes):
            to = max(at + 1, int(np.searchsorted(total, total[at] - sizes[at] + most, "right")))
            yield batch.slice(at, to - at)
            at = to


def release() -> None:
    """Gives freed memory back to the machine.

    Spark uses its Python workers again for later stages, and allocators keep what earlier ones have freed.
    """
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):
        pass


def released(run: Callable) -> Callable:
    """The same function for mapInArrow, which releases memory when a task has ended."""
    def through(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            release()

    return through
