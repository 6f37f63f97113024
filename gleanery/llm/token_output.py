"""Token ids of all documents as wavelet matrices, one per shard, in id order.

Documents are range-partitioned by id and sorted; a task encodes its documents, appends the end id to each and cuts them into
shards of bounded size (a single longer document is a shard of its own).  A shard is one row of a Parquet table: the ids of its
documents, where each begins, and a wavelet matrix of the token ids.  Level by level from the highest bit, the matrix keeps one
bit per token and stably moves the tokens with bit 0 before those with bit 1.  With a directory of ones per 512 bits, access,
counting and the place of the k-th occurrence take one rank or select per level.  The table is compressed with zstd by the
writer; Spark's commit makes it whole or absent when executors are lost.

Encoding: a space that follows a non-space always starts a new piece of the byte-level tokenizer, so do the places around
commas, full stops and line breaks that stand alone.  Texts are cut there, each distinct piece is encoded once by the library,
and documents take the ids of their pieces.  Texts in which the cuts could fall inside a piece are encoded whole.

A null text is encoded as an empty one.  Null ids come first.  Rows that repeat an id stand side by side.  Only the id and
text columns are read.  ``start`` counts the ids of all rows with a smaller place.
"""

from __future__ import annotations

import os
import struct
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window
from pyspark.sql import functions as F

from gleanery.llm import words as W
from gleanery.session import shared_folder

TOKENIZER = "byte_bpe_50k.json"
END = 2
SHARD_TOKENS = 1 << 20
BLOCK = 512
MEMO = 400_000
# Characters of texts cut together.
TOGETHER = 6 << 20
TEXT_BYTES_PER_TASK = 32 << 20

_CUT = "\x00"
# Where a cut could fall inside a piece: spaces beside spaces, marks beside other marks, and control signs.
_BLANK = r"[\s\v\x85\p{Z}]"
_UNSAFE_SPACES = rf"[\x00\x1c-\x1f]|{_BLANK}{_BLANK}"
_UNSAFE = rf"{_UNSAFE_SPACES}|[.,][^\s\v\x85\p{{Z}}\p{{L}}\p{{N}}]|[^\s\v\x85\p{{Z}}\p{{L}}\p{{N}}][.,]"
_memo: dict[str, dict[str, bytes]] = {}
_tokenizers: dict[str, object] = {}


def tokenizer(name: str = TOKENIZER):
    """The library's tokenizer, loaded once per process; tasks already use all cores."""
    if name not in _tokenizers:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import public_tokenizers
        from tokenizers import Tokenizer

        _tokenizers[name] = Tokenizer.from_file(public_tokenizers.path(name))
    return _tokenizers[name]


def _ids(pieces: list[str], name: str) -> list[bytes]:
    """Ids of each piece as 32-bit words.  The first MEMO pieces of a process, the frequent ones among them, are kept."""
    memo = _memo.setdefault(name, {})
    found = list(map(memo.get, pieces))
    missing = [k for k, ids in enumerate(found) if ids is None]
    if missing:
        for k, done in zip(missing, tokenizer(name).encode_batch_fast([pieces[k] for k in missing], add_special_tokens=False)):
            ids = done.ids
            found[k] = struct.pack(f"<{len(ids)}I", *ids)
        for k in missing[: max(0, MEMO - len(memo))]:
            memo[pieces[k]] = found[k]
    return found


def encoded(texts: list[str | None], name: str = TOKENIZER) -> Iterator[np.ndarray]:
    """Ids of every text; works on texts of bounded size together."""
    at = 0
    while at < len(texts):
        to, held = at, 0
        while to < len(texts) and (to == at or held + len(texts[to] or "") <= TOGETHER):
            held += len(texts[to] or "")
            to += 1
        yield from _encoded([t or "" for t in texts[at:to]], name)
        at = to


def _encoded(texts: list[str], name: str) -> list[np.ndarray]:
    out: list[np.ndarray] = [np.empty(0, "<u4")] * len(texts)
    column = pa.array(texts, pa.large_string())
    whole = pc.match_substring_regex(column, _UNSAFE_SPACES).to_numpy(zero_copy_only=False)
    marks_too = ~pc.match_substring_regex(column, _UNSAFE).to_numpy(zero_copy_only=False)
    for k in np.flatnonzero(whole):
        out[k] = np.array(tokenizer(name).encode(texts[k], add_special_tokens=False).ids, "<u4")
    for places, marks in ((np.flatnonzero(marks_too), ",.\n"), (np.flatnonzero(~marks_too & ~whole), "")):
        if not len(places):
            continue
        cut = pc.replace_substring(column.take(pa.array(places)), " ", f"{_CUT} ")
        for mark in marks:
            cut = pc.replace_substring(cut, mark, f"{_CUT}{mark}{_CUT}")
        parts = pc.split_pattern(cut, _CUT)
        coded = parts.flatten().dictionary_encode()
        held = _ids(coded.dictionary.to_pylist(), name)
        flat = np.frombuffer(b"".join(held), "<u4")
        size = np.fromiter(map(len, held), np.int64, len(held)) // 4
        code = coded.indices.to_numpy()
        each = size[code]
        reach = np.concatenate(([0], np.cumsum(each)))
        ids = flat[np.repeat((np.cumsum(size) - size)[code] - reach[:-1], each) + np.arange(reach[-1])]
        edge = reach[parts.offsets.to_numpy()]
        for k, a, b in zip(places, edge, edge[1:]):
            out[k] = ids[a:b]
    return out


def bits_for(values: np.ndarray) -> int:
    return max(1, int(values.max()).bit_length() if len(values) else 1)


def build(values: np.ndarray) -> tuple[int, list[bytes], list[int]]:
    """(levels, bit-plane of each level, zeros of each level), highest bit first."""
    levels = bits_for(values)
    values = values.astype(np.uint16 if levels <= 16 else np.uint32)
    planes, zeros = [], []
    for level in range(levels - 1, -1, -1):
        ones = ((values >> level) & 1).astype(bool)
        planes.append(np.packbits(ones).tobytes())
        low = values[~ones]
        zeros.append(len(low))
        values = np.concatenate((low, values[ones]))
    return levels, planes, zeros


class WaveletMatrix:
    """Rank and select over the bit-planes of one shard."""

    def __init__(self, n: int, planes: list[bytes], zeros: list[int]):
        self.n, self.zeros, self.levels = n, zeros, len(planes)
        self.planes = [np.frombuffer(p, np.uint8) for p in planes]
        self._ranks: list[np.ndarray] | None = None

    def _directory(self) -> list[np.ndarray]:
        """Ones before each block of BLOCK bits; a plane of n bits needs n / BLOCK + 1 counts."""
        if self._ranks is None:
            self._ranks = []
            for plane in self.planes:
                count = np.bitwise_count(np.pad(plane, (0, -len(plane) % (BLOCK // 8))).reshape(-1, BLOCK // 8)).sum(1, dtype=np.int64)
                self._ranks.append(np.concatenate(([0], np.cumsum(count))))
        return self._ranks

    def rank1(self, level: int, i: int) -> int:
        """Ones before place i."""
        block = i // BLOCK
        bits = np.unpackbits(self.planes[level][block * BLOCK // 8 : -(-i // 8)])[: i - block * BLOCK]
        return int(self._directory()[level][block] + bits.sum())

    def select(self, level: int, bit: int, k: int) -> int:
        """Place of the k-th (from 0) bit of this kind."""
        ones = self._directory()[level]
        before = ones if bit else np.arange(len(ones)) * BLOCK - ones
        block = int(np.searchsorted(before, k, "right")) - 1
        bits = np.unpackbits(self.planes[level][block * BLOCK // 8 : (block + 1) * BLOCK // 8])
        return block * BLOCK + int(np.flatnonzero(bits == bit)[k - before[block]])

    def access(self, i: int) -> int:
        value = 0
        for level in range(self.levels):
            one = self.rank1(level, i + 1) - self.rank1(level, i)
            value = value << 1 | one
            i = self.zeros[level] + self.rank1(level, i) if one else i - self.rank1(level, i)
        return value

    def count(self, value: int, a: int = 0, b: int | None = None) -> int:
        """Occurrences of a token between two places."""
        b = self.n if b is None else b
        if value >> self.levels:
            return 0
        for level in range(self.levels):
            x, y = self.rank1(level, a), self.rank1(level, b)
            a, b = (self.zeros[level] + x, self.zeros[level] + y) if value >> (self.levels - 1 - level) & 1 else (a - x, b - y)
        return b - a

    def locate(self, value: int, k: int) -> int:
        """Place of the k-th (from 0) occurrence of a token."""
        a = 0
        for level in range(self.levels):
            x = self.rank1(level, a)
            a = self.zeros[level] + x if value >> (self.levels - 1 - level) & 1 else a - x
        i = a + k
        for level in range(self.levels - 1, -1, -1):
            one = value >> (self.levels - 1 - level) & 1
            i = self.select(level, one, i - self.zeros[level] if one else i)
        return i

    def values(self) -> np.ndarray:
        """All tokens in order: the moves of each level undone from the lowest bit up."""
        out = np.zeros(self.n, np.uint16 if self.levels <= 16 else np.uint32)
        for level in range(self.levels - 1, -1, -1):
            ones = np.unpackbits(self.planes[level], count=self.n).view(bool)
            back = np.empty_like(out)
            back[~ones] = out[: self.zeros[level]]
            back[ones] = out[self.zeros[level] :] | out.dtype.type(1 << (self.levels - 1 - level))
            out = back
        return out


SHARD = "place bigint, ids array<bigint>, lengths array<bigint>, n bigint, zeros array<bigint>, planes array<binary>"


def _shard(place: int, ids: list, parts: list[np.ndarray]) -> pa.RecordBatch:
    values = np.concatenate(parts)
    _, planes, zeros = build(values)
    return pa.RecordBatch.from_arrays([
        pa.array([place]), pa.array([ids], pa.list_(pa.int64())), pa.array([[len(p) for p in parts]], pa.list_(pa.int64())),
        pa.array([len(values)]), pa.array([zeros], pa.list_(pa.int64())), pa.array([planes], pa.list_(pa.binary())),
    ], names=["place", "ids", "lengths", "n", "zeros", "planes"])


def _writer(name: str, end: int, most: int) -> Callable:
    tail = np.array([end], "<u4")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        place, ids, parts, held = TaskContext.get().partitionId() << 32, [], [], 0
        # Python holds the texts of one slice of a batch at a time.
        for batch in W.bounded(batches, 1, TOGETHER):
            for doc, got in zip(batch.column(0).to_pylist(), encoded(batch.column(1).to_pylist(), name)):
                if parts and held + len(got) + 1 > most:
                    yield _shard(place, ids, parts)
                    place, ids, parts, held = place + 1, [], [], 0
                ids.append(doc)
                parts.append(np.concatenate((got, tail)))
                held += len(got) + 1
        if parts:
            yield _shard(place, ids, parts)

    return run


def write(docs: DataFrame, path: str, name: str = TOKENIZER, end: int = END, id_column: str = "doc_id", text_column: str = "text",
          most: int = SHARD_TOKENS, task_bytes: int = TEXT_BYTES_PER_TASK) -> str:
    """Encode all documents in ascending id order into shards at ``path``."""
    pairs = docs.select(F.col(f"`{id_column}`").cast("bigint").alias("id"), F.col(f"`{text_column}`").cast("string").alias("text"))
    size = pairs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    ordered = pairs.repartitionByRange(max(1, -(-size // task_bytes)), F.col("id").asc_nulls_first()).sortWithinPartitions(F.col("id").asc_nulls_first())
    ordered.mapInArrow(W.released(_writer(name, end, most)), SHARD).write.option("compression", "zstd").parquet(path)
    return path


def _reader() -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                row = batch.slice(k, 1).to_pylist()[0]
                values = WaveletMatrix(row["n"], row["planes"], row["zeros"]).values().astype("<u4")
                edge = np.concatenate(([0], np.cumsum(row["lengths"]))).astype(np.int64)
                crc = [zlib.crc32(values[a:b].tobytes()) for a, b in zip(edge, edge[1:])]
                yield pa.RecordBatch.from_arrays([
                    pa.array([row["place"]] * len(crc), pa.int64()), pa.array(row["ids"], pa.int64()), pa.array(edge[:-1]),
                    pa.array(np.diff(edge)), pa.array(crc, pa.int64())], names=["place", "id", "inside", "n_tokens", "ids_crc32"])

    return run


def read(spark: SparkSession, path: str) -> DataFrame:
    """(id, start, n_tokens, ids_crc32) of every document, from the shards alone."""
    shards = spark.read.schema(SHARD).parquet(path)
    # Running sums in two steps: over the writing tasks, one row each, and over the shards of each task.
    sizes = shards.select("place", "n", F.shiftright("place", 32).alias("task"))
    before = lambda w: F.coalesce(F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    tasks = sizes.groupBy("task").agg(F.sum("n").alias("n")).select("task", before(Window.orderBy("task")).alias("base"))
    bases = sizes.withColumn("own", before(Window.partitionBy("task").orderBy("place"))).join(tasks, "task").select(
        "place", (F.col("base") + F.col("own")).alias("base"))
    rows = shards.mapInArrow(W.released(_reader()), "place bigint, id bigint, inside bigint, n_tokens bigint, ids_crc32 bigint")
    return rows.join(bases, "place").select("id", (F.col("base") + F.col("inside")).alias("start"), "n_tokens", "ids_crc32")


def path_in(spark: SparkSession, label: str = "tokens") -> str:
    import uuid

    return f"{shared_folder(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"
