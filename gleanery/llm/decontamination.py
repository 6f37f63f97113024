"""Benchmark decontamination by greedy string tiling.

Tokens are runs of ASCII letters and digits and of bytes outside ASCII, with A-Z in lower case.  Windows of five tokens (all
tokens of a shorter item) of the documents are hashed in running Karp-Rabin style and joined with the benchmark's windows;
these seeds are checked token by token and run together along diagonals into maximal matches.  Then the longest match of
unmarked tokens is marked on both sides, again and again, until none of five tokens is left, so passages in another order are
covered as well.  An item is found when at least 80 % of its tokens are marked, and a document with a found item is contaminated.

The benchmark reaches the tasks in blocks of bounded size, one broadcast each; documents pass all blocks in one stage and are
never shuffled.  Ties between matches of one length go to the earlier place in the document, then in the item.  Items and
documents without tokens, and nulls, are never found.  Repeated items are found under each id.  All columns of the documents
are kept; names may clash with those of the benchmark.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleanery.llm import words as W

LEAST_MATCH = 5
PERCENT = 80
BLOCK_BYTES = 16 << 20
HITS = "array<struct<item_id: bigint, covered: bigint, words: bigint>>"
_BREAKS = np.ones(256, bool)
_BREAKS[128:] = False
_BREAKS[[*range(48, 58), *range(65, 91), *range(97, 123)]] = False


class Items:
    """A block of benchmark items: their token hashes and a sorted table of their seeds."""

    def __init__(self, ids: list[int], texts: list[str | None], least: int = LEAST_MATCH):
        hashed, first = W.word_hashes(texts, space=_BREAKS)
        self.ids, self.tokens = ids, [hashed[a:b] for a, b in zip(first, first[1:])]
        self.seeds: dict[int, tuple] = {}
        for size in sorted({min(least, len(t)) for t in self.tokens} - {0}):
            keys, item, place = [], [], []
            for k, tokens in enumerate(self.tokens):
                if min(least, len(tokens)) == size:
                    keys.append(W.windows(tokens, size))
                    item.append(np.full(len(keys[-1]), k))
                    place.append(np.arange(len(keys[-1])))
            keys, item, place = (np.concatenate(x) for x in (keys, item, place))
            order = np.argsort(keys, kind="stable")
            present = np.zeros(1 << 20, bool)
            present[keys >> W.U64(44)] = True
            self.seeds[size] = keys[order], item[order], place[order], present

    def found(self, texts: list[str | None]) -> Iterator[tuple[int, np.ndarray, np.ndarray, int, int]]:
        """(document, its seed places, item's seed places, item, seed size) for every pair that shares a seed."""
        hashed, first = W.word_hashes(texts, space=_BREAKS)
        for size, (keys, item, place, present) in self.seeds.items():
            every = W.windows(hashed, size)
            at = np.flatnonzero(present[every >> W.U64(44)])
            low, high = np.searchsorted(keys, every[at], "left"), np.searchsorted(keys, every[at], "right")
            doc = np.searchsorted(first, at, "right") - 1
            fine = (high > low) & (at + size <= first[np.minimum(doc + 1, len(first) - 1)])
            at, low, high, doc = at[fine], low[fine], high[fine], doc[fine]
            times = high - low
            row = np.repeat(low, times) + np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
            at, doc = np.repeat(at, times), np.repeat(doc, times)
            which, q = item[row], place[row]
            order = np.lexsort((q, at, which, doc))
            at, doc, which, q = at[order], doc[order], which[order], q[order]
            edge = np.flatnonzero(np.concatenate(([True], (doc[1:] != doc[:-1]) | (which[1:] != which[:-1]), [True]))) if len(doc) else []
            for a, b in zip(edge, edge[1:]):
                d, k = int(doc[a]), int(which[a])
                tokens = hashed[first[d] : first[d + 1]]
                p = at[a:b] - first[d]
                same = np.all([tokens[p + j] == self.tokens[k][q[a:b] + j] for j in range(size)], axis=0)
                if same.any():
                    yield d, p[same], q[a:b][same], k, size


def tiled(p: np.ndarray, q: np.ndarray, size: int, words: int) -> int:
    """Tokens of an item that greedy tiling marks, from all seeds of one document and item."""
    order = np.lexsort((p, p - q))
    p, q = p[order], q[order]
    starts = np.flatnonzero(np.concatenate(([True], (p[1:] - q[1:] != p[:-1] - q[:-1]) | (p[1:] != p[:-1] + 1))))
    ends = np.append(starts[1:], len(p))
    heap = [(-int(e - s + size - 1), int(p[s]), int(q[s])) for s, e in zip(starts, ends)]
    heapq.heapify(heap)
    used_doc: set[int] = set()
    used_item = bytearray(words)
    while heap:
        length, x, y = heapq.heappop(heap)
        length = -length
        free = [not used_item[y + j] and x + j not in used_doc for j in range(length)]
        if all(free):
            used_doc.update(range(x, x + length))
            used_item[y : y + length] = b"\x01" * length
            continue
        # What is left of the match between marked tokens, if still long enough.
        j = 0
        while j < length:
            if not free[j]:
                j += 1
                continue
            k = j
            while k < length and free[k]:
                k += 1
            if k - j >= size:
                heapq.heappush(heap, (-(k - j), x + j, y + j))
            j = k
    return sum(used_item)


def _scan(block, percent: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items: Items = block.value
        for batch in batches:
            hits = batch.column(1).to_pylist()
            for d, p, q, k, size in items.found(batch.column(0).to_pylist()):
                words = len(items.tokens[k])
                covered = tiled(p, q, size, words)
                if covered * 100 >= words * percent:
                    hits[d].append({"item_id": items.ids[k], "covered": covered, "words": words})
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(hits, batch.schema.field(1).type), *batch.columns[2:]], schema=batch.schema)

    return run


def benchmark_hits(
    docs: DataFrame, benchmark: DataFrame, text_column: str = "text", item_column: str = "item_id", item_text: str = "text",
    least: int = LEAST_MATCH, percent: int = PERCENT, block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """All columns of ``docs`` and _hits, the benchmark items found in each text."""
    spark = docs.sparkSession
    items = benchmark.select(F.col(f"`{item_column}`").cast("bigint").alias("id"), F.col(f"`{item_text}`").cast("string").alias("text")).where("text is not null")
    total = items.agg(F.sum(F.octet_length("text") + 16)).first()[0] or 0
    blocks = -(-total // block_bytes)
    named = [f"c{k}" for k in range(len(docs.columns))]
    plain = docs.toDF(*named)
    out = plain.select(
        F.col(named[docs.columns.index(text_column)]).cast("string").alias("text"), F.array().cast(HITS).alias("hits"),
        F.struct(F.lit(0).alias("_"), *named).alias("row"))
    for k in range(blocks):
        part = items.where(F.pmod(F.xxhash64("id", "text"), F.lit(blocks)) == k).orderBy("id", "text").toArrow()
        block = spark.sparkContext.broadcast(Items(part["id"].to_pylist(), part["text"].to_pylist(), least))
        out = out.mapInArrow(W.released(_scan(block, percent)), out.schema)
    return out.select(*[F.col(f"row.{n}").alias(c) for n, c in zip(named, docs.columns)], F.col("hits").alias("_hits"))


def decontaminated(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The documents in which no benchmark item was found."""
    return benchmark_hits(docs, benchmark, **options).where(F.size("_hits") == 0).drop("_hits")
