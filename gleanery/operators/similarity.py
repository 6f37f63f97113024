"""Exact Dice similarity joins: rare-gram prefixes, length filter, leaders in hot blocks.

Two sets with Dice >= t overlap in at least ceil(n*t/(2-t)) elements, n being the size of either
set.  So each set only indexes its ``n - ceil(n*t/(2-t)) + 1`` rarest grams, and qualifying pairs
still meet in at least one indexed gram.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleanery.operators.components import connected_components
from gleanery.operators.pairing import Lists, coded
from gleanery.session import cut_lineage


def prefix_index(sets: DataFrame, threshold: float, node: str = "node", grams: str = "grams") -> DataFrame:
    """(node, gram, size) for the rare-gram prefix of every set."""
    spread = sets.select(node, F.size(grams).alias("size"), F.explode(grams).alias("gram"))
    frequency = spread.groupBy("gram").agg(F.count("*").alias("_df"))
    overlap = F.ceil(F.col("size") * F.lit(threshold) / (2 - F.lit(threshold)) - F.lit(1e-9))
    ranked = (
        spread.join(frequency, "gram")
        .groupBy(node, "size")
        .agg(F.array_sort(F.collect_list(F.struct("_df", "gram"))).alias("_g"))
    )
    kept = F.slice("_g", F.lit(1), (F.col("size") - overlap + 1).cast("int"))
    return ranked.select(node, "size", F.explode(F.transform(kept, lambda g: g["gram"])).alias("gram"))


def comparable(size_a: Column, size_b: Column, threshold: float) -> Column:
    """Necessary size ratio of two sets."""
    return F.least(size_a, size_b) >= F.greatest(size_a, size_b) * (threshold / (2 - threshold)) - 1e-9


def linked(
    blocks: DataFrame, verify: Callable[[DataFrame], DataFrame], bound: int = 200, rounds: int = 3
) -> DataFrame:
    """Edges (a, b) that connect all nodes which share a block and pass ``verify``.

    ``blocks`` has (node, block, size, ratio, open): pairs of one block must have set sizes within ``ratio`` of each other, and
    at least one of the two must be ``open``.  In blocks above ``bound`` every node is first compared with one leader of the
    block, another in each round, so a large group of copies is connected with a few comparisons per member.  Afterwards all
    pairs of a block that are not connected yet are compared, whether they met a leader or not; ``bound`` and ``rounds`` change
    the cost and never the components.  ``verify`` maps (a, b) to the rows that match.
    """
    shape = blocks.groupBy("node", "block").agg(
        F.min("size").alias("low"), F.max("size").alias("high"), F.min("ratio").alias("ratio"), F.max("open").alias("open")
    )
    current, found = cut_lineage(shape), None
    hot = current.groupBy("block").agg(F.count("*").alias("_n")).where(F.col("_n") > bound).select("block")
    inside = cut_lineage(current.join(hot, "block"))
    for turn in range(0 if inside.isEmpty() else rounds):
        placed = _placed(inside, found)
        leaders = placed.groupBy("block").agg(F.min_by(F.struct("node", "part", "open"), F.xxhash64("node", "block", F.lit(turn))).alias("l"))
        apart = placed.join(leaders, "block").where((F.col("part") != F.col("l.part")) & (F.col("open") | F.col("l.open")))
        pairs = apart.select(F.least("node", "l.node").alias("a"), F.greatest("node", "l.node").alias("b")).distinct()
        matched = cut_lineage(verify(pairs).select("a", "b"))
        if matched.isEmpty():
            break
        found = matched if found is None else found.unionByName(matched)
    current = _placed(current, found)
    # One side is open, so only open nodes are paired with all others of their block.
    left, right = (
        current.select(
            "block", "ratio", *[F.col(c).alias(f"{c}_{side}") for c in ("low", "high", "open", "part")], F.col("node").alias(side)
        )
        for side in "ab"
    )
    fits = (F.col("high_a") >= F.col("low_b") * F.col("ratio") - 1e-9) & (F.col("high_b") >= F.col("low_a") * F.col("ratio") - 1e-9)
    once = (F.col("a") < F.col("b")) | (~F.col("open_b") & (F.col("a") != F.col("b")))
    pairs = left.where("open_a").join(right.drop("ratio"), "block").where(once & (F.col("part_a") != F.col("part_b")) & fits)
    rest = verify(pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()).select("a", "b")
    return rest if found is None else found.unionByName(rest).distinct()


def _placed(rows: DataFrame, found: DataFrame | None) -> DataFrame:
    """Adds ``part``: the component of each node by the edges found so far."""
    if found is None:
        return rows.withColumn("part", F.col("node"))
    return rows.join(connected_components(found), "node", "left").withColumn("part", F.coalesce("component", "node")).drop("component")


# Sets of a chunk, rows of a strip, buckets of a set's grams (the most frequent grams have one of their own), pairs counted at a time.
CHUNK, SMALL, STRIP, BUCKETS, OWN, SOME = 16_384, 1_000, 512, 256, 192, 100_000


def _buckets(lists: Lists, places: np.ndarray, bucket: np.ndarray) -> np.ndarray:
    """How many grams of each set are in each bucket; products of these rows are never below the size of a common set."""
    at = np.full(lists.n, -1)
    at[places] = np.arange(len(places))
    mine = at[lists.row] >= 0
    cells = at[lists.row[mine]] * BUCKETS + bucket[lists.code[mine]]
    return np.bincount(cells, minlength=len(places) * BUCKETS).reshape(-1, BUCKETS).astype(np.float32)


def _shared(lists: Lists, keys: np.ndarray, begin: np.ndarray, codes: int, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Exact sizes of the common sets of the pairs (x, y); ``keys`` are all (row, code) in order."""
    size = lists.size[x]
    pair = np.repeat(np.arange(len(x)), size)
    step = np.arange(len(pair)) - np.repeat(np.cumsum(size) - size, size)
    wanted = y[pair] * codes + keys[begin[x][pair] + step] % codes
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return np.bincount(pair[keys[at] == wanted], minlength=len(x))


def similar(lists: Lists, left: np.ndarray, right: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place, place, similarity) of all pairs of ``left`` and ``right`` at or above the threshold; two equal sides give each pair once."""
    codes = int(lists.code.max(initial=0)) + 1
    keys = np.sort(lists.row * codes + lists.code)
    begin = np.searchsorted(keys, np.arange(lists.n) * codes)
    rank = np.empty(codes, dtype=np.int64)
    rank[np.argsort(-np.bincount(lists.code, minlength=codes), kind="stable")] = np.arange(codes)
    bucket = np.where(rank < OWN, rank, OWN + rank % (BUCKETS - OWN))
    once = np.array_equal(left, right)
    left, right = left[lists.size[left] > 0], right[lists.size[right] > 0]
    # The two last columns take away the overlap that a pair of these sizes needs.
    need = [(threshold / 2 * lists.size[side])[:, None].astype(np.float32) for side in (left, right)]
    a = np.hstack([_buckets(lists, left, bucket), -need[0], np.ones_like(need[0])])
    b = np.hstack([_buckets(lists, right, bucket), np.ones_like(need[1]), -need[1]]).T.copy()
    found = []
    for low in range(0, len(left), STRIP):
        start = low if once else 0
        x, y = np.nonzero(a[low:low + STRIP] @ b[:, start:] > -0.01)
        x, y = x + low, y + start
        x, y = (left[x[x < y]], right[y[x < y]]) if once else (left[x], right[y])
        for k in range(0, len(x), SOME):
            p, q = x[k:k + SOME], y[k:k + SOME]
            alike = 2.0 * _shared(lists, keys, begin, codes, p, q) / (lists.size[p] + lists.size[q])
            found.append((p[alike >= threshold], q[alike >= threshold], alike[alike >= threshold]))
    none = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), np.zeros(0)
    return tuple(np.concatenate(c) for c in zip(none, *found))


def dice_pairs(sets: DataFrame, threshold: float, node: str = "node", grams: str = "grams") -> DataFrame:
    """All pairs (a, b, similarity) of distinct sets at or above the threshold, which is above zero.

    For whole pair lists; clustering uses :func:`linked`, which never lists a group of copies.  Sets are compared chunk against chunk,
    each pair of chunks in one task: matrix products over bucket counts bound the common sets, and what passes is counted exactly.
    The work is quadratic in the sets, memory follows the chunk and the pairs found in it.
    """
    given = cut_lineage(sets.select(F.col(node).alias("_s"), F.col(grams).alias("_g")))
    count = given.count()
    parts = max(-(-count // CHUNK), min(8, -(-count // SMALL)), 1)
    chunked = given.withColumn("_c", F.pmod(F.xxhash64("_s"), F.lit(parts)).cast("int"))
    met = chunked.withColumn("_k", F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))).select(
        "_s", "_g", "_c", F.least("_c", "_k").alias("_i"), F.greatest("_c", "_k").alias("_j"))

    def pairs(table: pa.Table) -> pa.Table:
        chunk, i, j = (table.column(c).to_numpy() for c in ("_c", "_i", "_j"))
        x, y, alike = similar(coded(table.column("_g").combine_chunks()), np.flatnonzero(chunk == i), np.flatnonzero(chunk == j), threshold)
        nodes = table.column("_s").combine_chunks()
        return pa.table({"x": nodes.take(pa.array(x)), "y": nodes.take(pa.array(y)), "similarity": pa.array(alike, pa.float64())})

    kind = given.schema["_s"].dataType.simpleString()
    found = met.groupBy("_i", "_j").applyInArrow(pairs, f"x {kind}, y {kind}, similarity double")
    return found.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), "similarity")
