"""Line de-duplication: documents probe a sharded minimal perfect hash over the repeated lines.

A line's key is the line without spaces (0x20, 0x09-0x0D) at both ends and with A-Z in lower case.  Keys of at least 20 code
points that occur in at least 3 documents lose all their lines except in the largest id that holds them.

1. Every task sends one row per key and batch: a 128-bit hash of the key, the number of documents and the largest id.
   Counts are added map-side, so a line in all documents costs one row per batch.  Rows that repeat an id are one document: they
   send (key, id), and each such pair counts once.
2. The repeated keys are dealt to shards by their hash.  A shard is built in one task: hash-and-displace gives every key its
   own slot out of exactly as many slots as keys, with arrays of fingerprints, counts and largest ids.
3. Shards are read in blocks of bounded size.  Each block is one broadcast, and documents pass through the blocks one after
   the other within one stage: a line is looked up by one displacement and one fingerprint.  No line is joined or shuffled.

A null or empty text is one empty line.  Repeated ids count once, and if such an id is the largest, all its rows keep the line.  Null ids count as
documents of their own and never keep a repeated line.  Only the id and text columns are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleanery.llm.words import U64, mix, released
from gleanery.session import stored

MIN_CHARS = 20
MIN_DOCS = 3
SPACES = " \t\n\x0b\x0c\r"
KEYS_PER_SHARD = 1 << 16
# Keys in one broadcast block: 28 bytes each.
KEYS_PER_BLOCK = 1 << 20
PER_BUCKET = 4
LOWEST = -(1 << 63)


def key_hashes(text: str | None, least: int = MIN_CHARS) -> tuple[list[str], list[bytes | None]]:
    """The lines of a text and the 128-bit hash of each key; None for keys that are too short."""
    lines = (text or "").split("\n")
    out: list[bytes | None] = []
    for line in lines:
        key = line.strip(SPACES) if len(line) >= least else ""
        out.append(hashlib.blake2b(key.encode("utf-8", "surrogatepass").lower(), digest_size=16).digest() if len(key) >= least else None)
    return lines, out


def _counts(least: int, each: bool = False) -> Callable:
    """Documents and largest id per key; with ``each`` one row per key and id, which counts as one document."""
    schema = pa.schema([("h1", pa.int64()), ("h2", pa.int64()), ("docs", pa.int64()), ("largest", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: dict[bytes, list[int]] = {}
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                doc = LOWEST if doc is None else doc
                for key in {h for h in key_hashes(text, least)[1] if h}:
                    if each:
                        key += doc.to_bytes(8, "little", signed=True)
                    held = found.get(key)
                    if held is None:
                        found[key] = [1, doc]
                    else:
                        held[0] = 1 if each else held[0] + 1
                        held[1] = max(held[1], doc)
            both = np.frombuffer(b"".join(key[:16] for key in found), np.int64).reshape(-1, 2)
            values = np.array(list(found.values()), np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(c)) for c in (both[:, 0], both[:, 1], values[:, 0], values[:, 1])], schema=schema)

    return run


def _slot(h1: np.ndarray, displacement: np.ndarray, n: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return (mix(h1 + displacement.astype(np.uint64) * U64(0x9E3779B97F4A7C15)) % U64(n)).astype(np.int64)


def build(h1: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Displacement of every bucket and slot of every key: n keys in n slots without collisions.

    Buckets are placed from the largest to the smallest; each takes the first displacement that puts all its keys into free
    slots.  Keys must be distinct.
    """
    n = len(h1)
    if len(np.unique(h1)) < n:
        raise ValueError("two line hashes agree in their first 64 bits")
    buckets = max(1, -(-n // PER_BUCKET))
    bucket = (mix(h1 ^ U64(0xD6E8FEB86659FD93)) % U64(buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    edge = np.searchsorted(bucket[order], np.arange(buckets + 1))
    size = np.diff(edge)
    free, slots, displacement = np.ones(n, bool), np.empty(n, np.int64), np.zeros(buckets, np.uint32)
    tries = np.arange(256, dtype=np.uint32)
    for b in np.argsort(-size, kind="stable"):
        if not size[b]:
            break
        keys = order[edge[b] : edge[b + 1]]
        start = 0
        while True:
            at = _slot(h1[keys][None, :], (tries + np.uint32(start))[:, None], n)
            fits = free[at].all(axis=1)
            if len(keys) > 1:
                ordered = np.sort(at, axis=1)
                fits &= (ordered[:, 1:] != ordered[:, :-1]).all(axis=1)
            if fits.any():
                k = int(np.argmax(fits))
                displacement[b], slots[keys] = start + k, at[k]
                free[at[k]] = False
                break
            start += len(tries)
    return displacement, slots


SHARD = "shard long, n long, displacement binary, fingerprints binary, counts binary, largest binary"


def _shards() -> Callable:
    def run(key: tuple, table: pa.Table) -> pa.Table:
        h1 = table["h1"].to_numpy().view(np.uint64)
        displacement, slots = build(h1)

        def placed(name: str, kind) -> bytes:
            out = np.empty(len(h1), kind)
            out[slots] = table[name].to_numpy()
            return out.tobytes()

        return pa.table({
            "shard": pa.array([key[0].as_py()]), "n": pa.array([len(h1)]), "displacement": pa.array([displacement.tobytes()]),
            "fingerprints": pa.array([placed("h2", np.int64)]), "counts": pa.array([placed("docs", np.int64)]),
            "largest": pa.array([placed("largest", np.int64)]),
        })

    return run


def lookup(shards: dict[int, tuple], modulus: int, h1: np.ndarray, h2: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(found, count, largest id) of every probe in the shards given."""
    found, count, largest = np.zeros(len(h1), bool), np.zeros(len(h1), np.int64), np.zeros(len(h1), np.int64)
    shard = ((h1 >> U64(1)) % U64(modulus)).astype(np.int64)
    for s in np.unique(shard):
        if s not in shards:
            continue
        n, displacement, fingerprints, counts, ids = shards[s]
        at = np.flatnonzero(shard == s)
        bucket = (mix(h1[at] ^ U64(0xD6E8FEB86659FD93)) % U64(len(displacement))).astype(np.int64)
        slot = _slot(h1[at], displacement[bucket], n)
        hit = fingerprints[slot] == h2[at]
        found[at], count[at], largest[at] = hit, counts[slot], ids[slot]
    return found, count, largest


def _probe(block, modulus: int, least: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shards = {
            s: (n, np.frombuffer(d, np.uint32), np.frombuffer(f, np.int64), np.frombuffer(c, np.int64), np.frombuffer(g, np.int64))
            for s, n, d, f, c, g in block.value
        }
        for batch in batches:
            ids, texts, left = (batch.column(k).to_pylist() for k in range(3))
            lines_of, probes, owner = [], [], []
            for d, (text, remain) in enumerate(zip(texts, left)):
                lines, hashed = key_hashes(text, least) if remain else ([], [])
                lines_of.append(lines)
                for k, h in enumerate(hashed):
                    if h:
                        probes.append(h)
                        owner.append((d, k))
            both = np.frombuffer(b"".join(probes), np.int64).reshape(-1, 2)
            found, _, largest = lookup(shards, modulus, np.ascontiguousarray(both[:, 0]).view(np.uint64), both[:, 1])
            drop: dict[int, set[int]] = {}
            for p in np.flatnonzero(found):
                d, k = owner[p]
                if ids[d] is None or ids[d] != largest[p]:
                    drop.setdefault(d, set()).add(k)
            for d, gone in drop.items():
                kept = [line for k, line in enumerate(lines_of[d]) if k not in gone]
                texts[d], left[d] = "\n".join(kept), len(kept)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(texts, pa.string()), pa.array(left, pa.int64()), *batch.columns[3:]], schema=batch.schema)

    return run


def dropped_lines(
    docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", least: int = MIN_CHARS, min_docs: int = MIN_DOCS,
    keys_per_shard: int = KEYS_PER_SHARD, keys_per_block: int = KEYS_PER_BLOCK,
) -> DataFrame:
    """All columns of ``docs`` with the text left over, and _n_lines and _n_left: lines before and after."""
    spark = docs.sparkSession
    text = F.coalesce(F.col(f"`{text_column}`").cast("string"), F.lit(""))
    pairs = docs.select(F.col(f"`{id_column}`").cast("bigint").alias("id"), text.alias("text"))
    counted = "h1 bigint, h2 bigint, docs bigint, largest bigint"
    again = stored(pairs.where("id IS NOT NULL").groupBy("id").agg(F.count("*").alias("n")).where("n > 1").select("id"), "repeated-ids")
    if again.isEmpty():
        keys = pairs.mapInArrow(released(_counts(least)), counted)
    else:
        once = pairs.join(again, "id", "left_anti").mapInArrow(released(_counts(least)), counted)
        keys = once.unionByName(pairs.join(again, "id", "left_semi").mapInArrow(released(_counts(least, True)), counted).distinct())
    repeated = stored(
        keys.groupBy("h1", "h2").agg(F.sum("docs").alias("docs"), F.max("largest").alias("largest")).where(F.col("docs") >= min_docs), "lines")
    total = repeated.count()
    modulus = max(1, -(-total // keys_per_shard))
    shard = F.shiftrightunsigned("h1", 1) % modulus
    index = stored(repeated.withColumn("shard", shard).groupBy("shard").applyInArrow(_shards(), SHARD), "shards")

    rest = [F.col(f"`{c}`") for c in docs.columns if c not in (id_column, text_column)]
    n_lines = (F.length(text) - F.length(F.replace(text, F.lit("\n"))) + 1).cast("bigint")
    out = docs.select(F.col(f"`{id_column}`").cast("bigint").alias("_id"), text.alias("_text"), n_lines.alias("_left"), n_lines.alias("_lines"),
                      F.struct(F.lit(0).alias("_"), *rest).alias("_rest"))
    per_block = max(1, keys_per_block // keys_per_shard)
    for first in range(0, modulus if total else 0, per_block):
        rows = index.where((F.col("shard") >= first) & (F.col("shard") < first + per_block)).collect()
        block = spark.sparkContext.broadcast([(r[0], r[1], *(bytes(x) for x in r[2:])) for r in rows])
        out = out.mapInArrow(released(_probe(block, modulus, least)), out.schema)
    named = {c: F.col(f"_rest.`{c}`") for c in docs.columns if c not in (id_column, text_column)}
    named |= {id_column: F.col("_id"), text_column: F.when(F.col("_left") > 0, F.col("_text")).otherwise("")}
    return out.select(*[named[c].alias(c) for c in docs.columns], F.col("_lines").alias("_n_lines"), F.col("_left").alias("_n_left"))


SQL = r"""
WITH l AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i
  FROM documents
), k AS (
  SELECT doc_id, i, line, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l
), r AS (
  SELECT key, max(doc_id) AS largest FROM k WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3
)
SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (largest IS NOT NULL AND largest <> doc_id)::BIGINT AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (largest IS NULL OR largest = doc_id), '')) AS kept_sha256
FROM k LEFT JOIN r USING (key) GROUP BY doc_id
"""
