"""Phrase collocations: multikey three-way quicksort of suffix pointers, per language.

Texts with A-Z in lower case are cut at `[.,;:!?\\x0A-\\x0D]` into pieces and those into words `[^\\x20\\x09]+`.  A phrase is two to
``DEPTH`` words of one piece.  Phrases of at least ``least`` occurrences are candidates; each is cut in two where the score
``floor(1000 * a * n / (l * r))`` is lowest.

1. Words are counted over all texts.  A word's key is a 64-bit hash of language and word.
2. Neighbouring words that are both frequent are counted as pairs.  Frequent words and frequent pairs each become a bitmap over
   hashes, sent to all tasks.  Its size is bounded by ``MOST_BITS``; a bitmap that fills up lets more through and loses nothing.
3. Every word is the start of a suffix that ends before the first pair that can't be frequent, after ``DEPTH`` words, or with its
   piece.  Equal suffixes of a task are one row with a weight.  Suffixes are routed by their first two words, so that all of
   one beginning meet in one bucket; beginnings of ``hot`` or more occurrences are routed by the whole suffix.
4. Each bucket sorts its suffix pointers by multikey three-way quicksort to the maximum depth: a segment is split by a pivot
   word into less, equal and greater; the weight of an equal part is the count of the phrase up to that word, and parts below
   ``least`` are abandoned.  Counts of hot beginnings are partial, are never abandoned, and are added up by Spark.
5. Cuts, containment in longer candidates and the ranking are joins and aggregates over the candidates.  Products are decimals
   of 38 digits; the ranking is exact up to 10**35.

A null language is ``und``, a null text is empty; texts without words give nothing and an empty table no rows.  Rows are counted
as they are, repeated ones as often as they occur; other columns are not read.  A text is held whole by its task, whatever its
length.  Two words of a language are taken for one if their 64-bit hashes agree.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gleanery.llm import words
from gleanery.llm.words import U64, mix
from gleanery.session import stored

DEPTH = 5
LEAST = 100
TOP = 2000
INSIDE = 100
# Bytes of text that are worked on at a time, and rows that a task gathers before it sends them.
CHUNK = 1 << 22
GATHER = 1 << 19
# Suffix rows of a bucket, and occurrences from which a beginning is routed by whole suffixes.
PER_BUCKET = 1 << 19
HOT = 1 << 17
# Bits of a bitmap: 64 for each key, between these bounds (128 KB and 64 MB).
LEAST_BITS, MOST_BITS = 20, 29

# Characters that end a piece, and characters between words inside a piece.
ENDS_PIECE = b".,;:!?\n\x0b\x0c\r"
BETWEEN_WORDS = b" \t"

_BREAKS = np.zeros(256, bool)
_BREAKS[list(ENDS_PIECE)] = True
_SEPARATES = _BREAKS.copy()
_SEPARATES[list(BETWEEN_WORDS)] = True


class Tokens:
    """Words of a chunk of texts: spans, keys, and whether a word's successor stands in the same piece."""

    def __init__(self, texts: list[bytes], langs: list[str]):
        begin = np.zeros(len(texts) + 1, np.int64)
        np.cumsum([len(t) + 1 for t in texts], out=begin[1:])
        self.buffer = np.frombuffer((b"\n".join(texts) + b"\n").lower(), np.uint8)  # lower() changes A-Z only
        self.starts, self.ends = words.spans(self.buffer, _SEPARATES)
        self.langs = sorted(set(langs))
        code = {lang: k for k, lang in enumerate(self.langs)}
        own = np.array([code[lang] for lang in langs], np.int64)
        self.lang = np.repeat(own, np.diff(np.searchsorted(self.starts, begin)))
        seeds = np.array([int.from_bytes(hashlib.blake2b(x.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little") for x in self.langs], np.uint64)
        self.keys = mix(words.hashes(self.buffer, self.starts, self.ends) ^ seeds[self.lang])
        self.keys[self.keys == 0] = 1
        self.linked = np.ones(len(self.keys), bool)
        after = np.searchsorted(self.starts, np.flatnonzero(_BREAKS[self.buffer]))
        self.linked[after[after > 0] - 1] = False
        self.linked[-1:] = False

    def strings(self, at: np.ndarray) -> pa.Array:
        """The words at the given places."""
        sizes = self.ends[at] - self.starts[at]
        offsets = np.zeros(len(at) + 1, np.int32)
        np.cumsum(sizes, out=offsets[1:])
        places = np.repeat(self.starts[at] - offsets[:-1], sizes) + np.arange(offsets[-1])
        data = np.ascontiguousarray(self.buffer[places])
        return pa.StringArray.from_buffers(len(at), pa.py_buffer(offsets), pa.py_buffer(data))


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[Tokens]:
    texts, langs, held = [], [], 0
    for batch in batches:
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary())):
            text = text.as_py()
            texts.append(text)
            langs.append(lang)
            held += len(text)
            if held >= CHUNK:
                yield Tokens(texts, langs)
                texts, langs, held = [], [], 0
    if texts:
        yield Tokens(texts, langs)


def _added(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Counts of equal keys added up."""
    k, c = np.concatenate(keys), np.concatenate(counts)
    order = np.argsort(k, kind="stable")
    k, c = k[order], c[order]
    first = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]])) if len(k) else np.empty(0, np.int64)
    return k[first], (np.add.reduceat(c, first) if len(first) else c)


def _tallied(found: Iterator[np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Distinct keys and counts, kept back until ``GATHER`` distinct ones are there."""
    keys, counts, held = [], [], 0
    for some in found:
        distinct, n = np.unique(some, return_counts=True)
        keys.append(distinct)
        counts.append(n)
        held += len(distinct)
        if held >= GATHER:
            k, c = _added(keys, counts)
            keys, counts, held = [k], [c], len(k)
            if held >= GATHER // 2:
                yield k, c
                keys, counts, held = [], [], 0
    if keys:
        yield _added(keys, counts)


def _long(values: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(values).view(np.int64))


COUNTS = "key bigint, lang string, n bigint"
_COUNTS = pa.schema([("key", pa.int64()), ("lang", pa.string()), ("n", pa.int64())])


def _word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, null, count) of words, and (null, language, count) of all word occurrences."""
    totals: dict[str, int] = {}

    def keys() -> Iterator[np.ndarray]:
        for tokens in _read(batches):
            for lang, n in zip(tokens.langs, np.bincount(tokens.lang, minlength=len(tokens.langs)).tolist()):
                totals[lang] = totals.get(lang, 0) + n
            yield tokens.keys

    for k, c in _tallied(keys()):
        yield pa.RecordBatch.from_arrays([_long(k), pa.nulls(len(k), pa.string()), _long(c)], schema=_COUNTS)
    yield pa.RecordBatch.from_arrays([pa.nulls(len(totals), pa.int64()), pa.array(totals.keys(), pa.string()), pa.array(totals.values(), pa.int64())], schema=_COUNTS)


def bitmap(keys: DataFrame, most_bits: int = MOST_BITS) -> np.ndarray:
    """A bit for the leading bits of every key; the size follows the number of keys up to a fixed bound."""
    bits = min(max(int(keys.count() * 64).bit_length(), LEAST_BITS), most_bits)
    cell = F.shiftrightunsigned("key", 64 - bits)
    packed = keys.groupBy(F.shiftright(cell, 6).cast("int").alias("at")).agg(F.bit_or(F.expr(f"shiftleft(1L, cast(shiftrightunsigned(key, {64 - bits}) & 63 as int))")).alias("x"))
    out = np.zeros(1 << (bits - 6), np.int64)
    found = packed.toArrow()
    out[found["at"].to_numpy()] = found["x"].to_numpy()
    return out.view(np.uint64)


def _in(cells: np.ndarray, keys: np.ndarray) -> np.ndarray:
    cell = keys >> U64(64 - (len(cells).bit_length() - 1 + 6))
    return (cells[(cell >> U64(6)).astype(np.int64)] >> (cell & U64(63))) & U64(1) == U64(1)


def _pairs(tokens: Tokens, cells: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Key of the pair that begins at each word, and whether both words may be frequent and stand in one piece."""
    ok = _in(cells, tokens.keys)
    ok[:-1] &= ok[1:] & tokens.linked[:-1]
    ok[-1:] = False
    pair = np.zeros(len(tokens.keys), np.uint64)
    pair[:-1] = words.windows(tokens.keys, 2)
    return pair, ok


def _pair_counts(frequent) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def keys() -> Iterator[np.ndarray]:
            for tokens in _read(batches):
                pair, ok = _pairs(tokens, frequent.value)
                yield pair[ok]

        for k, c in _tallied(keys()):
            yield pa.RecordBatch.from_arrays([_long(k), _long(c)], names=["key", "n"])

    return run


SHIPPED = "bucket int, kind int, data binary, key bigint, lang string, word string"
_SHIPPED = pa.schema([("bucket", pa.int32()), ("kind", pa.int32()), ("data", pa.binary()), ("key", pa.int64()), ("lang", pa.string()), ("word", pa.string())])
COLD, WARM, WORD = 0, 1, 2


def packed(rows: np.ndarray, weights: np.ndarray) -> bytes:
    """Suffix rows (0 after the last word) as bytes: number of rows and distinct words, the words, lengths, weights, and places of words."""
    there = rows != 0
    table, places = np.unique(rows[there], return_inverse=True)
    return b"".join([
        np.array([len(rows), len(table)], np.int64).tobytes(), table.tobytes(), there.sum(axis=1).astype(np.uint8).tobytes(),
        weights.astype(np.int64).tobytes(), places.astype(np.int32).tobytes()])


def unpacked(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    n, m = np.frombuffer(data, np.int64, 2).tolist()
    table = np.frombuffer(data, np.uint64, m, 16)
    at = 16 + 8 * m
    sizes = np.frombuffer(data, np.uint8, n, at)
    weights = np.frombuffer(data, np.int64, n, at + n)
    rows = np.zeros((n, DEPTH), np.uint64)
    rows[np.arange(DEPTH)[None, :] < sizes[:, None]] = table[np.frombuffer(data, np.int32, -1, at + 9 * n)]
    return rows, weights


def _collapsed(rows: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Equal rows as one, weights added up."""
    if not len(rows):
        return rows, weights
    order = np.lexsort(rows.T[::-1])
    rows, weights = rows[order], weights[order]
    first = np.flatnonzero(np.concatenate([[True], (rows[1:] != rows[:-1]).any(axis=1)]))
    return rows[first], np.add.reduceat(weights, first)


def _suffixes(frequent, pairs, hot, buckets: int) -> Callable:
    """Suffix rows of all texts, packed by bucket, and the words that occur in them."""
    def ship(rows: list[np.ndarray], weights: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        r, w = _collapsed(np.concatenate(rows), np.concatenate(weights))
        with np.errstate(over="ignore"):
            begins = mix(r[:, 0] * words.STEP[0] + r[:, 1] * words.STEP[1] + U64(2))
            whole = mix((r * words.STEP[:DEPTH]).sum(axis=1, dtype=np.uint64))
        warm = _in(hot.value, begins)
        place = (np.where(warm, whole, mix(begins)) % U64(buckets)).astype(np.int64) * 2 + warm
        order = np.argsort(place, kind="stable")
        edges = np.flatnonzero(np.concatenate([[True], np.diff(place[order]) > 0, [True]]))
        parts = [(int(place[order[a]]), packed(r[order[a:b]], w[order[a:b]])) for a, b in zip(edges[:-1], edges[1:])]
        none = pa.nulls(len(parts))
        yield pa.RecordBatch.from_arrays([
            pa.array([p // 2 for p, _ in parts], pa.int32()), pa.array([p % 2 for p, _ in parts], pa.int32()), pa.array([d for _, d in parts], pa.binary()),
            none.cast(pa.int64()), none.cast(pa.string()), none.cast(pa.string())], schema=_SHIPPED)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, weights, held, seen = [], [], 0, np.empty(0, np.uint64)
        for tokens in _read(batches):
            pair, ok = _pairs(tokens, frequent.value)
            ok &= _in(pairs.value, pair)
            run_of = ok.astype(np.int8)
            for _ in range(DEPTH - 2):
                run_of[:-1] = np.where(ok[:-1], 1 + run_of[1:], 0)
            at = np.flatnonzero(ok)
            if not len(at):
                continue
            padded = np.concatenate([tokens.keys, np.zeros(DEPTH, np.uint64)])
            suffix = np.stack([np.where(run_of[at] >= d, padded[at + d], U64(0)) for d in range(DEPTH)], axis=1)
            suffix, weight = _collapsed(suffix, np.ones(len(suffix), np.int64))
            rows.append(suffix)
            weights.append(weight)
            held += len(suffix)
            used, first = np.unique(tokens.keys[np.concatenate([at, at + 1])], return_index=True)
            first = np.concatenate([at, at + 1])[first]
            fresh = ~np.isin(used, seen, assume_unique=True)
            if fresh.any():
                used, first = used[fresh], first[fresh]
                seen = used if len(seen) > GATHER else np.concatenate([seen, used])
                names = pa.array([tokens.langs[k] for k in tokens.lang[first]], pa.string())
                yield pa.RecordBatch.from_arrays([
                    pa.array((used % U64(buckets)).astype(np.int32)), pa.array(np.full(len(used), WORD, np.int32)), pa.nulls(len(used), pa.binary()),
                    _long(used), names, tokens.strings(first)], schema=_SHIPPED)
            if held >= GATHER:
                yield from ship(rows, weights)
                rows, weights, held = [], [], 0
        if rows:
            yield from ship(rows, weights)

    return run


def _bounds(sizes: np.ndarray) -> np.ndarray:
    out = np.zeros(len(sizes) + 1, np.int64)
    np.cumsum(sizes, out=out[1:])
    return out


def sorted_parts(rows: np.ndarray, weights: np.ndarray, least: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Multikey three-way quicksort of pointers to ``rows``: (depth, one pointer of each equal part, weight of the part).

    All segments of one size class of work are split at once.  A segment at depth d is split by a pivot among its words at d; its
    equal part goes on at d + 1, its other parts stay at d.  Parts whose weight is below ``least`` are abandoned, and so is the
    part of suffixes that have ended.
    """
    width = rows.shape[1]
    flat = np.ascontiguousarray(rows).ravel()
    pointers = np.arange(len(rows), dtype=np.int64) * width
    sizes, depths = np.array([len(rows)], np.int64), np.zeros(1, np.int64)
    if not len(rows):
        return
    while len(sizes):
        edges = _bounds(sizes)
        segment = np.repeat(np.arange(len(sizes)), sizes)
        key = flat[pointers + depths[segment]]
        low, middle, high = key[edges[:-1]], key[(edges[:-1] + edges[1:]) >> 1], key[edges[1:] - 1]
        pivot = np.maximum(np.minimum(low, middle), np.minimum(np.maximum(low, middle), high))
        part = 3 * segment + (1 + (key > pivot[segment]).astype(np.int64) - (key < pivot[segment]))
        counts = np.bincount(part, minlength=3 * len(sizes))
        starts = _bounds(counts)
        order = np.argsort(part, kind="stable")
        pointers = pointers[order]
        heavy = np.zeros(len(counts), np.int64)
        full = np.flatnonzero(counts)
        heavy[full] = np.add.reduceat(weights[pointers // width], starts[full])
        depth = np.repeat(depths, 3)
        depth[1::3] += 1
        alive = heavy >= least
        alive[1::3] &= pivot != 0
        equal = np.flatnonzero(alive[1::3]) * 3 + 1
        for d in range(2, width + 1):
            found = equal[depth[equal] == d]
            if len(found):
                yield d, pointers[starts[found]] // width, heavy[found]
        alive &= (depth < width) & (counts > 0)
        pointers = pointers[np.repeat(alive, counts)]
        sizes, depths = counts[alive], depth[alive]


GRAMS = "words array<bigint>, n bigint, key bigint, lang string, word string"
_GRAMS = pa.schema([("words", pa.list_(pa.int64())), ("n", pa.int64()), ("key", pa.int64()), ("lang", pa.string()), ("word", pa.string())])


def _sorted(least: int) -> Callable:
    """Phrases of each bucket with their counts, and every word once; rows come sorted by bucket and kind."""
    def phrases(blobs: list[bytes], kind: int) -> Iterator[pa.RecordBatch]:
        both = [unpacked(b) for b in blobs]
        rows, weights = np.concatenate([b[0] for b in both]), np.concatenate([b[1] for b in both])
        for depth, at, n in sorted_parts(rows, weights, least if kind == COLD else 1):
            offsets = pa.array(np.arange(len(at) + 1, dtype=np.int32) * depth)
            lists = pa.ListArray.from_arrays(offsets, _long(rows[at, :depth].ravel()))
            none = pa.nulls(len(at))
            yield pa.RecordBatch.from_arrays([lists, _long(n), none.cast(pa.int64()), none.cast(pa.string()), none.cast(pa.string())], schema=_GRAMS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, blobs, seen = None, [], set()
        for batch in batches:
            for bucket, kind, data, key, lang, word in zip(*(c.to_pylist() for c in batch.columns)):
                if (bucket, kind) != current:
                    if blobs:
                        yield from phrases(blobs, current[1])
                    current, blobs, seen = (bucket, kind), [], set()
                if kind != WORD:
                    blobs.append(data)
                elif key not in seen:
                    seen.add(key)
                    yield pa.RecordBatch.from_pylist([{"words": None, "n": None, "key": key, "lang": lang, "word": word}], _GRAMS)
        if blobs:
            yield from phrases(blobs, current[1])

    return run


def collocations(
    docs: DataFrame, text_column: str = "text", lang_column: str = "lang", least: int = LEAST, top: int = TOP, inside: int = INSIDE,
    per_bucket: int = PER_BUCKET, hot: int = HOT, most_bits: int = MOST_BITS,
) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the first ``top`` phrases of each language.

    ``least`` is the count from which a phrase is a candidate; ``inside`` drops a candidate that lies in a longer one of at
    least that percentage of its count.
    """
    spark = docs.sparkSession
    texts = docs.select(
        F.coalesce(F.col(f"`{lang_column}`").cast("string"), F.lit("und")).alias("lang"),
        F.coalesce(F.col(f"`{text_column}`").cast("string"), F.lit("")).alias("text"))
    counted = texts.mapInArrow(_word_counts, COUNTS).groupBy("key", "lang").agg(F.sum("n").alias("n"))
    counted = stored(counted.where(F.col("lang").isNotNull() | (F.col("n") >= least)), "words")
    frequent, totals = counted.where("key IS NOT NULL").select("key", "n"), counted.where("lang IS NOT NULL").select("lang", F.col("n").alias("total"))
    send = spark.sparkContext.broadcast
    may_words = send(bitmap(frequent, most_bits))
    paired = texts.mapInArrow(_pair_counts(may_words), "key bigint, n bigint").groupBy("key").agg(F.sum("n").alias("n")).where(F.col("n") >= least)
    paired = stored(paired, "pairs")
    may_pairs, may_heat = send(bitmap(paired, most_bits)), send(bitmap(paired.where(F.col("n") >= hot), most_bits))
    suffixes = paired.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    buckets = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")), -(-suffixes // per_bucket))
    routed = texts.mapInArrow(_suffixes(may_words, may_pairs, may_heat, buckets), SHIPPED)
    grams = stored(routed.repartition(buckets, "bucket").sortWithinPartitions("bucket", "kind").mapInArrow(_sorted(least), GRAMS), "grams")

    named = grams.where("key IS NOT NULL").select("key", "lang", "word").join(totals, "lang")
    phrases = stored(
        grams.where("words IS NOT NULL").groupBy("words").agg(F.sum("n").alias("a")).where(F.col("a") >= least)
        .join(named.select(F.col("key").alias("_k"), "lang", "total"), F.col("words")[0] == F.col("_k")).drop("_k"), "phrases")

    size = F.size("words")
    shorter = F.explode(F.array(F.slice("words", F.lit(1), size - 1), F.slice("words", F.lit(2), size - 1))).alias("part")
    longer = phrases.where(size > 2).select(shorter, "a").groupBy("part").agg(F.max("a").alias("most"))
    free = phrases.join(longer, phrases["words"] == longer["part"], "left").where(F.col("most").isNull() | (100 * F.col("most") < inside * F.col("a")))

    whole = lambda c: F.col(c).cast("decimal(20,0)")
    parts = phrases.select("words", F.col("a").alias("n")).unionByName(frequent.select(F.array("key").alias("words"), "n"))
    cuts = free.select("words", "a", "lang", "total", F.explode(F.sequence(F.lit(1), size - 1)).alias("k"))
    cuts = cuts.withColumn("left", F.slice("words", F.lit(1), F.col("k"))).withColumn("right", F.slice("words", F.col("k") + 1, size))
    cuts = cuts.join(parts.select(F.col("words").alias("left"), F.col("n").alias("l")), "left").join(parts.select(F.col("words").alias("right"), F.col("n").alias("r")), "right")
    cuts = cuts.withColumn("up", F.lit(1000).cast("decimal(4,0)") * whole("a") * whole("total")).withColumn("down", whole("l") * whole("r"))
    best = cuts.groupBy("words", "a", "lang", "total").agg(F.min(F.struct(F.expr("up div down").alias("score"), "k", "l", "r")).alias("cut"))
    scored = best.select("words", "a", "lang", F.col("total").alias("n"), "cut.score", "cut.l", "cut.r")

    # Ties at the end stay until phrases are spelt out.
    near = scored.withColumn("_rank", F.rank().over(Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a")))).where(F.col("_rank") <= top)
    spelt = near.select("words", F.posexplode("words").alias("_at", "_k")).join(named.select(F.col("key").alias("_k"), "word"), "_k")
    spelt = spelt.groupBy("words").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_at", "word"))), lambda x: x["word"]), " ").alias("phrase"))
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), F.asc("phrase"))
    ranked = near.drop("_rank").join(spelt, "words").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return ranked.select("lang", F.col("rank").cast("bigint").alias("rank"), "phrase", "a", "l", "r", "n", "score")


SQL = r"""
WITH p AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[.,;:!?\x0A-\x0D]')) AS piece FROM documents
), w AS (
  SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS ws FROM p
), n AS (
  SELECT lang, sum(len(ws))::BIGINT AS n FROM w GROUP BY lang
), s AS (
  SELECT lang, ws, unnest(range(1, len(ws) + 1)) AS i FROM w
), g AS (
  SELECT lang, ws[i:i + m - 1] AS g, count(*)::BIGINT AS f FROM s, range(1, 6) t(m) WHERE i + m - 1 <= len(ws) GROUP BY ALL HAVING count(*) >= 100
), o AS (
  SELECT lang, part, max(f) AS most FROM (
    SELECT lang, g[1:-2] AS part, f FROM g WHERE len(g) > 2 UNION ALL SELECT lang, g[2:] AS part, f FROM g WHERE len(g) > 2
  ) GROUP BY ALL
), c AS (
  SELECT g.lang, g.g, g.f AS a, unnest(range(1, len(g.g))) AS k FROM g LEFT JOIN o ON o.lang = g.lang AND o.part = g.g
  WHERE len(g.g) > 1 AND (most IS NULL OR 100 * most < 100 * g.f)
), x AS (
  SELECT c.lang, c.g, c.a, c.k, y.f AS l, z.f AS r, n.n, ((1000::HUGEINT * c.a * n.n) // (y.f::HUGEINT * z.f))::BIGINT AS score
  FROM c JOIN g y ON y.lang = c.lang AND y.g = c.g[1:c.k] JOIN g z ON z.lang = c.lang AND z.g = c.g[c.k + 1:] JOIN n ON n.lang = c.lang
), b AS (
  SELECT *, array_to_string(g, ' ') AS phrase FROM x QUALIFY row_number() OVER (PARTITION BY lang, g ORDER BY score, k) = 1
)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
FROM b QUALIFY rank <= 2000
"""
