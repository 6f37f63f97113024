"""Token counts behind a digest cache.

The cache is a table of (content digest, tokenizer version, n_tokens).  Documents are joined to it by the SHA-256 of their
content and the digest of the tokenizer file and library; of the contents without an entry one text each is encoded, and the
counts are appended to the cache.  A run over documents that were counted before encodes nothing.

Texts go to the library in pieces: a space that follows a non-space starts a piece of a sentencepiece model whose pieces hold
the space mark only in front, so the count of a text is the sum over its pieces, and each distinct piece of a batch is encoded
once.  Texts for which this doesn't hold (runs of spaces, spaces at either end, the mark itself) are encoded whole.

A null text is counted as an empty one (no tokens).  Repeated rows and ids each get their row.  Only the id and text columns
are read.  Two jobs may append the same entry; readers take one of equal entries.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleanery.session import stored

MODEL = "piece_bpe_32k.model"
LIMIT = 4096
CACHE = "content string, version string, n_tokens bigint"
MEMO = 1_000_000
_WHOLE = re.compile("^ | $|  |▁")
_state: dict[str, tuple[object, dict[str, int]]] = {}


def version(name: str) -> str:
    """Digest of the tokenizer: its file, its library and that library's version."""
    import public_tokenizers

    if name.endswith(".model"):
        import sentencepiece as library
    else:
        import tokenizers as library
    with open(public_tokenizers.path(name), "rb") as file:
        return hashlib.sha256(file.read() + f"\n{library.__name__} {library.__version__}".encode()).hexdigest()


def _library(name: str) -> tuple[object, dict[str, int]]:
    if name not in _state:
        import public_tokenizers

        if name.endswith(".model"):
            import sentencepiece

            processor = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(name))
            if any("▁" in processor.id_to_piece(i).lstrip("▁") for i in range(processor.get_piece_size())):
                raise ValueError("pieces of this model cross spaces")
            _state[name] = (lambda texts: [len(x) for x in processor.encode(texts, num_threads=1)], {})
        else:
            from tokenizers import Tokenizer

            tokenizer = Tokenizer.from_file(public_tokenizers.path(name))
            tokenizer.no_truncation()
            tokenizer.no_padding()
            _state[name] = (lambda texts: [len(x.ids) for x in tokenizer.encode_batch_fast(texts, add_special_tokens=False)], {})
    return _state[name]


def counted(texts: list[str], name: str = MODEL) -> list[int]:
    """Tokens of every text."""
    count, memo = _library(name)
    if not name.endswith(".model"):
        return count(texts)
    out = np.zeros(len(texts), np.int64)
    whole = [k for k, t in enumerate(texts) if _WHOLE.search(t)]
    if whole:
        out[whole] = count([texts[k] for k in whole])
    skip = set(whole)
    rest = [k for k in range(len(texts)) if k not in skip]
    if rest:
        parts = pc.split_pattern(pa.array([texts[k] for k in rest], pa.large_string()), " ")
        coded = parts.flatten().dictionary_encode()
        pieces = coded.dictionary.to_pylist()
        missing = [p for p in pieces if p not in memo]
        if len(memo) + len(missing) > MEMO:
            memo.clear()
            missing = pieces
        memo.update(zip(missing, count(missing)))
        each = np.fromiter((memo[p] for p in pieces), np.int64, len(pieces))
        total = np.concatenate(([0], np.cumsum(each[coded.indices.to_numpy()])))
        edge = parts.offsets.to_numpy()
        out[rest] = total[edge[1:]] - total[edge[:-1]]
    return out.tolist()


def _encode(name: str) -> Callable:
    schema = pa.schema([("content", pa.string()), ("n_tokens", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counted(batch.column(1).to_pylist(), name), pa.int64())], schema=schema)

    return run


def token_counts(docs: DataFrame, cache: str, name: str = MODEL, limit: int = LIMIT, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(id, n_bytes, n_tokens, over_limit) of every row; ``cache`` is the folder of the cache table, made when absent."""
    spark = docs.sparkSession
    mark = version(name)
    spark.createDataFrame([], CACHE).write.mode("append").parquet(cache)
    known = spark.read.schema(CACHE).parquet(cache).where(F.col("version") == mark).groupBy("content").agg(F.max("n_tokens").alias("n_tokens"))
    text = F.coalesce(F.col(f"`{text_column}`").cast("string"), F.lit(""))
    rows = docs.select(F.col(f"`{id_column}`").alias("_id"), text.alias("_text"), F.sha2(text, 256).alias("content"))
    misses = rows.select("content", "_text").join(known, "content", "left_anti").dropDuplicates(["content"])
    fresh = stored(misses.mapInArrow(_encode(name), "content string, n_tokens bigint"), "counts")
    fresh.select("content", F.lit(mark).alias("version"), "n_tokens").write.mode("append").parquet(cache)
    every = known.unionByName(fresh).groupBy("content").agg(F.max("n_tokens").alias("n_tokens"))
    sizes = rows.select("_id", F.octet_length("_text").cast("bigint").alias("n_bytes"), "content")
    return sizes.join(every, "content").select(
        F.col("_id").alias(id_column), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
