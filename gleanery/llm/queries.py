"""Registered queries of the operators for training data, each over the whole given table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from gleanery.llm import (
    chat_format, collocations, decontamination, jaccard_join, language_id, line_dedup, lm_scoring, prefix_trie, quality_classifier,
    quality_rules, sentencepiece_fst, token_counts, token_output,
)
from gleanery.session import stored

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def wrap(function):
        QUERIES[function.__name__] = function
        if sql:
            ORACLE[function.__name__] = sql
        return function

    return wrap


def remainder(modulus: int) -> Column:
    """crc32 of the id as text, modulo ``modulus``."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % modulus


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


@query(quality_rules.SQL)
def op1_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    return quality_rules.judged(table(spark, folder, "documents"))


JACCARD_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x20\x09-\x0D]+') AS ws FROM documents
), s AS (
  SELECT doc_id, list_distinct(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
    ELSE list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' ')) END) AS sh FROM w
), t AS (
  SELECT doc_id, unnest(sh) AS h FROM s
), n AS (
  SELECT doc_id, len(sh)::BIGINT AS n FROM s
), o AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM t a JOIN t b ON a.h = b.h AND a.doc_id <> b.doc_id GROUP BY ALL
), e AS (
  SELECT a, b FROM o JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * shared >= 80 * (x.n + y.n - shared)
), r AS (
  SELECT doc_id AS node, doc_id AS root FROM documents
  UNION
  SELECT e.b, r.root FROM r JOIN e ON e.a = r.node
)
SELECT n.doc_id, n.n AS n_shingles, min(root)::BIGINT AS component_id FROM n JOIN r ON r.node = n.doc_id GROUP BY ALL
"""


@query(JACCARD_SQL)
def op5_ngram_jaccard_join(spark: SparkSession, folder: str) -> DataFrame:
    return jaccard_join.similar_components(table(spark, folder, "documents")).withColumnRenamed("id", "doc_id")


@query()
def op7_token_id_output(spark: SparkSession, folder: str) -> DataFrame:
    path = token_output.write(table(spark, folder, "documents"), token_output.path_in(spark))
    return token_output.read(spark, path).withColumnRenamed("id", "doc_id")


@query(line_dedup.SQL)
def op9_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    out = line_dedup.dropped_lines(table(spark, folder, "documents"))
    return out.select(
        "doc_id", F.col("_n_lines").alias("n_lines"), (F.col("_n_lines") - F.col("_n_left")).alias("n_dropped"), F.sha2("text", 256).alias("kept_sha256"))


@query()
def op2_sentencepiece_codec(spark: SparkSession, folder: str) -> DataFrame:
    return sentencepiece_fst.piece_digests(table(spark, folder, "documents")).withColumnRenamed("id", "doc_id")


@query()
def op8_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    # A cache of its own for each run of the query, so that every run does the whole work.
    return token_counts.token_counts(table(spark, folder, "documents"), token_output.path_in(spark, "token-cache"))


@query()
def op3_quality_classifier(spark: SparkSession, folder: str) -> DataFrame:
    out = quality_classifier.scored(table(spark, folder, "documents"), table(spark, folder, "labels"))
    return out.select("doc_id", F.col("_expected_grade").alias("expected_grade"), F.col("_p_top").alias("p_top"), F.col("_kept").alias("kept"))


@query()
def op4_language_id(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    teaches = F.coalesce(remainder(4) != 2, F.lit(True))
    model = language_id.train(docs, teaches)
    found = language_id.identified(docs, model)
    return found.select("doc_id", F.coalesce(remainder(4) == 2, F.lit(False)).alias("held_out"), "lang_pred", "score")


@query()
def op6_benchmark_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    out = decontamination.benchmark_hits(table(spark, folder, "documents"), table(spark, folder, "benchmark"))
    return out.select(
        "doc_id", (F.size("_hits") > 0).alias("contaminated"), F.size("_hits").cast("bigint").alias("n_items"),
        F.array_sort(F.transform("_hits", lambda h: h["item_id"])).alias("item_ids"),
        F.aggregate("_hits", F.lit(0).cast("bigint"), lambda t, h: t + h["covered"]).alias("covered_tokens"))


@query()
def op10_lm_scoring(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    out = lm_scoring.scored(docs, F.coalesce(remainder(7) != 2, F.lit(True))).withColumnRenamed("id", "doc_id")
    return out.select("doc_id", F.coalesce(remainder(7) == 2, F.lit(False)).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


@query(collocations.SQL)
def op11_phrase_collocations(spark: SparkSession, folder: str) -> DataFrame:
    return collocations.collocations(table(spark, folder, "documents"))


@query(prefix_trie.SQL)
def op12_conversation_prefix_trie(spark: SparkSession, folder: str) -> DataFrame:
    return prefix_trie.shared_prefixes(table(spark, folder, "conversations"))


@query(chat_format.SQL)
def op13_chat_format(spark: SparkSession, folder: str) -> DataFrame:
    told = "</s>[INST] ok [/INST]"
    more = spark.createDataFrame([(-1, 0, "user", told), (-1, 1, "assistant", told)], "conv_id bigint, turn bigint, role string, text string")
    turns = table(spark, folder, "conversations").select("conv_id", "turn", "role", "text").unionByName(more)
    return chat_format.read_back(stored(chat_format.formatted(turns), "chats"))


QUERIES["pipeline"] = corpus_pipeline.run
if corpus_pipeline.ORACLE_SQL:
    ORACLE["pipeline"] = corpus_pipeline.ORACLE_SQL
