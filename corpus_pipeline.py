"""A training corpus from raw documents: five stages, each one operator of ``gleanery.llm``.

Every stage takes (spark, docs, sf_dir), works on all rows that its predecessor kept and returns a DataFrame; ``run`` writes each
result as Parquet to the shared folder and reads it again for the next stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleanery.llm import decontamination, jaccard_join, line_dedup, quality_classifier, sentencepiece_fst
from gleanery.session import stored

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier selects; it learns from the rated documents of the given tables."""
    return quality_classifier.scored(docs, _table(spark, sf_dir, "labels")).where("_kept").select(*COLUMNS)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated lines leave all documents but the last that holds them; every document stays, an emptied one with an empty text."""
    out = line_dedup.dropped_lines(docs)
    changed = F.col("_n_left") < F.col("_n_lines")
    return out.withColumn("n_chars", F.when(changed, F.length("text").cast("bigint")).otherwise(F.col("n_chars"))).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of similar ones: the one with the smallest id.

    Rows that repeat an id are one document and stay together.  Rows without an id can't stand for a group or be told from each
    other; they stay.
    """
    found = jaccard_join.similar_components(docs).where("id IS NOT NULL").groupBy("id")
    later = found.agg(F.bool_and(F.col("id") != F.col("component_id")).alias("later")).where("later").select("id")
    return docs.join(later, docs["doc_id"] == later["id"], "left_anti").select(*COLUMNS)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontamination.decontaminated(docs, _table(spark, sf_dir, "benchmark")).select(*COLUMNS)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Piece counts and digests of the ids, and whether they decode to the text."""
    found = sentencepiece_fst.piece_digests(docs)
    return found.select(F.col("id").alias("doc_id"), "n_pieces", "ids_crc32", "round_trip")


STAGES = [
    ("quality classifier", quality),
    ("line dedup", lines),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", benchmark),
    ("SentencePiece encoding and decoding", tokens),
]

# A trained classifier, string tiling and shortest paths have no counterpart in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
