"""Fair and weighted selection, best row per URL, rotation, interleaving and batching."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleanery.functions import vocab
from gleanery.operators.ranking import group_rank, top_per_group


def _best(df: DataFrame, key: str, arrival: str, rank: Column) -> DataFrame:
    """One row per key by the highest rank; its place is the earliest arrival of the key.

    An aggregate, not a window: copies of one key are combined before the shuffle.
    """
    others = [c for c in df.columns if c != key]
    picked = df.groupBy(key).agg(
        F.max_by(F.struct(*others), rank).alias("_row"), F.min(arrival).alias("position")
    )
    return picked.select(key, "_row.*", "position")


def best_candidates(df: DataFrame, url: str = "url", arrival: str = "arrival") -> DataFrame:
    """Highest priority wins, then company-tagged rows, then the first seen."""
    rank = F.struct(
        F.coalesce(F.col("priority"), F.lit(0)), F.col("focus_company").isNotNull(), -F.col(arrival)
    )
    return _best(df, url, arrival, rank)


def best_documents(df: DataFrame, url: str = "url", arrival: str = "arrival") -> DataFrame:
    """The first company-profile page wins, otherwise the last document seen."""
    profile = F.col("profile_company").isNotNull()
    rank = F.struct(profile, F.when(profile, -F.col(arrival)).otherwise(F.col(arrival)))
    return _best(df, url, arrival, rank)


def fair_selection(
    df: DataFrame, limit: int = vocab.TOTAL_LIMIT, source: str = "source", arrival: str = "position"
) -> DataFrame:
    """Round-robin over sources in first-seen order, at most ``limit`` rows."""
    rounds = top_per_group(df, [source], [arrival], limit, "round")
    first = F.min(arrival).over(Window.partitionBy(source))
    return rounds.withColumn("source_first", first).orderBy("round", "source_first").limit(limit)


def select_fair(documents: DataFrame, limit: int = vocab.TOTAL_LIMIT) -> DataFrame:
    """Best document per URL; official pages bypass the limit, the rest is chosen fairly."""
    unique = best_documents(documents)
    official = unique.where(F.col("profile_company").isNotNull())
    events = fair_selection(unique.where(F.col("profile_company").isNull()), limit)
    return official.withColumn("round", F.lit(None).cast("int")).unionByName(
        events.drop("source_first"), allowMissingColumns=True
    )


def weighted_lanes(
    df: DataFrame, weights: list[tuple[str, int]] = vocab.LANE_WEIGHTS, lane: str = "lane",
    key: str = "coverage_key", arrival: str = "arrival", limit: int | None = None,
) -> DataFrame:
    """Weighted round-robin over lanes, inside a lane round-robin over keys; unknown lanes dropped.

    Adds ``round``, ``lane_pos`` and ``cycle``; the reading order is (cycle, lane_no, lane_pos).
    With a limit only the rows that can be read are ranked.  Without one, every rank is found
    without putting a lane into one task.
    """
    lane_no = F.lit(None).cast("int")
    weight = F.lit(None).cast("int")
    for number, (name, share) in enumerate(weights):
        lane_no = F.when(F.col(lane) == name, F.lit(number)).otherwise(lane_no)
        weight = F.when(F.col(lane) == name, F.lit(share)).otherwise(weight)
    known = df.withColumn("lane_no", lane_no).withColumn("_w", weight).where(F.col("lane_no").isNotNull())
    firsts = known.groupBy(lane, key).agg(F.min(arrival).alias("_first"))
    if limit is None:
        rounds = group_rank(known, [lane, key], [arrival], "round")
    else:
        rounds = top_per_group(known, [lane, key], [arrival], limit, "round")
    placed = rounds.join(firsts, [lane, key])
    if limit is None:
        ranked = group_rank(placed, [lane], ["round", "_first"], "lane_pos")
    else:
        ranked = top_per_group(placed, [lane], ["round", "_first"], limit, "lane_pos")
    out = ranked.withColumn("cycle", F.floor((F.col("lane_pos") - 1) / F.col("_w"))).drop("_w", "_first")
    return out if limit is None else out.orderBy("cycle", "lane_no", "lane_pos").limit(limit)


def rotate(df: DataFrame, ordinal: str, offset: Column) -> DataFrame:
    """Adds ``turn``: the position of each row after moving the first ``offset`` rows to the end.

    Meant for the configured companies, whose number the settings check limits.
    """
    everyone = Window.partitionBy()
    ranked = df.withColumn("_place", F.row_number().over(Window.orderBy(ordinal)) - 1)
    count = F.count("*").over(everyone)
    return ranked.withColumn("turn", F.pmod(F.col("_place") - F.pmod(offset, count), count)).drop("_place")


def interleave_gaps(companies: DataFrame, themes: DataFrame, limit: int) -> DataFrame:
    """Company and theme questions alternate, company first, at most ``limit`` rows.

    ``companies`` has (turn, priority, query): dealt round-robin by turn, best priority first, at
    most 12.  ``themes`` has (ordinal, query).
    """
    deal = Window.partitionBy("turn").orderBy(F.desc("priority"), "arrival")
    dealt = companies.withColumn("round", F.row_number().over(deal)).orderBy("round", "turn").limit(12)
    order = Window.orderBy("round", "turn")
    first = dealt.select(F.row_number().over(order).alias("pos"), F.lit(0).alias("kind"), "query")
    second = themes.select(
        F.row_number().over(Window.orderBy("ordinal")).alias("pos"), F.lit(1).alias("kind"), "query"
    )
    return first.unionByName(second).orderBy("pos", "kind").limit(limit)


def analysis_batches(df: DataFrame, order: str, size: int = vocab.BATCH_SIZE) -> DataFrame:
    """Fixed-size batches, profile pages last, with the limits each batch is analysed under."""
    profile = F.col("profile_company").isNotNull()
    ranked = group_rank(df.withColumn("_tail", profile.cast("int")), [], ["_tail", order], "_n").drop("_tail")
    batched = ranked.withColumn("batch_id", F.floor((F.col("_n") - 1) / size)).withColumn(
        "doc_no", F.pmod(F.col("_n") - 1, F.lit(size)).cast("int")
    )
    return batched.drop("_n")


def batch_limits(batched: DataFrame, size: int = vocab.BATCH_SIZE) -> DataFrame:
    events = F.count_if(F.col("profile_company").isNull())
    counted = batched.groupBy("batch_id").agg(F.count("*").alias("documents"), events.alias("_e"))
    limit = F.least(F.lit(size), F.col("_e"))
    return counted.select(
        "batch_id", "documents", limit.alias("item_limit"),
        F.least(limit, F.ceil(limit * F.lit(0.7))).alias("item_target"),
    )
