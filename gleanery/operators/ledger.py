"""Research runs: funnel, staleness, latest publication and item badges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleanery.functions import records, vocab

STALE_SECONDS = 360
DAILY = r"^daily-\d{4}-\d{2}-\d{2}$"


def mark_stale(runs: DataFrame, as_of: Column) -> DataFrame:
    """Runs still open six minutes after their start are reported as failed."""
    stale = (F.col("status") == "running") & (
        F.unix_micros(as_of) - F.unix_micros("started_at") > STALE_SECONDS * 1_000_000
    )
    return runs.withColumn("finished_at", F.when(stale, as_of).otherwise(F.col("finished_at"))).withColumn(
        "status", F.when(stale, F.lit("failed")).otherwise(F.col("status"))
    )


def published_daily_runs(runs: DataFrame, run_events: DataFrame) -> DataFrame:
    published = run_events.where(F.col("node") == vocab.PUBLISH_NODE).select(F.col("run_id").alias("id"))
    return runs.where(F.col("id").rlike(DAILY) & F.col("status").isin("completed", "partial")).join(
        published, "id", "left_semi"
    )


def latest_daily_run(runs: DataFrame, run_events: DataFrame) -> DataFrame:
    """Newest published daily run by finish time, at most one row."""
    finish = F.coalesce("finished_at", "started_at")
    return published_daily_runs(runs, run_events).orderBy(finish.desc(), "id").limit(1)


def last_finished(runs: DataFrame) -> DataFrame:
    done = runs.where(F.col("status").isin("completed", "partial"))
    return done.agg(F.max("finished_at").alias("last_finished"))


def start_day(runs: DataFrame, as_of: Column, full: bool) -> DataFrame:
    return last_finished(runs).select(
        records.research_start(as_of, F.col("last_finished"), full).alias("start_day")
    )


def badge_items(items: DataFrame, runs: DataFrame, run_events: DataFrame) -> DataFrame:
    """Adds the run badge columns shown beside an item."""
    daily = published_daily_runs(runs, run_events).select(F.col("id").alias("run_id"), F.lit(True).alias("daily"))
    latest = latest_daily_run(runs, run_events).select(F.col("id").alias("run_id"), F.lit(True).alias("latest"))
    joined = items.join(daily, "run_id", "left").join(latest, "run_id", "left")
    return (
        joined.withColumn("daily", F.coalesce("daily", F.lit(False)))
        .withColumn("latest", F.coalesce("latest", F.lit(False)))
        .withColumn("first_here", F.coalesce("first_seen_run_id", "run_id") == F.col("run_id"))
    )


def recent_runs(runs: DataFrame, limit: int = 40) -> DataFrame:
    return runs.orderBy(F.desc("started_at"), F.desc("id")).limit(limit)


def funnel(rows: DataFrame, run: str, steps: dict[str, Column]) -> DataFrame:
    """One row per run with a count per step."""
    return rows.groupBy(run).agg(*[F.count_if(condition).alias(name) for name, condition in steps.items()])


def search_cost(plan: DataFrame, *groups: str) -> DataFrame:
    """Basic questions cost one credit, advanced ones two."""
    advanced = F.col("search_depth").eqNullSafe("advanced")
    return plan.groupBy(*groups).agg(
        F.count_if(~advanced).alias("basic"), F.count_if(advanced).alias("advanced"),
        F.sum(F.when(advanced, 2).otherwise(1)).alias("credits"),
    )


def first_failure(conditions: dict[str, Column]) -> Column:
    """Name of the first condition that holds, NULL when none does."""
    result = F.lit(None).cast("string")
    for name, condition in reversed(list(conditions.items())):
        result = F.when(F.coalesce(condition, F.lit(False)), F.lit(name)).otherwise(result)
    return result


def lane_distribution(documents: DataFrame, lanes: list[str], source: str = "source") -> DataFrame:
    """Documents per lane, lanes without documents included."""
    lane = F.lit(None).cast("string")
    for name in reversed(lanes):
        lane = F.when(F.startswith(F.col(source), F.lit(name)), F.lit(name)).otherwise(lane)
    counts = documents.groupBy(lane.alias("lane")).agg(F.count("*").alias("n")).where("lane is not null")
    every = documents.sparkSession.createDataFrame([(x,) for x in lanes], "lane string")
    return every.join(counts, "lane", "left").select("lane", F.coalesce("n", F.lit(0)).alias("n"))


def top_companies(items: DataFrame, limit: int = 8, arrival: str = "arrival") -> DataFrame:
    """Companies with most published items; ties keep the one seen first."""
    name = F.when(F.coalesce(F.col("company"), F.lit("")) == "", F.lit(vocab.INDUSTRY)).otherwise(F.col("company"))
    counted = items.groupBy(name.alias("company")).agg(F.count("*").alias("n"), F.min(arrival).alias("_first"))
    return counted.orderBy(F.desc("n"), "_first").limit(limit).drop("_first")


def facet_counts(items: DataFrame, column: str = "category") -> DataFrame:
    return items.groupBy(column).agg(F.count("*").alias("n"))


def dashboard_metrics(items: DataFrame, major: Column, companies: DataFrame, sources: DataFrame, most: int = 3) -> DataFrame:
    """One row: published items, signals shown (``most`` at the most), companies and sources."""
    counted = items.agg(F.count("*").alias("items"), F.least(F.lit(most), F.count_if(major)).alias("signals"))
    # One-row aggregates.
    return counted.join(F.broadcast(companies.agg(F.count("*").alias("companies")))).join(
        F.broadcast(sources.agg(F.count("*").alias("sources"))))


def latest_items(items: DataFrame, runs: DataFrame, run_events: DataFrame) -> DataFrame:
    latest = latest_daily_run(runs, run_events).select(F.col("id").alias("run_id"))
    return items.join(F.broadcast(latest), "run_id", "left_semi")


def feed_filter(
    items: DataFrame, query: str = "", topic: str | None = None, category: str | None = None
) -> DataFrame:
    """Case-insensitive substring over title, summary and company, plus optional facets."""
    text = F.lower(F.concat_ws(" ", "title", "summary", "company"))
    kept = items.where(F.contains(text, F.lower(F.lit(query))))
    if topic:
        kept = kept.where(F.col("topic") == topic)
    if category:
        kept = kept.where(F.col("category") == category)
    return kept


def feed_order(by: str, tie: str = "id") -> list[Column]:
    """Sort keys of the feed: importance rank, or effective date with the newest first."""
    if by == "importance":
        rank = F.array_position(F.array(*[F.lit(v) for v in vocab.IMPORTANCE]), F.col("importance"))
        return [rank.asc(), F.col(tie).asc()]
    return [F.desc("effective_at"), F.col(tie).asc()]


def fingerprint(rows: DataFrame, *columns: Column | str) -> DataFrame:
    """Order-free digest of a keyed row set: equal exactly when the rows are equal.

    Row hashes are summed in four 60-bit lanes, so the digest needs one small partial aggregate
    per task and never a sorted list of all rows.
    """
    digest = F.sha2(F.to_json(F.array(*[F.coalesce((F.col(c) if isinstance(c, str) else c).cast("string"), F.lit("\u0000")) for c in columns])), 256)
    hashed = rows.select(digest.alias("_h"))
    lanes = [
        F.sum(F.conv(F.substring("_h", 1 + 15 * i, 15), 16, 10).cast("decimal(38,0)")).alias(f"_s{i}") for i in range(4)
    ]
    total = hashed.agg(F.count("*").alias("n"), *lanes)
    text = F.concat_ws(":", F.col("n"), *[F.coalesce(F.col(f"_s{i}"), F.lit(0)).cast("string") for i in range(4)])
    return total.select("n", F.sha2(text, 256).alias("basis"))


def newest_archives(archives: DataFrame, keep: int = 12) -> DataFrame:
    return archives.orderBy(F.desc("archived_at"), F.desc("id")).limit(keep)

