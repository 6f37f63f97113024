"""Runs, funnels, facets and the dashboard feed."""

from __future__ import annotations

from pyspark.sql import functions as F

from gleanery.functions import vocab
from gleanery.operators import evidence, ledger
from gleanery.plans.registry import register, table


def as_of():
    return F.lit("1998-01-01").cast("timestamp")


@register(
    """
  SELECT user_id AS run_id, count(*) AS results, count(*) FILTER (event_type <> 'error') AS "read", count(*) FILTER (event_type IN ('signup', 'purchase')) AS effective,
         count(*) FILTER (event_type = 'error') AS failed, count(*) FILTER (event_type = 'purchase') AS analyzed FROM events GROUP BY user_id
"""
)
def run_funnel(spark, sf):
    kind = F.col("event_type")
    steps = {
        "results": F.lit(True), "read": kind != "error", "effective": kind.isin("signup", "purchase"),
        "failed": kind == "error", "analyzed": kind == "purchase",
    }
    return ledger.funnel(table(spark, sf, "events").withColumnRenamed("user_id", "run_id"), "run_id", steps)


@register("SELECT n_name AS company, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name ORDER BY n DESC, min(c_custkey) LIMIT 8")
def top_companies(spark, sf):
    rows = table(spark, sf, "customer").join(table(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return ledger.top_companies(rows.select(F.col("n_name").alias("company"), F.col("c_custkey").alias("arrival")))


@register("SELECT o_orderpriority AS category, count(*) AS n FROM orders GROUP BY 1")
def category_facets(spark, sf):
    return ledger.facet_counts(table(spark, sf, "orders").withColumnRenamed("o_orderpriority", "category"))


@register(
    """
  WITH l(lane) AS (VALUES ('src1'), ('src2'), ('src3'), ('absent'))
  SELECT lane, (SELECT count(*) FROM documents WHERE starts_with(source, lane)) AS n FROM l
"""
)
def lane_distribution(spark, sf):
    return ledger.lane_distribution(table(spark, sf, "documents"), ["src1", "src2", "src3", "absent"])


@register("SELECT l_orderkey, count(DISTINCT l_suppkey) AS pages, count(DISTINCT l_suppkey % 5) AS publishers FROM lineitem GROUP BY 1")
def distinct_sources(spark, sf):
    """Distinct pages and publishers behind every record."""
    cited = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(
        F.collect_list(F.struct(F.col("l_suppkey").alias("page"), (F.col("l_suppkey") % 5).alias("publisher"))).alias("details")
    )
    publishers = F.transform("details", lambda d: F.struct(d["publisher"].alias("page")))
    return cited.select(
        "l_orderkey", evidence.page_count("details").cast("bigint").alias("pages"), evidence.page_count(publishers).cast("bigint").alias("publishers")
    )


def order_runs(spark, sf):
    """Orders as research runs; one day in two has a daily run."""
    o = table(spark, sf, "orders")
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    run_id = F.when(F.col("o_orderkey") % 2 == 0, F.concat(F.lit("daily-"), day)).otherwise(F.concat(F.lit("manual-"), "o_orderkey"))
    status = F.when(F.col("o_orderstatus") == "F", F.lit("completed")).when(F.col("o_orderstatus") == "P", F.lit("running")).otherwise(F.lit("failed"))
    finished = F.when(F.col("o_orderstatus") != "P", F.col("o_orderdate") + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.col("o_orderkey") % 300))
    runs = o.select("o_orderkey", run_id.alias("id"), status.alias("status"), F.col("o_orderdate").alias("started_at"), finished.alias("finished_at"))
    log = o.select(run_id.alias("run_id"), F.when(F.col("o_orderkey") % 3 == 0, F.lit(vocab.PUBLISH_NODE)).otherwise(F.lit("采集")).alias("node"))
    return runs, log


RUN_SQL = """
  WITH r AS (SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN 'daily-' || strftime(o_orderdate, '%Y-%m-%d') ELSE 'manual-' || o_orderkey END AS id,
      CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'P' THEN 'running' ELSE 'failed' END AS status, o_orderdate AS started_at,
      CASE WHEN o_orderstatus <> 'P' THEN o_orderdate + to_seconds(o_orderkey % 300) END AS finished_at, o_orderkey % 3 = 0 AS logged FROM orders),
  p AS (SELECT * FROM r WHERE id LIKE 'daily-%' AND status = 'completed' AND id IN (SELECT id FROM r WHERE logged)),
  t AS (SELECT id, finished_at FROM p ORDER BY coalesce(finished_at, started_at) DESC, id LIMIT 1)
"""


@register(RUN_SQL + "SELECT id, finished_at FROM t")
def latest_daily_run(spark, sf):
    return ledger.latest_daily_run(*order_runs(spark, sf)).select("id", "finished_at")


@register(
    RUN_SQL + """SELECT r.o_orderkey, r.id IN (SELECT id FROM p) AS daily, r.id IN (SELECT id FROM t) AS latest, r.o_orderkey % 4 <> 1 AS first_here FROM r"""
)
def item_badges(spark, sf):
    runs, log = order_runs(spark, sf)
    first = F.when(F.col("o_orderkey") % 4 == 1, F.lit("other")).when(F.col("o_orderkey") % 4 == 2, F.col("id"))
    items = runs.select("o_orderkey", F.col("id").alias("run_id"), first.alias("first_seen_run_id"))
    return ledger.badge_items(items, runs.dropDuplicates(["id", "status"]), log).select("o_orderkey", "daily", "latest", "first_here")


@register(
    RUN_SQL + """SELECT o_orderkey, CASE WHEN status = 'running' AND started_at < TIMESTAMP '1998-01-01' - INTERVAL 360 SECOND THEN 'failed' ELSE status END AS status,
      CASE WHEN status = 'running' AND started_at < TIMESTAMP '1998-01-01' - INTERVAL 360 SECOND THEN TIMESTAMP '1998-01-01' ELSE finished_at END AS finished_at FROM r"""
)
def stale_runs(spark, sf):
    runs, _ = order_runs(spark, sf)
    return ledger.mark_stale(runs, as_of()).select("o_orderkey", "status", "finished_at")


@register(RUN_SQL + "SELECT id, started_at FROM r ORDER BY started_at DESC, id DESC LIMIT 40")
def recent_runs(spark, sf):
    runs, _ = order_runs(spark, sf)
    return ledger.recent_runs(runs).select("id", "started_at")


@register(RUN_SQL + "SELECT id, max(finished_at) AS archived_at FROM r WHERE finished_at IS NOT NULL GROUP BY id ORDER BY archived_at DESC, id DESC LIMIT 12")
def retained_archives(spark, sf):
    runs, _ = order_runs(spark, sf)
    dated = runs.where(F.col("finished_at").isNotNull()).groupBy("id").agg(F.max("finished_at").alias("archived_at"))
    return ledger.newest_archives(dated)


def feed_items(spark, sf):
    docs = table(spark, sf, "documents")
    return docs.select(
        F.col("doc_id").alias("id"), F.lit("").alias("title"), F.col("text").alias("summary"), F.col("source").alias("company"),
        F.col("lang").alias("topic"), F.when(F.col("doc_id") % 3 == 0, F.lit("critical")).when(F.col("doc_id") % 3 == 1, F.lit("high")).otherwise(F.lit("normal")).alias("importance"),
        F.lit("c").alias("category"), F.timestamp_seconds(F.col("n_chars") * 3600).alias("effective_at"),
    )


@register("SELECT doc_id AS id, source AS company FROM documents WHERE lang = 'en' AND (contains(lower(text), 'the and') OR contains(lower(source), 'the and'))")
def feed_search(spark, sf):
    return ledger.feed_filter(feed_items(spark, sf), "The AND", topic="en").select("id", "company")


@register("SELECT doc_id AS id FROM documents ORDER BY doc_id % 3, doc_id LIMIT 50")
def feed_by_importance(spark, sf):
    return feed_items(spark, sf).orderBy(*ledger.feed_order("importance")).limit(50).select("id")


@register("SELECT doc_id AS id FROM documents ORDER BY n_chars DESC, doc_id LIMIT 50")
def feed_by_date(spark, sf):
    return feed_items(spark, sf).orderBy(*ledger.feed_order("date")).limit(50).select("id")


@register(
    """
  SELECT count(*) AS items, least(3, count(*) FILTER (o_orderpriority = '1-URGENT')) AS signals,
         (SELECT count(*) FROM supplier) AS companies, (SELECT count(*) FROM customer WHERE c_acctbal > 0) AS sources FROM orders
"""
)
def dashboard_metrics(spark, sf):
    return ledger.dashboard_metrics(
        table(spark, sf, "orders"), F.col("o_orderpriority") == "1-URGENT", table(spark, sf, "supplier"),
        table(spark, sf, "customer").where("c_acctbal > 0"))
