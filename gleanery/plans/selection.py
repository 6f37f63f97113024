"""Fair selection, weighted lanes, best row per URL, rotation and batching."""

from __future__ import annotations

from pyspark.sql import functions as F

from gleanery.functions import records
from gleanery.operators import selection
from gleanery.plans.registry import register, table

WEIGHTS = [("view", 4), ("click", 3), ("signup", 1), ("purchase", 1)]

DOCUMENT_SQL = """
  WITH d AS (SELECT md5(text) AS url, source, doc_id AS arrival, CASE WHEN lang = 'de' THEN lang END AS profile FROM documents),
  b AS (SELECT url, source, arrival, profile, min(arrival) OVER (PARTITION BY url) AS position,
     row_number() OVER (PARTITION BY url ORDER BY (profile IS NOT NULL) DESC,
        CASE WHEN profile IS NOT NULL THEN -arrival ELSE arrival END DESC) AS n FROM d),
  u AS (SELECT url, source, arrival, profile, position FROM b WHERE n = 1)
"""


def document_arrivals(spark, sf):
    return table(spark, sf, "documents").select(
        F.md5("text").alias("url"), "source", F.col("doc_id").alias("arrival"),
        F.when(F.col("lang") == "de", F.col("lang")).alias("profile_company"),
    )


@register(DOCUMENT_SQL + "SELECT url, arrival, position, profile IS NOT NULL AS official FROM u")
def best_document_per_url(spark, sf):
    best = selection.best_documents(document_arrivals(spark, sf))
    return best.select("url", "arrival", "position", F.col("profile_company").isNotNull().alias("official"))


@register(
    DOCUMENT_SQL + """,
  r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY position) AS round,
               min(position) OVER (PARTITION BY source) AS source_first FROM u WHERE profile IS NULL)
  SELECT url, source, round FROM (SELECT * FROM r ORDER BY round, source_first LIMIT 78)
  UNION ALL SELECT url, source, NULL FROM u WHERE profile IS NOT NULL
"""
)
def fair_selection(spark, sf):
    chosen = selection.select_fair(document_arrivals(spark, sf), 78)
    return chosen.select("url", "source", F.col("round").cast("bigint").alias("round"))


LANES_SQL = """
  WITH w(lane, weight, lane_no) AS (VALUES ('view', 4, 0), ('click', 3, 1), ('signup', 1, 2), ('purchase', 1, 3)),
  a AS (SELECT event_id, event_type AS lane, user_id, weight, lane_no,
          row_number() OVER (PARTITION BY event_type, user_id ORDER BY event_id) AS round,
          min(event_id) OVER (PARTITION BY event_type, user_id) AS first FROM events JOIN w ON lane = event_type),
  b AS (SELECT *, row_number() OVER (PARTITION BY lane ORDER BY round, first) AS lane_pos FROM a),
  c AS (SELECT event_id, lane, lane_no, lane_pos, (lane_pos - 1) // weight AS cycle FROM b)
"""


@register(LANES_SQL + "SELECT event_id, lane_pos, cycle FROM c")
def weighted_lanes(spark, sf):
    """Reading position of every event under lane weights; unknown lanes are left out."""
    lanes = selection.weighted_lanes(table(spark, sf, "events"), WEIGHTS, "event_type", "user_id", "event_id")
    return lanes.select("event_id", F.col("lane_pos").cast("bigint").alias("lane_pos"), F.col("cycle").cast("bigint").alias("cycle"))


@register(LANES_SQL + "SELECT event_id, lane_pos, cycle FROM c ORDER BY cycle, lane_no, lane_pos LIMIT 100")
def weighted_lanes_top(spark, sf):
    lanes = selection.weighted_lanes(table(spark, sf, "events"), WEIGHTS, "event_type", "user_id", "event_id", limit=100)
    return lanes.select("event_id", F.col("lane_pos").cast("bigint").alias("lane_pos"), F.col("cycle").cast("bigint").alias("cycle"))


@register(
    """
  WITH c AS (SELECT user_id AS url, event_id AS arrival, CASE event_type WHEN 'purchase' THEN 5 WHEN 'signup' THEN 4 WHEN 'view' THEN 3 END AS priority,
               CASE WHEN event_type IN ('purchase', 'signup', 'view') THEN 'c' || user_id END AS focus FROM events),
  r AS (SELECT *, row_number() OVER (PARTITION BY url ORDER BY coalesce(priority, 0) DESC, (focus IS NOT NULL) DESC, arrival) AS n,
          min(arrival) OVER (PARTITION BY url) AS position FROM c)
  SELECT url, arrival, position, priority FROM r WHERE n = 1
"""
)
def best_candidate_per_url(spark, sf):
    kind = F.col("event_type")
    priority = F.when(kind == "purchase", 5).when(kind == "signup", 4).when(kind == "view", 3)
    candidates = table(spark, sf, "events").select(
        F.col("user_id").alias("url"), F.col("event_id").alias("arrival"), priority.alias("priority"),
        F.when(priority.isNotNull(), F.concat(F.lit("c"), "user_id")).alias("focus_company"),
    )
    return selection.best_candidates(candidates).select("url", "arrival", "position", "priority")


@register(
    """
  SELECT n_nationkey, ((n_nationkey - 10227 % (SELECT count(*) FROM nation)) + (SELECT count(*) FROM nation)) % (SELECT count(*) FROM nation) AS turn
  FROM nation
"""
)
def company_rotation(spark, sf):
    """Start of the list moves with the day number."""
    offset = F.unix_date(F.lit("1998-01-01").cast("date"))
    return selection.rotate(table(spark, sf, "nation"), "n_nationkey", offset).select(
        "n_nationkey", F.col("turn").cast("bigint").alias("turn")
    )


@register(
    """
  WITH missing AS (SELECT n_nationkey, n_name FROM nation WHERE n_nationkey % 3 = 0),
  q AS (SELECT n_nationkey AS turn, p.priority, n_name || '-' || p.priority AS query,
          row_number() OVER (PARTITION BY n_nationkey ORDER BY p.priority DESC) AS round
        FROM missing, (VALUES (3), (4), (5)) p(priority)),
  companies AS (SELECT query, row_number() OVER (ORDER BY round, turn) AS pos, 0 AS kind FROM q),
  themes AS (SELECT r_name AS query, row_number() OVER (ORDER BY r_regionkey) AS pos, 1 AS kind FROM region)
  SELECT query FROM (SELECT * FROM companies WHERE pos <= 12 UNION ALL SELECT * FROM themes) ORDER BY pos, kind LIMIT 12
"""
)
def interleaved_gaps(spark, sf):
    priorities = F.explode(F.array(F.lit(3), F.lit(4), F.lit(5)))
    companies = (
        table(spark, sf, "nation").where("n_nationkey % 3 = 0").select("n_nationkey", "n_name", priorities.alias("priority"))
    ).select(
        F.col("n_nationkey").alias("turn"), "priority", F.col("priority").alias("arrival"),
        F.concat_ws("-", "n_name", "priority").alias("query"),
    )
    themes = table(spark, sf, "region").select(F.col("r_regionkey").alias("ordinal"), F.col("r_name").alias("query"))
    return selection.interleave_gaps(companies, themes, 12).select("query")


BATCH_SQL = """
  WITH n AS (SELECT doc_id, lang = 'de' AS profile, row_number() OVER (ORDER BY lang = 'de', doc_id) - 1 AS n FROM documents),
  b AS (SELECT doc_id, profile, n // 5 AS batch_id, n % 5 AS doc_no FROM n)
"""


def document_batches(spark, sf):
    docs = table(spark, sf, "documents").select(
        "doc_id", F.when(F.col("lang") == "de", F.col("lang")).alias("profile_company")
    )
    return selection.analysis_batches(docs, "doc_id")


@register(BATCH_SQL + "SELECT doc_id, batch_id, doc_no FROM b")
def analysis_batches(spark, sf):
    return document_batches(spark, sf).select(
        "doc_id", F.col("batch_id").cast("bigint").alias("batch_id"), F.col("doc_no").cast("bigint").alias("doc_no")
    )


@register(
    BATCH_SQL + """,
  c AS (SELECT batch_id, count(*) AS documents, least(5, count(*) FILTER (NOT profile)) AS item_limit FROM b GROUP BY 1)
  SELECT batch_id, documents, item_limit, least(item_limit, ceil(item_limit * 0.7))::BIGINT AS item_target FROM c
"""
)
def batch_limits(spark, sf):
    limits = selection.batch_limits(document_batches(spark, sf))
    return limits.select(
        F.col("batch_id").cast("bigint").alias("batch_id"), "documents",
        F.col("item_limit").cast("bigint").alias("item_limit"), F.col("item_target").cast("bigint").alias("item_target"),
    )


@register(
    """
  SELECT n_nationkey, date '1997-12-02' AS full_start,
         CAST(greatest(TIMESTAMP '1997-12-30', max(o_orderdate) FILTER (o_orderstatus <> 'O' AND o_orderdate < TIMESTAMP '1998-01-01') - INTERVAL 2 DAY) AS DATE) AS next_start
  FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey GROUP BY n_nationkey
"""
)
def research_start(spark, sf):
    """Collection start of a full and of an incremental run, one research area per nation."""
    now = F.lit("1998-01-01").cast("timestamp")
    runs = (
        table(spark, sf, "orders").where(F.col("o_orderdate") < now)
        .join(table(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    )
    done = F.when(F.col("o_orderstatus") != "O", F.col("o_orderdate"))
    last = runs.groupBy("c_nationkey").agg(F.max(done).alias("last_finished"))
    areas = table(spark, sf, "nation").join(last, F.col("n_nationkey") == F.col("c_nationkey"), "left")
    return areas.select(
        "n_nationkey", records.research_start(now, F.col("last_finished"), True).alias("full_start"),
        records.research_start(now, F.col("last_finished"), False).alias("next_start"),
    )
