"""Dates, windows, coercion, scores and signals over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from gleanery.functions import records, vocab
from gleanery.operators import portfolio
from gleanery.plans.registry import register, table

AS_OF = "1998-01-01 00:00:00"


def as_of():
    return F.lit(AS_OF).cast("timestamp")


@register(
    """
  SELECT event_id, CASE event_type WHEN 'error' THEN NULL WHEN 'view' THEN ts WHEN 'click' THEN date_trunc('day', ts)
     WHEN 'signup' THEN date_trunc('second', ts) - INTERVAL 8 HOUR ELSE date_trunc('second', ts) END AS published_at
  FROM events
"""
)
def feed_dates(spark, sf):
    """Event times written in the notations that feeds use, then parsed."""
    kind, ts = F.col("event_type"), F.col("ts")
    written = (
        F.when(kind == "error", F.concat(F.lit("yesterday "), F.col("event_id")))
        .when(kind == "view", F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'"))
        .when(kind == "click", F.date_format(ts, "yyyy-MM-dd"))
        .when(kind == "signup", F.date_format(ts, "EEE, dd MMM yyyy HH:mm:ss '+0800'"))
        .otherwise(F.date_format(ts, "EEEE, d MMM yyyy HH:mm:ss 'GMT'"))
    )
    return table(spark, sf, "events").select("event_id", records.parse_date(written).alias("published_at"))


@register(
    """
  SELECT o_orderkey, o_orderdate FROM orders
  WHERE o_orderdate BETWEEN TIMESTAMP '1998-01-01' - INTERVAL 30 DAY AND TIMESTAMP '1998-01-01'
"""
)
def recent_records(spark, sf):
    orders = table(spark, sf, "orders")
    return orders.where(records.in_window("o_orderdate", as_of())).select("o_orderkey", "o_orderdate")


@register(
    """
  SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P' OR o_orderdate >= TIMESTAMP '1998-01-01'
"""
)
def collection_window(spark, sf):
    published = F.when(F.col("o_orderstatus") != "P", F.col("o_orderdate"))
    return table(spark, sf, "orders").where(
        records.in_collection_window(published, F.lit("1998-01-01").cast("date"))
    ).select("o_orderkey")


@register(
    """
  SELECT o_orderkey,
    CASE WHEN o_orderstatus = 'P' THEN NULL ELSE o_orderdate END AS published_at,
    CASE WHEN o_orderstatus = 'P' AND o_orderpriority = '5-LOW' THEN o_orderdate - INTERVAL 9 DAY
         WHEN o_orderstatus = 'P' AND o_orderpriority = '2-HIGH' THEN TIMESTAMP '1998-01-01'
         WHEN o_orderstatus = 'P' THEN o_orderdate - INTERVAL 1 DAY
         ELSE o_orderdate END AS effective_at,
    CASE WHEN o_orderstatus = 'P' THEN 'observed' ELSE 'published' END AS date_basis
  FROM orders
"""
)
def item_dates(spark, sf):
    day = lambda n: F.col("o_orderdate") - F.make_dt_interval(F.lit(n))
    items = table(spark, sf, "orders").select(
        "o_orderkey",
        F.when(F.col("o_orderstatus") != "P", F.col("o_orderdate")).alias("published_at"),
        F.when(F.col("o_orderpriority") == "5-LOW", day(9)).alias("effective_at"),
        F.when(F.col("o_orderpriority") != "2-HIGH", day(1)).alias("observed_at"),
    )
    return records.normalise_dates(items, as_of()).select("o_orderkey", "published_at", "effective_at", "date_basis")


@register(
    """
  SELECT p_partkey,
    CASE WHEN regexp_matches(lower(p_name || ' ' || p_type), 'red|economy') THEN '资本动态'
         WHEN regexp_matches(lower(p_name || ' ' || p_type), 'gear|promo') THEN '技术前沿'
         WHEN regexp_matches(lower(p_name || ' ' || p_type), 'bolt') THEN '解决方案'
         WHEN p_brand = 'Brand#1' THEN '产品发布' WHEN p_brand = 'Brand#2' THEN '企业战略' ELSE '产业市场' END AS category
  FROM part
"""
)
def category_inference(spark, sf):
    rules = [("资本动态", "red|economy"), ("技术前沿", "gear|promo"), ("解决方案", "bolt")]
    supplied = F.when(F.col("p_brand") == "Brand#1", F.lit("新 品")).when(
        F.col("p_brand") == "Brand#2", F.lit("竞品动态")
    ).otherwise(F.col("p_brand"))
    return table(spark, sf, "part").select(
        "p_partkey", records.infer_category(supplied, "p_name", "p_type", rules).alias("category")
    )


@register(
    """
  WITH v AS (SELECT event_id, event_type, json_extract_string(props, '$.k')::INTEGER AS k FROM events)
  SELECT event_id,
    round(CASE event_type WHEN 'error' THEN 0.7 WHEN 'view' THEN k / 100.0
      WHEN 'click' THEN CASE WHEN k > 1 THEN k / 100.0 ELSE k END
      WHEN 'signup' THEN 0.0 ELSE least(1.0, k / 50.0 / CASE WHEN k / 50.0 > 1 THEN 100 ELSE 1 END) END, 6)::DOUBLE AS confidence,
    CASE event_type WHEN 'error' THEN 'critical' WHEN 'view' THEN 'high' WHEN 'click' THEN 'normal' WHEN 'signup' THEN 'high' ELSE 'normal' END AS importance,
    CASE event_type WHEN 'view' THEN '3D 模型 + AI' WHEN 'click' THEN '数字孪生' ELSE '工业智能' END AS topic,
    CASE event_type WHEN 'purchase' THEN k::VARCHAR ELSE 'a|b|' || k END AS parts
  FROM v
"""
)
def value_coercion(spark, sf):
    """Loose enumeration, confidence and list values to their strict forms."""
    kind, k = F.col("event_type"), F.get_json_object("props", "$.k")
    pick = lambda **v: F.coalesce(*[F.when(kind == n, x) for n, x in v.items()])
    sure = pick(error=F.lit("unknown"), view=F.concat(k, F.lit(" %")), click=k, signup=F.lit("-3"), purchase=(k.cast("int") / 50).cast("string"))
    sure = F.when((kind == "view") & (k.cast("int") <= 1), (k.cast("int") / 100).cast("string")).otherwise(sure)
    level = pick(error=F.lit("重大"), view=F.lit("high"), click=F.lit("低"), signup=F.lit("重 要"), purchase=F.lit("一般"))
    topic = pick(error=F.lit("工业 AI"), view=F.lit("3D+AI"), click=F.lit("数字孪生"), signup=F.lit("x"), purchase=F.lit(""))
    listed = pick(error=F.concat(F.lit("a、 b；"), k), view=F.concat(F.lit(" a,,b\n"), k), click=F.concat(F.lit("a，b;"), k), signup=F.concat(F.lit("a,b,"), k, F.lit(",")), purchase=k)
    return table(spark, sf, "events").select(
        "event_id",
        F.round(records.parse_confidence(sure), 6).alias("confidence"),
        records.coerce_enum(level, vocab.IMPORTANCE, vocab.IMPORTANCE_ALIASES, "normal").alias("importance"),
        records.coerce_enum(topic, vocab.TOPICS, vocab.TOPIC_ALIASES, vocab.DEFAULT_TOPIC).alias("topic"),
        F.array_join(records.split_values(listed), "|").alias("parts"),
    )


SCORED_SQL = """
  WITH ev AS (SELECT l_orderkey, count(DISTINCT l_suppkey) AS pages, count(*) AS citations FROM lineitem GROUP BY 1),
  i AS (SELECT o_orderkey, CASE o_orderpriority WHEN '1-URGENT' THEN 'critical' WHEN '2-HIGH' THEN 'high' ELSE 'normal' END AS importance,
          (round(o_totalprice * 100)::BIGINT % 101) / 100.0 AS confidence, o_orderdate, coalesce(pages, 0) AS pages,
          coalesce(citations, 0) AS citations, o_orderkey % 4 AS authority
        FROM orders LEFT JOIN ev ON l_orderkey = o_orderkey),
  s AS (SELECT *, CASE importance WHEN 'critical' THEN 42 WHEN 'high' THEN 24 ELSE 0 END + least(pages, 4) * 6 + floor(confidence * 20 + 0.5)
          + greatest(0.0, 14 - greatest(0.0, (epoch_us(TIMESTAMP '1998-01-01') - epoch_us(o_orderdate)) / 86400000000.0) / 2) AS score,
          (importance = 'critical' AND confidence >= 0.72 AND citations >= 1)
          OR (importance = 'high' AND confidence >= 0.82 AND (pages >= 2 OR authority >= 2)) AS major FROM i)
"""


def scored_orders(spark, sf):
    """Orders as records: priority is importance, line items are evidence, suppliers are pages."""
    evidence = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(
        F.countDistinct("l_suppkey").alias("pages"), F.count("*").alias("citations")
    )
    cents = F.round(F.col("o_totalprice") * 100).cast("bigint")
    level = F.when(F.col("o_orderpriority") == "1-URGENT", F.lit("critical")).when(
        F.col("o_orderpriority") == "2-HIGH", F.lit("high")
    ).otherwise(F.lit("normal"))
    joined = table(spark, sf, "orders").join(evidence, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    base = joined.select(
        "o_orderkey", "o_custkey", "o_orderdate", "o_orderpriority", level.alias("importance"), ((cents % 101) / 100.0).alias("confidence"),
        F.coalesce("pages", F.lit(0)).alias("pages"), F.coalesce("citations", F.lit(0)).alias("citations"),
        (F.col("o_orderkey") % 4).alias("authority"),
    )
    score = records.priority_score("importance", "pages", "confidence", "o_orderdate", as_of())
    major = records.is_major_signal("importance", "confidence", "citations", "pages", "authority")
    return base.withColumn("score", score).withColumn("major", major)


@register(SCORED_SQL + "SELECT o_orderkey, round(score, 6)::DOUBLE AS score, major FROM s")
def priority_scores(spark, sf):
    return scored_orders(spark, sf).select("o_orderkey", F.round("score", 6).alias("score"), "major")


@register(SCORED_SQL + "SELECT o_orderkey, round(score, 6)::DOUBLE AS score FROM s WHERE major ORDER BY score DESC, o_orderkey LIMIT 3")
def priority_signals(spark, sf):
    """The three strongest major signals."""
    strongest = portfolio.top_signals(scored_orders(spark, sf), 3, "o_orderkey")
    return strongest.select("o_orderkey", F.round("score", 6).alias("score"))
