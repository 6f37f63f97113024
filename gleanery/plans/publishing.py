"""Gate, portfolio, snapshots, reports and the flagship publication chain."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import functions as F

from gleanery.functions import vocab
from gleanery.operators import fusion, gate, insights, ledger, portfolio
from gleanery.plans import research
from gleanery.plans.matching import CLUSTER_SQL, page_items
from gleanery.plans.records import SCORED_SQL, scored_orders
from gleanery.plans.registry import register, table
from gleanery.plans.urls import PAGE_POLICY
from gleanery.schemas import EVIDENCE, INSIGHT, ITEM, PROFILE, RUN
from gleanery.session import shared_folder
from gleanery.sources import snapshots

# The vocabulary of the gate for the language of the page table.
PATTERNS = {
    "industrial": "th|er", "business": "tion", "excluded": "nicht|que", "concrete": "the|and|la", "analysis": "of",
    "partnership": "with|avec", "deliverable": "to|is", "generic": "ing.*ion", "preview": "theat", "production": "anre.*on",
}
COMPANIES = ["ththed.example.net", "thther.example.org", "blog.tionsh.example.net", "m.ththth.example.net"]

ITEM_SQL = CLUSTER_SQL[: CLUSTER_SQL.index("  k AS (")].rstrip().rstrip(",").replace("WITH RECURSIVE", "WITH")
GATE_SQL = (
    ITEM_SQL
    + """,
  f AS (SELECT *, title || ' ' || summary AS claim, site || '' AS s2, (page_id % 40 + 60) / 100.0 AS sure,
          CASE page_id % 4 WHEN 0 THEN 'critical' WHEN 3 THEN 'normal' ELSE 'high' END AS importance,
          company IN ('ththed.example.net', 'thther.example.org') AS focus FROM c),
  t AS (SELECT f.*, d.host, CASE WHEN ends_with(host, '.example.org') OR host = 'ththre.example.com' OR ends_with(host, '.ththre.example.com')
           OR host = 'ththhe.example.com' OR ends_with(host, '.ththhe.example.com') OR host = 'ththin.example.com' OR ends_with(host, '.ththin.example.com') THEN 'primary'
           WHEN host IN ('therea.example.net', 'ththed.example.net', 'm.ththth.example.net') OR ends_with(host, '.therea.example.net') OR ends_with(host, '.ththed.example.net') THEN 'authoritative'
           WHEN ends_with(host, '.example.net') THEN 'professional' ELSE 'untrusted' END AS tier FROM f JOIN d USING (page_id)),
  e AS (SELECT *, tier <> 'untrusted' AS cited, CASE WHEN tier <> 'untrusted' THEN title || ' ' || summary ELSE '' END AS proof FROM t),
  a AS (SELECT *, claim || ' ' || proof AS every FROM e),
  r AS (SELECT page_id, list_filter([
      CASE WHEN NOT cited THEN 'no_trusted_evidence' END,
      CASE WHEN sure < 0.68 THEN 'low_confidence' END,
      CASE WHEN NOT (regexp_matches(every, '(?i)th|er') OR (focus AND regexp_matches(every, '(?i)tion')))
             OR (regexp_matches(every, '(?i)nicht|que') AND NOT regexp_matches(claim, '(?i)th|er')) THEN 'out_of_scope' END,
      CASE WHEN NOT regexp_matches(claim, '(?i)the|and|la') THEN 'not_concrete' END,
      CASE WHEN company = '行业' AND regexp_matches(claim, '(?i)ing.*ion') AND NOT regexp_matches(every, '(?i)of') THEN 'generic_trend' END,
      CASE WHEN regexp_matches(claim, '(?i)with|avec') AND NOT regexp_matches(claim, '(?i)to|is') THEN 'vague_partnership' END,
      CASE WHEN cited AND tier <> 'primary' AND NOT (tier = 'authoritative' AND sure >= 0.76)
             AND NOT (focus AND tier = 'professional' AND importance <> 'normal' AND sure >= 0.82) THEN 'weak_sources' END,
      CASE WHEN importance = 'normal' AND NOT focus AND tier <> 'primary' AND NOT (tier = 'authoritative' AND sure >= 0.82) THEN 'low_value' END,
      CASE WHEN len(list_filter(regexp_extract_all(claim, '\\d+(?:\\.\\d+)?\\s*(?:UNITS)'),
             lambda t: NOT contains(regexp_replace(proof, '\\s+', '', 'g'), regexp_replace(t, '\\s+', '', 'g')))) > 0 THEN 'unsupported_number' END,
      CASE WHEN regexp_matches(proof, '(?i)theat') AND regexp_matches(claim, '(?i)anre.*on') THEN 'overstated' END
    ], lambda x: x IS NOT NULL) AS reasons FROM a)
""".replace("UNITS", "|".join(vocab.NUMBER_UNITS))
)


def assessed_pages(spark, sf):
    return gate.assess(page_items(spark, sf), PAGE_POLICY, COMPANIES, PATTERNS)


@register(GATE_SQL + "SELECT page_id, array_to_string(reasons, ' ') AS reasons, len(reasons) = 0 AS publishable FROM r")
def publication_gate(spark, sf):
    return assessed_pages(spark, sf).select(
        F.col("arrival").alias("page_id"), F.array_join("reasons", " ").alias("reasons"), (F.size("reasons") == 0).alias("publishable")
    )


@register(GATE_SQL + "SELECT reason, count(*) AS n FROM (SELECT unnest(reasons) AS reason FROM r) GROUP BY reason")
def gate_rejections(spark, sf):
    return gate.rejections(assessed_pages(spark, sf))


def order_candidates(spark, sf):
    """Scored orders with the customer's nation as company and the priority as category."""
    customers = table(spark, sf, "customer").join(table(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    joined = scored_orders(spark, sf).join(customers, F.col("o_custkey") == F.col("c_custkey"))
    company = F.when(F.col("c_nationkey") < 2, F.lit("")).otherwise(F.concat("n_name", F.lit(" "), "c_mktsegment"))
    return portfolio.with_company_key(joined.select(
        "o_orderkey", "score", company.alias("company"), F.col("o_orderpriority").alias("category"), "o_orderdate"
    ))


FOCUS = ["NATION_3 BUILDING", "nation 4 machinery", "NATION-5 AUTOMOBILE", "absent company"]


EXTRACT_SQL = (
    SCORED_SQL.replace("WITH", "WITH RECURSIVE", 1)
    + """,
  j AS (SELECT s.o_orderkey, s.score, o.o_orderdate, o.o_orderpriority AS category,
     CASE WHEN c_nationkey < 2 THEN '行业' ELSE lower(regexp_replace(n_name || c_mktsegment, '[\\s\\p{P}\\p{S}]', '', 'g')) END AS company
     FROM s JOIN orders o USING (o_orderkey) JOIN customer ON o.o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey),
  p AS (SELECT *, row_number() OVER (PARTITION BY company, category ORDER BY score DESC, o_orderkey) AS n FROM j),
  q AS (SELECT *, row_number() OVER (PARTITION BY category ORDER BY score DESC, o_orderkey) AS m FROM p WHERE n <= CASE WHEN company = '行业' THEN 22 ELSE 3 END),
  l AS (SELECT *, row_number() OVER (PARTITION BY company ORDER BY score DESC, o_orderkey) AS f FROM p),
  k(place, key) AS (VALUES (1, 'nation3building'), (2, 'nation4machinery'), (3, 'nation5automobile'), (4, 'absentcompany')),
  x AS (SELECT o_orderkey, company, category, score, o_orderdate FROM q WHERE m <= 119
    UNION SELECT o_orderkey, company, category, score, o_orderdate FROM l WHERE f = 1 AND company IN (SELECT key FROM k))
"""
)


@register(
    EXTRACT_SQL
    + """,
  y AS (SELECT *, row_number() OVER (ORDER BY score DESC, o_orderkey) AS r FROM x),
  agenda AS (
    SELECT 1 AS phase, place AS part, min(r) AS r FROM y JOIN k ON company = key GROUP BY place
    UNION ALL SELECT 2, min(r) OVER (PARTITION BY category), r FROM y
    UNION ALL SELECT 3, 0, r FROM y UNION ALL SELECT 4, 0, r FROM y),
  a AS (SELECT row_number() OVER (ORDER BY phase, part, r) AS i, phase, part, y.* FROM agenda JOIN y USING (r)),
  t AS (SELECT least(45, count(*)) AS target FROM j),
  g(i, picks, companies, categories, served, strict) AS (
    SELECT 0::BIGINT, []::BIGINT[], []::VARCHAR[], []::VARCHAR[], -1::BIGINT, 0::BIGINT
    UNION ALL
    SELECT v.i, CASE WHEN ok THEN list_append(picks, r) ELSE picks END, CASE WHEN ok THEN list_append(companies, company) ELSE companies END,
      CASE WHEN ok THEN list_append(categories, category) ELSE categories END, CASE WHEN ok AND phase = 2 THEN part ELSE served END,
      CASE WHEN phase = 4 THEN strict ELSE len(picks) + CASE WHEN ok THEN 1 ELSE 0 END END
    FROM (SELECT a.*, g.picks, g.companies, g.categories, g.served, g.strict,
        len(picks) < 54 AND NOT list_contains(picks, r) AND (phase <> 2 OR served <> part) AND (phase < 4 OR strict < (SELECT target FROM t))
        AND len(list_filter(categories, lambda c: c = category)) < CASE WHEN phase = 4 THEN 16 ELSE 14 END
        AND len(list_filter(companies, lambda c: c = company)) < CASE WHEN company = '行业' THEN CASE WHEN phase = 4 THEN 22 ELSE 18 END
          WHEN phase = 4 OR company IN (SELECT key FROM k) THEN 3 ELSE 2 END AS ok
      FROM g JOIN a ON a.i = g.i + 1) v),
  e AS (SELECT unnest(picks) AS r, generate_subscripts(picks, 1) AS pick_no FROM g WHERE i = (SELECT max(i) FROM a))
  SELECT o_orderkey, company AS company_key, category, round(score, 6)::DOUBLE AS score, pick_no::INTEGER AS pick_no, o_orderdate FROM e JOIN y USING (r)
"""
)
def balanced_portfolio(spark, sf):
    """The published 54: company and category caps, configured companies and categories first."""
    picked = portfolio.balanced_portfolio(order_candidates(spark, sf), FOCUS, tie="o_orderkey")
    return picked.select("o_orderkey", "company_key", "category", F.round("score", 6).alias("score"), "pick_no", "o_orderdate")


@register(
    EXTRACT_SQL[: EXTRACT_SQL.index("  x AS (")].rstrip().rstrip(",")
    + """
  SELECT o_orderkey, company AS company_key, category FROM q WHERE m <= 128
  UNION SELECT o_orderkey, company, category FROM l WHERE f = 1 AND company IN ('nation3building', 'nation4machinery', 'nation5automobile', 'absentcompany')
"""
)
def portfolio_extract(spark, sf):
    """The fixed-size extract that the greedy pick runs on."""
    keys = [portfolio.text.identity_key(c) for c in FOCUS]
    return portfolio.extract(order_candidates(spark, sf), keys, "o_orderkey").select("o_orderkey", "company_key", "category")


@register()
def flagship_publication(spark, sf):
    """Fetched pages to the published snapshot: gate, fusion, window, gate, balanced portfolio."""
    now = F.lit("2024-01-21").cast("timestamp")
    found = research.verified_items(page_items(spark, sf), PAGE_POLICY, COMPANIES, PATTERNS)
    chosen = research.published_items(None, found, PAGE_POLICY, COMPANIES, now, patterns=PATTERNS)
    return chosen.select("id", "title", "company", "category", "importance", "effective_at", "observed_at", F.size("evidence").alias("citations"))


def new_folder(spark) -> str:
    return f"{shared_folder(spark).rstrip('/')}/snapshots-{uuid.uuid4().hex}"


@register(
    GATE_SQL + """SELECT 'newer' AS snapshot, page_id, 'critical' AS importance FROM r WHERE len(reasons) = 0 AND page_id % 4 = 0
      UNION ALL SELECT 'archive', 1, 'run-older'"""
)
def snapshot_roundtrip(spark, sf):
    """Two publishes and a repeated one; the reader sees the newer snapshot, the older is archived."""
    root, now = new_folder(spark), F.lit("2024-01-21").cast("timestamp")
    passed = gate.publishable(assessed_pages(spark, sf))
    snapshots.publish({"items": passed.where("importance = 'high'")}, root, "run-older", now)
    for _ in range(2):
        snapshots.publish({"items": passed.where("importance = 'critical'")}, root, "newer", now)
    shown = snapshots.read_snapshot(spark, root, "items", ITEM)
    archived = snapshots.archives(spark, root)
    return shown.select(F.lit("newer").alias("snapshot"), F.col("arrival").alias("page_id"), "importance").unionByName(
        archived.select(F.lit("archive").alias("snapshot"), F.col("sequence").alias("page_id"), F.col("run_id").alias("importance"))
    )


@register(
    GATE_SQL + """SELECT 'items' AS name, page_id::VARCHAR AS key FROM r WHERE len(reasons) = 0 AND page_id % 4 = 0
      UNION ALL SELECT 'profiles', s_name FROM supplier UNION ALL SELECT 'insights', conv_id || '-' || turn FROM conversations
      UNION ALL SELECT 'runs', 'run-' || (o_custkey % 30) FROM orders GROUP BY 2
      UNION ALL SELECT 'archived items', page_id::VARCHAR FROM r WHERE len(reasons) = 0 AND page_id % 4 IN (1, 2)
      UNION ALL SELECT 'archived profiles', s_name FROM supplier WHERE s_suppkey % 2 = 0
      UNION ALL SELECT 'archive', 'run-a' UNION ALL SELECT 'refused', 'run-late'"""
)
def snapshot_tables(spark, sf):
    """Items, profiles, insights and run cards in one commit; an incremental publish brings insights only, a late publisher is refused."""
    root, now = new_folder(spark), F.lit("2024-01-21").cast("timestamp")
    passed = gate.publishable(assessed_pages(spark, sf))
    suppliers = table(spark, sf, "supplier").select(
        F.col("s_suppkey").cast("string").alias("id"), F.col("s_name").alias("name"), *[F.lit("").alias(c) for c in ("narrative", "positioning")],
        *[F.array().cast("array<string>").alias(c) for c in ("solutions", "capabilities")], *[F.lit("").alias(c) for c in ("funding", "implication")],
        F.array().cast(EVIDENCE).alias("evidence"), now.alias("updated_at"), F.lit("official").alias("basis"), F.col("s_suppkey").alias("arrival"))
    runs = table(spark, sf, "orders").select(F.concat(F.lit("run-"), F.col("o_custkey") % 30).alias("id")).distinct().select(
        "id", F.lit(None).cast("date").alias("run_date"), *[F.lit("x").alias(c) for c in ("mode", "status")], now.alias("started_at"),
        now.alias("finished_at"), F.lit(0).alias("item_count"))
    reports = conversation_reports(spark, sf).withColumn("basis", F.lit("x"))
    first = snapshots.publish({"items": passed.where("importance = 'high'"), "profiles": suppliers.where("arrival % 2 = 0")}, root, "run-a", now)
    snapshots.publish({"items": passed.where("importance = 'critical'"), "profiles": suppliers, "insights": reports.limit(0), "runs": runs}, root, "run-b", now)
    try:
        snapshots.publish({"items": passed.limit(0)}, root, "run-late", now, base=first)
        refused = []
    except snapshots.Superseded:
        refused = [("refused", "run-late")]
    snapshots.publish({"insights": reports}, root, "run-c", now, snapshots.INCREMENTAL)

    def listed(name, df, key):
        return df.select(F.lit(name).alias("name"), F.col(key).cast("string").alias("key"))

    parts = [
        listed("items", snapshots.read_snapshot(spark, root, "items", ITEM), "arrival"), listed("profiles", snapshots.read_snapshot(spark, root, "profiles", PROFILE), "name"),
        listed("insights", snapshots.read_snapshot(spark, root, "insights", INSIGHT), "run_id"), listed("runs", snapshots.read_snapshot(spark, root, "runs", RUN), "id"),
        listed("archived items", snapshots.read_archive(spark, root, "run-a", "items", ITEM), "arrival"),
        listed("archived profiles", snapshots.read_archive(spark, root, "run-a", "profiles", PROFILE), "name"),
        listed("archive", snapshots.archives(spark, root), "run_id"), spark.createDataFrame(refused, "name string, key string"),
    ]
    return reduce(lambda a, b: a.unionByName(b), parts)


@register(
    GATE_SQL + """SELECT a.page_id AS page_id, title, summary AS fact, company,
      CASE page_id % 3 WHEN 0 THEN '产品发布' WHEN 1 THEN '解决方案' ELSE '企业战略' END AS category, left(summary, 350) AS quote
      FROM r JOIN a USING (page_id) WHERE len(reasons) = 0"""
)
def cross_event_input(spark, sf):
    """The compact view of publishable records that a cross-event report is written from."""
    passed = gate.publishable(assessed_pages(spark, sf)).withColumn("id", F.col("arrival"))
    return research.cross_event_view(passed).select(F.col("id").alias("page_id"), "title", "fact", "company", "category", F.col("evidence")[0]["quote"].alias("quote"))


@register(ITEM_SQL + " SELECT page_id, page_id % 20 AS day FROM c ORDER BY page_id % 20 DESC, page_id LIMIT 54")
def merged_order(spark, sf):
    """Records newest observation first, the first ones of equal age in arrival order."""
    newest = fusion.latest_first(page_items(spark, sf)).limit(vocab.PORTFOLIO_MAX)
    return newest.select(F.col("arrival").alias("page_id"), F.pmod(F.col("arrival"), F.lit(20)).alias("day"))


@register("SELECT conv_id || '-' || turn AS run_id FROM conversations WHERE turn % 2 = 0")
def current_insights(spark, sf):
    """Reports that rest on exactly the published events; those of an older corpus are dropped."""
    items = document_events(spark, sf)
    reports, older = conversation_reports(spark, sf), items.where("id <> '0'")
    fresh = F.split("run_id", "-")[1].cast("int") % 2 == 0
    stamped = reports.where(fresh).join(F.broadcast(insights.corpus_basis(items))).unionByName(reports.where(~fresh).join(F.broadcast(insights.corpus_basis(older))))
    return insights.current_reports(stamped, items).select("run_id")


def conversation_reports(spark, sf):
    """Conversations as conclusions that cite documents of the same number and its neighbours."""
    turns = table(spark, sf, "conversations")
    grouped = turns.select(
        F.col("conv_id").cast("string").alias("run_id"), "turn", F.col("text"),
        F.array(*[F.col(c).cast("string") for c in ("conv_id", "turn")], F.when(F.col("turn") % 2 == 0, F.col("conv_id") + 1).otherwise(-F.lit(1)).cast("string")).alias("evidence_ids"),
    )
    conclusion = F.struct(*[F.col("text").alias(c) for c in ("concept", "judgment", "reasoning", "implication", "watchpoint")], "evidence_ids")
    return grouped.select(
        F.concat_ws("-", "run_id", "turn").alias("run_id"), F.lit(None).cast("timestamp").alias("generated_at"),
        F.lit("overview of the evidence that was found in this conversation").alias("overview"), F.array(conclusion).alias("conclusions"),
    )


def document_events(spark, sf):
    docs = table(spark, sf, "documents")
    entry = F.struct(F.concat(F.lit("https://"), "source", F.lit(".example.org/?utm_source=x")).alias("url"), F.lit("t").alias("title"), F.col("lang").alias("quote"))
    return docs.select(
        F.col("doc_id").cast("string").alias("id"), F.col("text").alias("title"), F.col("lang").alias("summary"), F.lit("").alias("implication"),
        F.lit("c").alias("category"), F.lit("t").alias("topic"), F.col("source").alias("company"), F.lit(None).cast("timestamp").alias("published_at"),
        F.lit("2024-01-01").cast("timestamp").alias("observed_at"), F.array(entry).alias("evidence"),
    )


INSIGHT_SQL = """
  WITH c AS (SELECT conv_id || '-' || turn AS run_id, length(trim(text, E' \\n')) AS len,
       list_distinct([conv_id, turn, CASE WHEN turn % 2 = 0 THEN conv_id + 1 ELSE -1 END]) AS ids FROM conversations),
  x AS (SELECT run_id, unnest(ids) AS id FROM c),
  s AS (SELECT run_id, count(doc_id) AS events, count(*) - count(doc_id) AS unknown, count(DISTINCT source) AS pages
        FROM x LEFT JOIN documents ON doc_id = id GROUP BY run_id)
"""


@register(INSIGHT_SQL + "SELECT run_id, events, unknown, pages FROM s")
def insight_support(spark, sf):
    return insights.support(conversation_reports(spark, sf), document_events(spark, sf)).select("run_id", "events", "unknown", "pages")


@register(
    INSIGHT_SQL
    + """
  SELECT run_id, rule FROM (
    SELECT run_id, unnest(list_filter([CASE WHEN len NOT BETWEEN 4 AND 60 THEN 'concept' END, CASE WHEN len NOT BETWEEN 20 AND 400 THEN 'judgment' END,
        CASE WHEN len NOT BETWEEN 20 AND 650 THEN 'reasoning' END, CASE WHEN len NOT BETWEEN 10 AND 400 THEN 'implication' END,
        CASE WHEN len NOT BETWEEN 10 AND 300 THEN 'watchpoint' END], lambda r: r IS NOT NULL)) AS rule FROM c
    UNION ALL SELECT run_id, 'events' FROM s WHERE events + unknown < 2 OR unknown > 0
    UNION ALL SELECT run_id, 'pages' FROM s WHERE pages < 2)
"""
)
def insight_violations(spark, sf):
    found = insights.violations(conversation_reports(spark, sf), document_events(spark, sf))
    return found.select("run_id", "rule")


@register(
    """
  WITH h AS (SELECT sha256(to_json([c_custkey::VARCHAR, c_name, c_mktsegment])) AS h FROM customer),
  s AS (SELECT count(*) AS n, sum(('0x' || substr(h, 1, 15))::BIGINT) AS a, sum(('0x' || substr(h, 16, 15))::BIGINT) AS b,
          sum(('0x' || substr(h, 31, 15))::BIGINT) AS c, sum(('0x' || substr(h, 46, 15))::BIGINT) AS d FROM h)
  SELECT n, sha256(n || ':' || a || ':' || b || ':' || c || ':' || d) AS basis FROM s
"""
)
def corpus_fingerprint(spark, sf):
    return ledger.fingerprint(table(spark, sf, "customer"), "c_custkey", "c_name", "c_mktsegment")


@register(
    """
  SELECT 'run-' || (user_id % 30) AS run_id, ts AS at, event_type AS node, 'event ' || event_id AS message,
         CASE WHEN value > 50 THEN 'completed' ELSE 'running' END AS status FROM events
"""
)
def run_log(spark, sf):
    """Log rows appended in two parts and read back."""
    rows = table(spark, sf, "events").select(
        F.concat(F.lit("run-"), F.col("user_id") % 30).alias("run_id"), F.col("ts").alias("at"), F.col("event_type").alias("node"),
        F.concat(F.lit("event "), "event_id").alias("message"), F.when(F.col("value") > 50, "completed").otherwise("running").alias("status"),
        (F.col("event_id") % 2).alias("part"))
    root = new_folder(spark)
    for part in (0, 1):
        snapshots.append_log(spark, root, rows.where(F.col("part") == part))
    return snapshots.read_log(spark, root)


@register("SELECT event_id, ts AS effective_at, user_id FROM events WHERE ts BETWEEN TIMESTAMP '2024-01-20' - INTERVAL 7 DAY AND TIMESTAMP '2024-01-20'")
def recent_snapshot(spark, sf):
    """All events are published by day; a week of them is read back from the files of its days."""
    root, now = new_folder(spark), F.lit("2024-01-20").cast("timestamp")
    every = table(spark, sf, "events").select("event_id", F.col("ts").alias("effective_at"), "user_id")
    snapshots.publish({"items": every}, root, "run-days", now)
    return snapshots.read_recent(spark, root, now, schema="event_id bigint, effective_at timestamp, user_id bigint", days=7)
