"""URL identity, safety, membership and trust over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from gleanery.functions import urls, vocab
from gleanery.operators import trust
from gleanery.plans.registry import register, table

# Trust lists for the hosts that occur in the page table.
PAGE_POLICY = urls.TrustPolicy(
    primary=("example.org",),
    authoritative=("therea.example.net", "ththed.example.net", "m.ththth.example.net"),
    professional=("example.net",),
    websites=("https://www.ththin.example.com/", "ftp://ththre.example.com", "https://u:p@ththble.example.com"),
    builtin_sites=("https://ththre.example.com/", "https://www.ththhe.example.com"),
)

CANONICAL_SQL = """
  WITH cut AS (
    SELECT page_id, url, regexp_replace(url, '#.*$', '') AS bare FROM pages
  ), parts AS (
    SELECT page_id, split_part(bare, '?', 1) AS base,
           list_filter(string_split(split_part(bare, '?', 2), '&'),
                       lambda p: p <> '' AND NOT regexp_matches(lower(p), '^(utm_|fbclid=|gclid=)')) AS params
    FROM cut
  ), sorted AS (
    SELECT page_id,
           CASE WHEN length(base) - length(replace(base, '/', '')) = 2 THEN base || '/' ELSE base END AS base,
           list_transform(list_sort(list_transform(params, lambda p, i: {'n': split_part(p, '=', 1), 'i': i, 'p': p})),
                          lambda s: s.p) AS params
    FROM parts
  ), canonical AS (
    SELECT page_id,
           base || CASE WHEN len(params) > 0 THEN '?' || array_to_string(params, '&') ELSE '' END AS canonical
    FROM sorted
  )
"""


@register(CANONICAL_SQL + "SELECT page_id, canonical FROM canonical")
def canonical_urls(spark, sf):
    return table(spark, sf, "pages").select("page_id", urls.canonical_url("url").alias("canonical"))


@register(CANONICAL_SQL + "SELECT page_id, regexp_replace(canonical, '/$', '') AS page_key FROM canonical")
def evidence_urls(spark, sf):
    return table(spark, sf, "pages").select("page_id", urls.evidence_url("url").alias("page_key"))


@register(
    """
  WITH v AS (SELECT c_custkey, (c_custkey * 2654435761) % 4294967296 AS n FROM customer),
  shaped AS (
    SELECT c_custkey, n, (n // 16777216) || '.' || ((n // 65536) % 256) || '.' || ((n // 256) % 256) || '.' || (n % 256) AS quad
    FROM v)
  SELECT c_custkey,
    CASE c_custkey % 8
      WHEN 5 THEN false WHEN 6 THEN false
      WHEN 7 THEN true
      WHEN 4 THEN c_custkey % 3 <> 0
      ELSE NOT (
        n < 16777216 OR n BETWEEN 167772160 AND 184549375 OR n BETWEEN 1681915904 AND 1686110207
        OR n BETWEEN 2130706432 AND 2147483647 OR n BETWEEN 2851995648 AND 2852061183
        OR n BETWEEN 2886729728 AND 2887778303 OR n BETWEEN 3221225472 AND 3221225727
        OR n BETWEEN 3221225984 AND 3221226239 OR n BETWEEN 3227017984 AND 3227018239
        OR n BETWEEN 3232235520 AND 3232301055 OR n BETWEEN 3323068416 AND 3323199487
        OR n BETWEEN 3325256704 AND 3325256959 OR n BETWEEN 3405803776 AND 3405804031
        OR n >= 3758096384)
    END AS is_public
  FROM shaped
"""
)
def public_urls(spark, sf):
    """Every customer key is written as an address in one of several notations."""
    key = F.col("c_custkey")
    n = (key * 2654435761) % 4294967296
    octet = lambda shift: (F.shiftright(n, shift) % 256).cast("string")
    quad = F.concat_ws(".", octet(24), octet(16), octet(8), octet(0))
    partly = F.concat_ws(".", octet(24), (n % 16777216).cast("string"))
    hexed = F.concat(F.lit("0x"), F.hex(n))
    kind = key % 8
    url = (
        F.when(kind == 0, F.concat(F.lit("http://"), quad, F.lit("/x")))
        .when(kind == 1, F.concat(F.lit("https://"), n.cast("string")))
        .when(kind == 2, F.concat(F.lit("http://"), partly, F.lit(":80/")))
        .when(kind == 3, F.concat(F.lit("http://"), hexed, F.lit("/")))
        .when(kind == 4, F.when(key % 3 == 0, F.lit("http://printer.local/")).otherwise(F.lit("http://news.test/a")))
        .when(kind == 5, F.concat(F.lit("https://user:pw@site"), key, F.lit(".example.com/")))
        .when(kind == 6, F.concat(F.lit("https://site"), key, F.lit(".example.com:8080/")))
        .otherwise(F.concat(F.lit("https://site"), key, F.lit(".example.com/a?b=1")))
    )
    return table(spark, sf, "customer").select("c_custkey", urls.is_public_url(url).alias("is_public"))


HOST_SQL = "lower(regexp_extract(url, '^https?://([^/?#]+)', 1))"


TIER_SQL = f"""
  WITH h AS (SELECT page_id, {HOST_SQL} AS host FROM pages),
  d(domain, tier, rank, place) AS (VALUES
    ('example.org', 'primary', 1, 1), ('ththre.example.com', 'primary', 1, 2), ('ththhe.example.com', 'primary', 1, 3),
    ('ththin.example.com', 'primary', 1, 4),
    ('therea.example.net', 'authoritative', 2, 5), ('ththed.example.net', 'authoritative', 2, 6),
    ('m.ththth.example.net', 'authoritative', 2, 7), ('example.net', 'professional', 3, 8))
  SELECT page_id,
         coalesce(arg_min(tier, rank * 100 + place), 'untrusted') AS tier,
         coalesce(arg_min(domain, place), '') AS publisher
  FROM h LEFT JOIN d ON host = domain OR ends_with(host, '.' || domain)
  GROUP BY page_id
"""


@register(TIER_SQL)
def source_tiers(spark, sf):
    return table(spark, sf, "pages").select(
        "page_id", PAGE_POLICY.tier("url").alias("tier"), PAGE_POLICY.publisher("url").alias("publisher")
    )


@register(TIER_SQL)
def source_tiers_by_table(spark, sf):
    """The same tiers from a domain table that holds a site for every customer beside the listed domains."""
    more = table(spark, sf, "customer").select(
        F.concat(F.lit("shop"), "c_custkey", F.lit(".example.biz")).alias("domain"), F.lit("professional").alias("tier"), (F.col("c_custkey") + 1000).alias("ordinal"))
    domains = trust.domain_table(spark, PAGE_POLICY).unionByName(more)
    return trust.with_tiers(table(spark, sf, "pages"), domains).select("page_id", "tier", "publisher")



@register(
    """
  WITH u AS (SELECT c_custkey, c_custkey % 12 AS k FROM customer)
  SELECT c_custkey,
    CASE WHEN k IN (0, 1, 2, 3) THEN 3 WHEN k IN (4, 5, 6, 7) THEN 2 WHEN k IN (8, 9) THEN 1 ELSE 0 END AS authority,
    CASE WHEN k IN (0, 1, 2, 3) THEN 3 WHEN k IN (4, 5) THEN 2 WHEN k IN (6, 7, 8, 9) THEN 1 ELSE 0 END AS anchored
  FROM u
"""
)
def evidence_authority(spark, sf):
    """Citation hosts of every authority class; look-alike hosts only count when unanchored."""
    hosts = [
        "https://press.siemens.com/n/", "https://www.lab.edu/", "https://data.agency.gov.cn/", "http://www.arxiv.org/abs/",
        "https://www.reuters.com/a/", "https://www.people.com.cn/", "https://reuters-fake.test/", "https://fakegov.cn/",
        "https://smallmedia.test/", "https://siemens.com.evil.test/", "not a url ", "mailto:x@reuters.com?",
    ]
    spots = F.array(*[F.lit(h) for h in hosts])
    url = F.concat(F.element_at(spots, (F.col("c_custkey") % 12 + 1).cast("int")), F.col("c_custkey"))
    policy = urls.TrustPolicy()
    return table(spark, sf, "customer").select(
        "c_custkey", policy.authority(url).alias("authority"), policy.authority(url, anchored=True).alias("anchored")
    )


@register(
    f"""
  WITH h AS (SELECT page_id, {HOST_SQL} AS host FROM pages),
  sites AS (SELECT DISTINCT regexp_replace(host, '^www\\.', '') AS root FROM h WHERE host LIKE '%.example.org'),
  ranked AS (
    SELECT root, page_id, row_number() OVER (PARTITION BY root ORDER BY page_id) AS place
    FROM h JOIN sites ON host = root OR ends_with(host, '.' || root))
  SELECT root AS company, page_id, place FROM ranked WHERE place <= 2
"""
)
def official_pages(spark, sf):
    """Companies with a site under one domain get the first two pages found on that site."""
    pages = table(spark, sf, "pages")
    host = urls.host_of("url")
    companies = (
        pages.select(F.regexp_replace(host, r"^www\.", "").alias("company"))
        .where(F.col("company").endswith(".example.org"))
        .distinct()
        .withColumn("website", F.concat(F.lit("https://www."), "company", F.lit("/")))
    )
    return trust.official_pages(pages, companies, order_by="page_id").select(
        "company", "page_id", F.col("place").cast("bigint").alias("place")
    )
