"""Joins of pages with company sites and with tables of trusted domains."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gleanery.functions import urls


def site_pages(pages: DataFrame, companies: DataFrame, url: str = "url") -> DataFrame:
    """Pages joined with the companies whose site they belong to.

    Subdomain membership becomes an equality: every dot-suffix of the page host is a join key,
    so the company table may have any size and Spark picks the join.
    """
    keyed = companies.withColumn("site_key", urls.site_root("website"))
    spread = pages.withColumn("site_key", F.explode(urls.host_suffixes(urls.host_of(url))))
    return spread.join(keyed, "site_key").drop("site_key")


def official_pages(
    pages: DataFrame, companies: DataFrame, order_by: str | Column, limit: int = 2, url: str = "url"
) -> DataFrame:
    """The first ``limit`` pages of every company site."""
    window = Window.partitionBy("company").orderBy(order_by)
    joined = site_pages(pages, companies, url)
    return joined.withColumn("place", F.row_number().over(window)).where(F.col("place") <= limit)


TIERS = ("primary", "authoritative", "professional")


def domain_table(spark: SparkSession, policy: urls.TrustPolicy) -> DataFrame:
    """The domains of a policy as a table (domain, tier, ordinal), in list order."""
    lists = (policy.primary_domains(), policy.authoritative, policy.professional)
    rows = [(domain, tier) for tier, domains in zip(TIERS, lists) for domain in domains]
    return spark.createDataFrame([(domain, tier, n) for n, (domain, tier) in enumerate(rows)], "domain string, tier string, ordinal bigint")


def with_tiers(df: DataFrame, domains: DataFrame, url: str = "url") -> DataFrame:
    """Adds ``tier`` and ``publisher`` by a domain table of any size (domain, tier, ordinal).

    Every distinct host meets the table once, by equality of its dot-suffixes; the best tier and the first listed domain win.  Spark
    broadcasts the table if its size allows.
    """
    names = [c for c in df.columns if c not in ("tier", "publisher")]
    keyed = df.select(*names, urls.host_of(url).alias("_host"), urls.trustable_host(url).isNotNull().alias("_trustable"))
    listed = domains.select(F.lower("domain").alias("domain"), F.array_position(F.array(*[F.lit(t) for t in TIERS]), F.col("tier")).alias("rank"), "tier", "ordinal")
    hosts = keyed.select("_host").distinct().select("_host", F.explode(urls.host_suffixes(F.col("_host"))).alias("domain"))
    found = hosts.join(listed, "domain").groupBy("_host").agg(F.min_by("tier", "rank").alias("tier"), F.min_by("domain", "ordinal").alias("publisher"))
    joined = keyed.join(found, "_host", "left")
    tier = F.when(F.col("_trustable"), F.coalesce("tier", F.lit("untrusted"))).otherwise("untrusted")
    return joined.select(*names, tier.alias("tier"), F.coalesce("publisher", F.lit("")).alias("publisher"))
