"""Cross-event reports: lineage, validation and validity of the published text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleanery.functions import urls
from gleanery.functions.text import strip_space
from gleanery.operators.ledger import fingerprint

# Text limits of a report.
LIMITS = {
    "concept": (4, 60), "judgment": (20, 400), "reasoning": (20, 650), "implication": (10, 400), "watchpoint": (10, 300),
}
OVERVIEW, CONCLUSIONS, CITED = (20, 500), (1, 5), (2, 8)


def spread(reports: DataFrame, key: str = "run_id") -> DataFrame:
    rows = reports.select(key, F.posexplode("conclusions").alias("conclusion_no", "c"))
    return rows.select(key, "conclusion_no", "c.*")


def lineage(reports: DataFrame, items: DataFrame, key: str = "run_id") -> DataFrame:
    """Conclusion -> cited event -> evidence page; a missing event has a NULL page."""
    cited = spread(reports, key).select(
        key, "conclusion_no", F.explode(F.array_distinct("evidence_ids")).alias("id")
    )
    pages = items.select("id", F.lit(True).alias("known"), F.transform("evidence", lambda e: urls.evidence_url(e["url"])).alias("_pages"))
    joined = cited.join(pages, "id", "left")
    return joined.select(
        key, "conclusion_no", "id", F.coalesce("known", F.lit(False)).alias("known"),
        F.explode_outer("_pages").alias("page"),
    )


def support(reports: DataFrame, items: DataFrame, key: str = "run_id") -> DataFrame:
    """Distinct known events, unknown events and distinct pages behind every conclusion."""
    return lineage(reports, items, key).groupBy(key, "conclusion_no").agg(
        F.countDistinct(F.when(F.col("known"), F.col("id"))).alias("events"),
        F.countDistinct(F.when(~F.col("known"), F.col("id"))).alias("unknown"),
        F.countDistinct("page").alias("pages"),
    )


def _outside(value: Column, low: int, high: int) -> Column:
    return F.coalesce(~F.length(strip_space(value)).between(low, high), F.lit(True))


def violations(reports: DataFrame, items: DataFrame, key: str = "run_id") -> DataFrame:
    """(report, conclusion, rule) of everything that makes a report invalid."""
    whole = reports.select(
        key, F.lit(None).cast("int").alias("conclusion_no"),
        F.array_compact(F.array(
            F.when(_outside(F.col("overview"), *OVERVIEW), F.lit("overview")),
            F.when(~F.size("conclusions").between(*CONCLUSIONS), F.lit("conclusion_count")),
        )).alias("rules"),
    )
    texts = [F.when(_outside(F.col(name), *limit), F.lit(name)) for name, limit in LIMITS.items()]
    parts = spread(reports, key).select(
        key, "conclusion_no",
        F.array_compact(F.array(*texts, F.when(~F.size("evidence_ids").between(*CITED), F.lit("citation_count")))).alias("rules"),
    )
    backed = support(reports, items, key).select(
        key, "conclusion_no",
        F.array_compact(F.array(
            F.when((F.col("events") + F.col("unknown") < 2) | (F.col("unknown") > 0), F.lit("events")),
            F.when(F.col("pages") < 2, F.lit("pages")),
        )).alias("rules"),
    )
    every = whole.unionByName(parts).unionByName(backed)
    return every.select(key, "conclusion_no", F.explode("rules").alias("rule"))


def valid_reports(reports: DataFrame, items: DataFrame, key: str = "run_id") -> DataFrame:
    """Reports without a violation, stamped with the digest of the events they rest on."""
    sound = reports.join(violations(reports, items, key).select(key).distinct(), key, "left_anti")
    return sound.drop("basis").join(F.broadcast(corpus_basis(items)))


def corpus_basis(items: DataFrame) -> DataFrame:
    """One-row digest of the facts and evidence of all published events."""
    cited = F.to_json(F.transform("evidence", lambda e: F.struct(urls.evidence_url(e["url"]).alias("u"), e["quote"].alias("q"))))
    facts = ["id", "title", "summary", "implication", "category", "topic", "company", "published_at", "observed_at"]
    return fingerprint(items, *facts, cited).select("basis")


def current_reports(reports: DataFrame, items: DataFrame) -> DataFrame:
    """Reports that still rest on exactly the published events."""
    return reports.join(F.broadcast(corpus_basis(items)), "basis", "left_semi")
