"""Company profiles: upsert, placeholders, dashboard order and refresh targets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleanery.functions import text, urls, vocab
from gleanery.operators import evidence
from gleanery.session import cut_lineage
from gleanery.sources.settings import official_website

FIELDS = [
    "id", "name", "narrative", "positioning", "solutions", "capabilities", "funding", "implication", "evidence",
    "updated_at", "basis", "arrival",
]
REFRESH_DAYS = 7


def _accepted(rows: DataFrame) -> DataFrame:
    """Versions of a company that take part in its profile.

    Once a version has evidence, versions without any are refused.  The first acceptable official
    version replaces everything before it, and after it only official versions count.
    """
    cited = F.size("details") > 0
    official = F.col("basis").eqNullSafe("official")
    first_cited = rows.groupBy("_key").agg(F.min(F.when(cited, F.col("_at"))).alias("_cited"))
    dated = rows.join(first_cited, "_key")
    promotes = official & (cited | F.col("_cited").isNull() | (F.col("_at") < F.col("_cited")))
    promoted = dated.groupBy("_key").agg(F.min(F.when(promotes, F.col("_at"))).alias("_official"))
    eligible = dated.drop("_cited").join(promoted, "_key").where(
        F.col("_official").isNull() | (official & (F.col("_at") >= F.col("_official")))
    )
    counted = eligible.groupBy("_key").agg(F.min(F.when(cited, F.col("_at"))).alias("_cited"))
    return eligible.join(counted, "_key").where(cited | F.col("_cited").isNull() | (F.col("_at") < F.col("_cited")))


def _ordered_union(rows: DataFrame, column: str) -> DataFrame:
    """Distinct list values of a company in the order they were first named."""
    values = rows.select("_key", "_at", F.posexplode(column).alias("_n", "_v"))
    firsts = values.groupBy("_key", "_v").agg(F.min(F.struct("_at", "_n")).alias("_o"))
    listed = firsts.groupBy("_key").agg(F.array_sort(F.collect_list(F.struct("_o", "_v"))).alias("_l"))
    return listed.select("_key", F.transform("_l", lambda x: x["_v"]).alias(column))


def merge_profiles(existing: DataFrame | None, incoming: DataFrame, policy: urls.TrustPolicy) -> DataFrame:
    """Profiles by company identity: later versions refine, never erase, what is known.

    Existing rows come before incoming ones, each ordered by ``arrival``.  Every field of the
    result is an aggregate over the accepted versions, so a company may have any number of them.
    """
    fresh = incoming.select(*FIELDS, F.lit(1).alias("_side"))
    rows = fresh if existing is None else existing.select(*FIELDS, F.lit(0).alias("_side")).unionByName(fresh)
    described = evidence.detail(rows, policy).withColumn("_key", text.identity_text("name"))
    versions = cut_lineage(described.withColumn("_at", F.struct("_side", "arrival")).drop("_side"))
    positions = versions.groupBy("_key").agg(F.min_by("arrival", "_at").alias("arrival"))
    kept = cut_lineage(_accepted(versions))

    def last_stated(name: str, empty: str) -> Column:
        value = F.coalesce(F.col(name), F.lit(""))
        return F.coalesce(F.max_by(name, F.when(value != empty, F.col("_at"))), F.max_by(name, "_at")).alias(name)

    latest = ["id", "name", "implication", "updated_at", "basis"]
    merged = kept.groupBy("_key").agg(
        F.max_by(F.struct(*latest), "_at").alias("_l"),
        last_stated("narrative", ""), last_stated("positioning", ""), last_stated("funding", vocab.UNDISCLOSED),
        F.count("*").alias("_n"), F.max_by("evidence", "_at").alias("_own"),
    )
    cited = evidence.union(kept, "_key").select("_key", evidence.entries("details").alias("evidence"))
    joined = merged.join(positions, "_key").join(cited, "_key", "left")
    none = F.array().cast("array<string>")
    for column in ("solutions", "capabilities"):
        joined = joined.join(_ordered_union(kept, column), "_key", "left").withColumn(column, F.coalesce(column, none))
    proof = F.when(F.col("_n") == 1, F.col("_own")).otherwise(F.coalesce("evidence", F.slice("_own", 1, 0)))
    return joined.withColumn("evidence", proof).select(
        *[F.col(f"_l.{c}").alias(c) if c in latest else F.col(c) for c in FIELDS]
    )


def configured_profiles(companies: DataFrame, profiles: DataFrame, now: Column, stored: bool = False) -> DataFrame:
    """Every configured company with its profile or a placeholder, then the other profiles.

    ``position`` is the display order: configured order first; with ``stored`` the others follow by
    last update, newest first, else by arrival.
    """
    mine = companies.select(F.col("name").alias("_wanted"), "ordinal", text.identity_text("name").alias("_key"))
    have = profiles.withColumn("_key", text.identity_text("name"))
    joined = mine.join(have, "_key", "full_outer")
    held = F.col("name").isNotNull()
    filler = {
        "id": F.concat(F.lit("configured-"), text.short_hash(text.fold_key("_wanted"))),
        "name": F.col("_wanted"),
        "narrative": F.lit(vocab.PLACEHOLDER_NARRATIVE),
        "positioning": F.lit(vocab.PLACEHOLDER_POSITIONING),
        "solutions": F.array().cast("array<string>"), "capabilities": F.array().cast("array<string>"),
        "funding": F.lit(vocab.UNDISCLOSED),
        "implication": F.lit(vocab.PLACEHOLDER_IMPLICATION),
        "evidence": F.array().cast(dict(profiles.dtypes)["evidence"]),
        "updated_at": now, "basis": F.lit(None).cast("string"), "arrival": F.lit(None).cast("bigint"),
    }
    rest = -F.unix_micros("updated_at") if stored else F.col("arrival")
    return joined.select(
        *[F.when(held, F.col(c)).otherwise(filler[c]).alias(c) for c in FIELDS],
        F.struct(F.col("ordinal").isNull().alias("late"), F.coalesce(F.col("ordinal").cast("bigint"), rest).alias("n")).alias("position"),
        (~held).alias("placeholder"),
    )


def dashboard_profiles(companies: DataFrame, profiles: DataFrame, policy: urls.TrustPolicy, now: Column) -> DataFrame:
    valid = merge_profiles(None, profiles.where(F.size("evidence") > 0), policy)
    return configured_profiles(companies, valid, now).orderBy("position")


def refresh_targets(
    companies: DataFrame, profiles: DataFrame, now: Column, full: bool, websites: dict[str, str] | None = None
) -> DataFrame:
    """Configured companies whose profile has to be researched again."""
    if full:
        return companies
    have = profiles.select(
        text.identity_text("name").alias("_key"), F.lit(True).alias("_held"), "basis", "narrative", "positioning",
        "solutions", "capabilities", "evidence", "updated_at",
    )
    site = official_website("name", websites)
    if "website" in companies.columns:
        site = F.coalesce("website", site)
    mine = companies.withColumn("_key", text.identity_text("name")).withColumn("_site", site)
    joined = mine.join(have, "_key", "left")
    on_site = F.exists("evidence", lambda e: urls.belongs_to_site(e["url"], F.col("_site")))
    age = F.unix_micros(now) - F.unix_micros("updated_at")
    fresh = (
        F.col("_held") & (F.col("basis") == "official") & (F.col("narrative") != "") & (F.col("positioning") != "")
        & (F.size("solutions") > 0) & (F.size("capabilities") > 0) & on_site
        & (age >= 0) & (age < REFRESH_DAYS * 86_400_000_000)
    )
    return joined.where(~F.coalesce(fresh, F.lit(False))).select(*[f"`{c}`" for c in companies.columns])
