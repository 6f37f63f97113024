"""Target configuration: constraint check, company sites and the read-time clean-up of old rows.

Configuration tables carry a ``workspace`` column, so many configurations are checked at once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleanery.functions import records, urls, vocab
from gleanery.functions.text import identity_text, strip_space

# Largest list sizes and text lengths of a configuration.
MAX_COUNT = {"keyword": 50, "company": 30, "source": 30}
MAX_NAME, MAX_URL = 100, 2000


def _bad_name(value: Column) -> Column:
    size = F.length(strip_space(value))
    return value.isNull() | ~size.between(1, MAX_NAME)


def _bad_url(value: Column) -> Column:
    return value.isNull() | ~value.rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*:\S+$") | (F.length(value) > MAX_URL)


def _rules(df: DataFrame, prefix: str, rules: dict[str, Column]) -> DataFrame:
    """Violations of row rules plus the size rule of one configuration list, in one pass."""
    counts = [F.count_if(condition).alias(f"{prefix}_{name}") for name, condition in rules.items()]
    over = F.greatest(F.count("*") - MAX_COUNT[prefix], F.lit(0)).alias(f"{prefix}_too_many")
    wide = df.groupBy("workspace").agg(*counts, over)
    names = [c for c in wide.columns if c != "workspace"]
    return wide.unpivot("workspace", names, "rule", "n").where("n > 0")


def violations(keywords: DataFrame, companies: DataFrame, sources: DataFrame) -> DataFrame:
    """(workspace, rule, n) for every broken rule; empty for a valid configuration.  Ids of sources are checked where given."""
    named = {"id": F.coalesce(F.length("id") > MAX_NAME, F.lit(True))} if "id" in sources.columns else {}
    return (
        _rules(keywords, "keyword", {"name": _bad_name(F.col("keyword"))})
        .unionByName(
            _rules(companies, "company", {
                "name": _bad_name(F.col("name")),
                "website": F.col("website").isNotNull() & _bad_url(F.col("website")),
            })
        )
        .unionByName(
            _rules(sources, "source", {
                **named, "name": _bad_name(F.col("name")), "url": _bad_url(F.col("url")),
                "kind": ~F.coalesce(F.col("kind").isin(vocab.SOURCE_KINDS), F.lit(False)),
                "enabled": F.col("enabled").isNull(),
            })
        )
    )


def model_violations(configurations: DataFrame, models: DataFrame, offered: DataFrame) -> DataFrame:
    """(workspace, rule, n) for broken rules of revision, provider and model names.

    ``configurations`` (workspace, revision, selected_provider), ``models`` (workspace, provider, model) and the ``offered`` models
    (provider, model).  A workspace needs one offered model for every offered provider.
    """
    providers = offered.select("provider").distinct()
    known = providers.select(F.col("provider").alias("selected_provider"), F.lit(True).alias("_known"))
    heads = configurations.join(known, "selected_provider", "left")
    heads = heads.groupBy("workspace").agg(
        F.count_if(F.coalesce(F.col("revision") < 0, F.lit(True))).alias("revision"), F.count_if(F.col("_known").isNull()).alias("selected_provider"))
    listed = offered.select("provider", "model").distinct().withColumn("_listed", F.lit(True))
    named = models.join(listed, ["provider", "model"], "left").join(providers.withColumn("_asked", F.lit(True)), "provider", "left")
    named = named.groupBy("workspace").agg(
        F.count_if(F.coalesce(~F.length("model").between(1, MAX_NAME), F.lit(True))).alias("model_name"),
        F.count_if(F.col("_asked") & F.col("_listed").isNull()).alias("model_unlisted"), F.countDistinct(F.when(F.col("_asked"), F.col("provider"))).alias("_named"))
    asked = providers.agg(F.count("*").alias("_all"))
    missing = configurations.select("workspace").distinct().join(named.select("workspace", "_named"), "workspace", "left").join(F.broadcast(asked)).select(
        "workspace", (F.col("_all") - F.coalesce("_named", F.lit(0))).alias("model_missing"))
    wide = heads.join(missing, "workspace").join(named.drop("_named"), "workspace", "left")
    return wide.unpivot("workspace", [c for c in wide.columns if c != "workspace"], "rule", "n").where("n > 0")


def official_website(name: Column | str, websites: dict[str, str] | None = None) -> Column:
    """Configured site of a company by exact name, else the built-in one by identity key."""
    company = F.col(name) if isinstance(name, str) else name
    builtin = records.lookup(identity_text(company), vocab.COMPANY_WEBSITES)
    if not websites:
        return builtin
    if len(websites) > MAX_COUNT["company"]:
        raise ValueError("a configuration holds at most 30 companies")
    return F.coalesce(records.lookup(company, websites), builtin)


def clean_items(items: DataFrame, runs: DataFrame, now: Column) -> DataFrame:
    """Drop demonstration rows, map old categories, re-date rows without an observation time."""
    started = runs.select(F.col("id").alias("run_id"), F.col("started_at").alias("_started"))
    kept = items.where(~F.coalesce(F.col("demo"), F.lit(False))).join(started, "run_id", "left")
    mapped = kept.withColumn("category", records.normalise_category("category"))
    return records.normalise_dates(mapped, F.coalesce("_started", now)).drop("_started", "demo")


def clean_sources(sources: DataFrame) -> DataFrame:
    return sources.where(F.col("kind") != "wechat")


def with_required_companies(companies: DataFrame, required: list[str] = vocab.REQUIRED_COMPANIES) -> DataFrame:
    """Appends required companies that no configured name stands for, after the configured ones."""
    last = companies.groupBy("workspace").agg(F.max("ordinal").alias("_last"))
    names = F.array(*[F.lit(r) for r in required])
    wanted = last.select("workspace", "_last", F.posexplode(names).alias("_n", "name"))
    keyed = wanted.withColumn("_key", identity_text("name"))
    present = companies.select("workspace", identity_text("name").alias("_key"))
    missing = keyed.join(present, ["workspace", "_key"], "left_anti")
    place = F.row_number().over(Window.partitionBy("workspace").orderBy("_n"))
    added = missing.select("workspace", "name", (F.col("_last") + place).cast("int").alias("ordinal"))
    return companies.unionByName(added, allowMissingColumns=True)
