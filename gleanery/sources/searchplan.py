"""Search questions generated from the configuration tables of every workspace."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleanery.functions import urls, vocab
from gleanery.functions.text import identity_text

FULL, INCREMENTAL = "full", "incremental"
COLUMNS = [
    "lane", "coverage_key", "query", "topic", "focus_company", "priority", "search_depth", "source_scope", "domains", "max_results",
]


def _question(lane: str, key: Column, query: Column, topic: str | Column, depth: str | Column, scope: str | Column,
              limit: int | Column, place: list[Column], focus: Column | None = None, priority: int | None = None,
              domains: Column | None = None) -> list[Column]:
    lit = lambda v: v if isinstance(v, Column) else F.lit(v)
    none = lambda kind: F.lit(None).cast(kind)
    return [
        F.col("workspace"), lit(lane).alias("lane"), key.alias("coverage_key"), query.alias("query"), lit(topic).alias("topic"),
        (none("string") if focus is None else focus).alias("focus_company"),
        (none("int") if priority is None else F.lit(priority)).alias("priority"),
        lit(depth).alias("search_depth"), lit(scope).alias("source_scope"),
        (none("array<string>") if domains is None else domains).alias("domains"), lit(limit).alias("max_results"),
        F.array(*[p.cast("bigint") for p in place]).alias("_place"),
    ]


def _any_of(values: Column) -> Column:
    """("a" OR "b") over an array of terms."""
    return F.concat(F.lit("("), F.array_join(F.transform(values, lambda v: F.concat(F.lit('"'), v, F.lit('"'))), " OR "), F.lit(")"))


def _chunks(df: DataFrame, value: str, size: int) -> DataFrame:
    """Values of a workspace in groups of ``size`` by list position."""
    place = F.row_number().over(Window.partitionBy("workspace").orderBy("ordinal")) - 1
    numbered = df.select("workspace", value, place.alias("_n"), F.floor(place / size).alias("chunk"))
    grouped = numbered.groupBy("workspace", "chunk").agg(F.array_sort(F.collect_list(F.struct("_n", value))).alias("_v"))
    return grouped.select("workspace", "chunk", F.col(f"_v.{value}").alias("values"))


def _standing(workspaces: DataFrame, mode: str) -> DataFrame:
    fields = ["key", "query", "topic", "depth", "scope", "most"]
    rows = F.array(*[F.struct(*[F.lit(v).alias(n) for n, v in zip(fields, q)]) for q in vocab.STANDING_QUERIES])
    spread = workspaces.select("workspace", F.posexplode(rows).alias("n", "q"))
    depth = F.lit("basic") if mode == INCREMENTAL else F.col("q.depth")
    return spread.select(*_question(
        vocab.LANE_SCAN, F.col("q.key"), F.col("q.query"), F.col("q.topic"), depth, F.col("q.scope"), F.col("q.most"),
        [F.lit(0), F.col("n"), F.lit(0)],
    ))


def _topics(workspaces: DataFrame, mode: str) -> DataFrame:
    size, tail, most = (1, vocab.TAIL_TOPIC_FULL, 10) if mode == FULL else (
        3, vocab.TAIL_TOPIC, 12)
    groups = [vocab.TOPICS[i:i + size] for i in range(0, len(vocab.TOPICS), size)]
    rows = F.array(*[F.array(*[F.lit(t) for t in g]) for g in groups])
    spread = workspaces.select("workspace", F.posexplode(rows).alias("n", "g"))
    terms = F.concat(F.lit('"'), F.element_at("g", 1), F.lit('"')) if mode == FULL else _any_of(F.col("g"))
    return spread.select(*_question(
        vocab.LANE_SCAN, F.concat(F.lit("方向:"), F.array_join("g", "、")), F.concat(terms, F.lit(tail)), "general",
        "basic", "trusted", most, [F.lit(1), F.col("n"), F.lit(0)],
    ))


def _keywords(keywords: DataFrame, mode: str) -> DataFrame:
    return _chunks(keywords, "keyword", 4).select(*_question(
        vocab.LANE_KEYWORD, F.concat(F.lit("关键词:"), F.array_join("values", "、")),
        F.concat(_any_of(F.col("values")), F.lit(vocab.TAIL_KEYWORD)),
        "general" if mode == FULL else "news", "basic", "trusted", 10, [F.lit(2), F.col("chunk"), F.lit(0)],
    ))


def _companies(companies: DataFrame, mode: str) -> list[DataFrame]:
    terms = F.create_map(*[
        x for name, words in vocab.COMPANY_SEARCH_TERMS.items() for x in (F.lit(name), F.array(*[F.lit(w) for w in words]))
    ])
    key = identity_text("name")
    named = companies.withColumn("_terms", _any_of(F.coalesce(F.try_element_at(terms, key), F.array("name"))))
    builtin = F.try_element_at(F.create_map(*[F.lit(x) for pair in vocab.COMPANY_WEBSITES.items() for x in pair]), key)
    named = named.withColumn("_site", F.coalesce("website", builtin))

    def ask(frame: DataFrame, label: str, tail: str, topic: str, priority: int, depth: str, scope: str, most: int, step: int,
            site: Column | None = None) -> DataFrame:
        query = F.concat(F.col("_terms"), F.lit(tail))
        if site is not None:
            query = F.concat(F.lit("site:"), site, F.lit(" "), query)
        return frame.select(*_question(
            vocab.LANE_COMPANY, F.concat(F.lit(label), "name"), query, topic, depth, scope, most,
            [F.lit(3), F.col("ordinal"), F.lit(step)], F.col("name"), priority, None if site is None else F.array(site),
        ))

    if mode == INCREMENTAL:
        tail = vocab.TAIL_COMPANY
        return [ask(named, "企业:", tail, "general", 5, "basic", "trusted", 12, 0)]
    news = vocab.TAIL_COMPANY_NEWS
    capital = vocab.TAIL_COMPANY_CAPITAL
    own = vocab.TAIL_COMPANY_SITE
    sited = named.where(F.col("_site").isNotNull())
    return [
        ask(named, "企业:", news, "news", 3, "basic", "trusted", 10, 0),
        ask(named, "企业资本与战略:", capital, "news", 4, "basic", "trusted", 8, 1),
        ask(sited, "企业官网动态:", own, "general", 5, "advanced", "primary", 10, 2, urls.site_root("_site")),
    ]


def _sites(sources: DataFrame, policy: urls.TrustPolicy) -> DataFrame:
    usable = sources.where(F.col("enabled") & urls.is_public_url("url")).withColumn("_host", urls.host_of("url"))
    hosts = usable.groupBy("workspace", "_host").agg(F.min("ordinal").alias("_first"))
    trusted = hosts.where(policy.is_trusted(F.concat(F.lit("https://"), "_host")))
    query = F.concat(F.lit("site:"), "_host", F.lit(vocab.TAIL_SITE))
    return trusted.select(*_question(
        vocab.LANE_SITE, F.concat(F.lit("网站:"), "_host"), query, "general", "basic", "trusted", 10,
        [F.lit(4), F.col("_first"), F.lit(0)], domains=F.array("_host"),
    ))


def _extras(extras: DataFrame, mode: str) -> DataFrame:
    place = F.row_number().over(Window.partitionBy("workspace").orderBy("ordinal"))
    rows = extras.withColumn("_n", place)
    depth = F.col("search_depth")
    if mode == INCREMENTAL:
        rows, depth = rows.where("_n <= 2"), F.lit("basic")
    return rows.select(*_question(
        vocab.LANE_GAP, F.col("coverage_key"), F.col("query"), F.col("topic"), depth, F.lit(None).cast("string"),
        F.lit(None).cast("int"), [F.lit(5), F.col("_n"), F.lit(0)],
    ))


def build_plan(
    workspaces: DataFrame, keywords: DataFrame, companies: DataFrame, sources: DataFrame,
    policy: urls.TrustPolicy, mode: str = INCREMENTAL, extras: DataFrame | None = None, limit: int = vocab.PLAN_LIMIT,
) -> DataFrame:
    """Deduplicated plan of every workspace, ``place`` gives the asking order.

    A repeated question keeps the place of its first and the settings of its last occurrence.
    """
    sections = [_standing(workspaces, mode), _topics(workspaces, mode), _keywords(keywords, mode), *_companies(companies, mode),
                _sites(sources, policy)]
    if extras is not None:
        sections.append(_extras(extras, mode))
    plan = sections[0]
    for section in sections[1:]:
        plan = plan.unionByName(section)
    usable = plan.where(F.length(F.trim("query")) >= 5).withColumn("_key", F.lower(F.trim("query")))
    merged = usable.groupBy("workspace", "_key").agg(
        F.max_by(F.struct(*COLUMNS), "_place").alias("_q"), F.min("_place").alias("_first")
    )
    place = F.row_number().over(Window.partitionBy("workspace").orderBy("_first"))
    return merged.withColumn("place", place).where(F.col("place") <= limit).select("workspace", "place", "_q.*")


def supplement_plan(questions: DataFrame, mode: str) -> DataFrame:
    """Gap questions only: repeated ones once, at most 3 (incremental) or 12, always advanced."""
    keyed = questions.withColumn("_key", F.lower("query"))
    others = [c for c in questions.columns]
    merged = keyed.groupBy("_key").agg(F.max_by(F.struct(*others), "ordinal").alias("_q"), F.min("ordinal").alias("_first"))
    chosen = merged.orderBy("_first").limit(3 if mode == INCREMENTAL else 12)
    return chosen.select("_q.*").withColumn("search_depth", F.lit("advanced"))
