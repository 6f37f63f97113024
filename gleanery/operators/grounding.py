"""Grounding of extracted records in the pages they cite."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleanery.functions import records, text, urls, vocab
from gleanery.functions.binding import bind
from gleanery.operators import evidence
from gleanery.session import stored

MIN_EXCERPT = 12


def spread_citations(extracted: DataFrame, batch: str = "batch_id") -> DataFrame:
    """(batch, record_no, citation_no, doc_no, quote) of every citation."""
    rows = extracted.select(batch, "record_no", F.posexplode("citations").alias("citation_no", "c"))
    return rows.select(batch, "record_no", "citation_no", F.col("c.document").alias("doc_no"), F.col("c.quote").alias("quote"))


def ground_citations(citations: DataFrame, documents: DataFrame, batch: str = "batch_id") -> DataFrame:
    """Citations joined with their page; ``grounded`` tells whether the page holds the quote."""
    pages = documents.withColumn("_body", text.fold_key("text"))
    quotes = citations.withColumn("_quote", text.fold_key("quote"))
    joined = quotes.join(pages, [batch, "doc_no"])
    return joined.withColumn("grounded", F.contains("_body", F.col("_quote"))).drop("_body", "_quote")


def page_dates(documents: DataFrame, as_of: Column, batch: str = "batch_id") -> DataFrame:
    """Earliest date of each page that is not in the future."""
    dated = documents.where(F.col("published_at") <= as_of)
    return dated.groupBy(batch, "url").agg(F.min("published_at").alias("page_date"))


def _repair(kept: Column, tokens: Column, excerpts: Column) -> Column:
    """Add, token by token, the first excerpt for a number that no kept quote contains yet."""
    def step(state: Column, token: Column) -> Column:
        quoted = text.fold_key(F.array_join(F.transform(state, lambda d: d["entry"]["quote"]), " "))
        fitting = F.filter(excerpts, lambda x: x["token"] == token)
        addition = F.slice(F.transform(fitting, lambda x: x["d"]), 1, 1)
        return F.when(F.contains(quoted, token) | (F.size(fitting) == 0), state).otherwise(
            evidence.dedupe(F.concat(state, addition))
        )

    return F.aggregate(tokens, kept, step)


def ground_items(
    extracted: DataFrame, documents: DataFrame, policy: urls.TrustPolicy, run_id: Column, as_of: Column,
    batch: str = "batch_id",
) -> DataFrame:
    """Extracted records with verified evidence, numbers repaired from the cited pages, dates bound.

    Company-profile pages never support an event.  A record without a grounded citation is dropped.
    """
    events = documents.where(F.col("profile_company").isNull())
    claims = extracted.withColumn(
        "_tokens", F.array_distinct(text.number_tokens(F.concat_ws(" ", "title", "summary")))
    )
    cited = ground_citations(spread_citations(extracted, batch), events.select(batch, "doc_no", "url", "title", "text"), batch)
    tokens = claims.select(batch, "record_no", "_tokens")
    found = cited.join(tokens, [batch, "record_no"])
    excerpts = F.filter(
        F.transform("_tokens", lambda t: F.struct(t.alias("token"), text.token_excerpt(F.col("text"), t).alias("quote"))),
        lambda x: F.length(x["quote"]) >= MIN_EXCERPT,
    )
    slim = bind(found, _x=excerpts).select(
        batch, "record_no", "citation_no", "grounded",
        F.struct("url", "title", "quote").alias("entry"), "_x", "url", "title",
    )
    # One array per record: grounded quotes first, then candidate excerpts, both in citation order.
    rows = slim.select(
        batch, "record_no",
        F.explode(F.concat(
            F.when(F.col("grounded"), F.array(F.struct(F.lit(0).alias("kind"), "citation_no", F.lit("").alias("token"), F.col("entry"))))
            .otherwise(F.array()),
            F.transform("_x", lambda x: F.struct(
                F.lit(1).alias("kind"), F.col("citation_no"), x["token"].alias("token"),
                F.struct(F.col("url"), F.col("title"), x["quote"].alias("quote")).alias("entry"))),
        )).alias("r"),
    )
    gathered = rows.groupBy(batch, "record_no").agg(F.array_sort(F.collect_list("r")).alias("_r"))
    gathered = gathered.withColumn("evidence", F.transform("_r", lambda r: r["entry"]))
    described = evidence.detail(gathered, policy)
    paired = F.zip_with("_r", "details", lambda r, d: F.struct(r["kind"].alias("kind"), r["token"].alias("token"), d.alias("d")))
    split = bind(
        bind(described, _z=paired),
        _base=evidence.dedupe(F.transform(F.filter("_z", lambda z: z["kind"] == 0), lambda z: z["d"])),
        _more=F.filter("_z", lambda z: z["kind"] == 1),
    ).where(F.size("_base") > 0)
    repaired = bind(split.join(tokens, [batch, "record_no"]), details=_repair(F.col("_base"), F.col("_tokens"), F.col("_more")))
    # Read twice below, and costly: every text is searched for it.
    grounded = stored(repaired.select(batch, "record_no", evidence.entries("details").alias("evidence")), "grounded")
    pages = grounded.select(batch, "record_no", F.explode("evidence").alias("e")).select(batch, "record_no", F.col("e.url").alias("url"))
    dates = (
        pages.distinct().join(page_dates(events, as_of, batch), [batch, "url"])
        .groupBy(batch, "record_no").agg(F.min("page_date").alias("published_at"))
    )
    key = text.event_key("company", "event_key")
    complete = (
        claims.drop("_tokens", "citations")
        .join(grounded, [batch, "record_no"])
        .join(dates, [batch, "record_no"], "left")
        .withColumn("event_key", key)
        .withColumn("id", F.col("event_key"))
        .withColumn("run_id", run_id)
        .withColumn("first_seen_run_id", F.lit(None).cast("string"))
        .withColumn("observed_at", as_of)
        .withColumn("effective_at", F.lit(None).cast("timestamp"))
    )
    return records.normalise_dates(complete, as_of)


def ground_profiles(
    extracted: DataFrame, documents: DataFrame, policy: urls.TrustPolicy, as_of: Column, batch: str = "batch_id"
) -> DataFrame:
    """Profiles whose citations come from a page fetched for the same company.

    Funding is kept only when a cited page states it word for word.
    """
    owned = documents.where(F.col("profile_company").isNotNull()).withColumn("_owner", text.identity_text("profile_company"))
    named = extracted.withColumn("_name_key", text.identity_text("name"))
    cited = ground_citations(
        spread_citations(extracted, batch), owned.select(batch, "doc_no", "url", "title", "text", "_owner"), batch
    )
    own = cited.join(named.select(batch, "record_no", "_name_key"), [batch, "record_no"]).where(
        F.col("grounded") & (F.col("_owner") == F.col("_name_key"))
    )
    gathered = own.groupBy(batch, "record_no").agg(
        F.array_sort(F.collect_list(F.struct("citation_no", F.struct("url", "title", "quote").alias("entry")))).alias("_r")
    ).withColumn("evidence", F.transform("_r", lambda r: r["entry"])).drop("_r")
    reduced = evidence.with_deduped(gathered, policy).drop("details")
    filled = lambda c: F.exists(c, lambda v: text.strip_space(v) != "")
    complete = named.where(
        (text.strip_space("narrative") != "") & (text.strip_space("positioning") != "")
        & filled("solutions") & filled("capabilities")
    ).join(reduced, [batch, "record_no"])
    pages = complete.where(F.col("funding") != "").select(batch, "record_no", "funding", F.explode("evidence").alias("e")).select(
        batch, "record_no", text.fold_key("funding").alias("_f"), F.col("e.url").alias("url")
    ).distinct()
    stated = pages.join(documents.select(batch, "url", text.fold_key("text").alias("_body")), [batch, "url"]).where(
        F.contains("_body", F.col("_f"))
    ).select(batch, "record_no").distinct().withColumn("_stated", F.lit(True))
    return (
        complete.join(stated, [batch, "record_no"], "left")
        .withColumn("funding", F.when(F.col("_stated"), F.col("funding")).otherwise(F.lit(vocab.UNDISCLOSED)))
        .withColumn("id", F.concat(F.lit("company-"), text.short_hash(text.fold_key("name"))))
        .withColumn("basis", F.lit("official"))
        .withColumn("updated_at", as_of)
        .drop("citations", "_name_key", "_stated")
    )
