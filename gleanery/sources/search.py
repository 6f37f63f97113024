"""Search responses to candidates, rejection reasons and accepted documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleanery.functions import urls, vocab
from gleanery.functions.binding import bind
from gleanery.functions.records import parse_date
from gleanery.functions.text import collapse_space, identity_text, strip_space
from gleanery.operators.ledger import first_failure
from gleanery.operators.selection import best_candidates
from gleanery.sources.pages import is_restricted, limited
from gleanery.sources.settings import official_website

REASONS = ["invalid", "untrusted", "domain_mismatch", "company_mismatch"]


def _string(value: Column, path: str) -> Column:
    """Text of a JSON field, NULL when the field is anything but a string."""
    field = F.try_variant_get(value, path, "variant")
    return F.when(F.schema_of_variant(field) == "STRING", F.try_variant_get(value, path, "string"))


def parse_results(payloads: DataFrame, body: str = "body", text_length: int | None = None) -> DataFrame:
    """One row per search result; every field is typed defensively."""
    results = F.try_variant_get(F.try_parse_json(F.col(body)), "$.results", "array<variant>")
    others = [c for c in payloads.columns if c != body]
    rows = payloads.select(*others, F.posexplode(results).alias("result_no", "_r"))
    score = F.try_variant_get("_r", "$.score", "variant")
    numeric = F.schema_of_variant(score).rlike("^(BIGINT|DOUBLE|FLOAT|DECIMAL)")
    typed = bind(
        rows,
        raw_url=_string(F.col("_r"), "$.url"),
        title=strip_space(_string(F.col("_r"), "$.title")),
        snippet=strip_space(_string(F.col("_r"), "$.content")),
        raw_content=limited(collapse_space(_string(F.col("_r"), "$.raw_content")), text_length),
        published_at=parse_date(_string(F.col("_r"), "$.published_date")),
        score=F.when(numeric, F.try_variant_get("_r", "$.score", "double")),
    )
    return typed.drop("_r")


def _with_company_keys(df: DataFrame, websites: dict[str, str] | None, **texts: Column) -> DataFrame:
    """Adds the focus key, the host, the root of the company's site and the key of each text.

    Rows without a focus company send no text through the Python normaliser.
    """
    focus = F.col("focus_company")
    keyed = df.withColumn("_focus_key", identity_text(focus)).withColumn(
        "_site", official_website("focus_company", websites)
    )
    for name, text in texts.items():
        keyed = keyed.withColumn(name, identity_text(F.when(focus.isNotNull(), text)))
    return bind(keyed, _host=urls.host_of("url"), _root=urls.site_root("_site"))


def judge_results(
    results: DataFrame, policy: urls.TrustPolicy, websites: dict[str, str] | None = None
) -> DataFrame:
    """Adds the canonical ``url`` and the first ``reason`` for rejection, NULL when kept."""
    canonical = bind(results, url=urls.canonical_url("raw_url")).drop("raw_url")
    text = F.concat_ws(" ", *[F.coalesce(F.col(c), F.lit("")) for c in ("title", "snippet", "raw_content")])
    keyed = bind(_with_company_keys(canonical, websites, _text_key=text), _tier=policy.tier("url"))
    tier, host = F.col("_tier"), F.col("_host")
    trusted = F.when(F.col("source_scope") == "primary", tier == "primary").otherwise(tier != "untrusted")
    listed = F.exists("domains", lambda d: urls.host_in_site(host, F.regexp_replace(F.lower(d), r"^www\.", "")))
    filtered = (F.col("domain_mode") == "filter") & (F.size("domains") > 0)
    conditions = {
        "invalid": F.col("url").isNull(),
        "untrusted": ~trusted,
        "domain_mismatch": filtered & ~F.coalesce(listed, F.lit(False)),
        "company_mismatch": F.col("focus_company").isNotNull()
        & ~F.contains(F.col("_text_key"), F.col("_focus_key"))
        & ~urls.host_in_site(host, F.col("_root")),
    }
    judged = bind(keyed, reason=first_failure(conditions))
    return judged.drop("_focus_key", "_site", "_text_key", "_host", "_root", "_tier")


def waterfall(judged: DataFrame, *groups: str) -> DataFrame:
    """(reason, n) of all results; the counts add up to the number of results.

    Low scores are declared as a reason but never counted, so they do not appear.
    """
    reasons = judged.where(F.col("reason").isNotNull()).groupBy(*groups, "reason").agg(F.count("*").alias("n"))
    kept = judged.where(F.col("reason").isNull())
    by_url = kept.groupBy(*groups, "url").agg(F.count("*").alias("_c"))
    totals = by_url.groupBy(*groups).agg(F.count("*").alias("kept"), (F.sum("_c") - F.count("*")).alias("duplicate"))
    split = totals.unpivot(list(groups), ["kept", "duplicate"], "reason", "n")
    return reasons.unionByName(split)


def kept_candidates(judged: DataFrame, arrival: str = "arrival") -> DataFrame:
    return best_candidates(judged.where(F.col("reason").isNull()).drop("reason"), "url", arrival)


def unread(candidates: DataFrame, documents: DataFrame, url: str = "url") -> DataFrame:
    """Candidates whose page has not been read yet."""
    return candidates.join(documents.select(url), url, "left_anti")


def accepted_documents(
    candidates: DataFrame, policy: urls.TrustPolicy, websites: dict[str, str] | None = None,
    text_length: int | None = None, title_length: int | None = None,
) -> DataFrame:
    """Candidates whose search body, or on the company's own site whose snippet, is usable text."""
    ready = bind(
        candidates, _body=F.coalesce("raw_content", F.lit("")), _title=F.coalesce("title", F.lit("")),
        _snippet=collapse_space(F.coalesce("snippet", F.lit(""))),
    )
    body, snippet, title = F.col("_body"), F.col("_snippet"), F.col("_title")
    keyed = _with_company_keys(
        ready, websites, _body_key=F.concat(title, F.lit(" "), body), _snippet_key=F.concat(title, F.lit(" "), snippet)
    )
    focus, focus_key = F.col("focus_company"), F.col("_focus_key")
    own_site = urls.host_in_site(F.col("_host"), F.col("_root"))
    from_body = (
        (F.length(body) >= vocab.MIN_SEARCH_BODY)
        & policy.is_trusted("url")
        & ~is_restricted(body)
        & (focus.isNull() | own_site | F.contains(F.col("_body_key"), focus_key))
    )
    from_snippet = (
        focus.isNotNull() & own_site & (F.coalesce("score", F.lit(0.0)) >= 0.35)
        & (F.length(snippet) >= vocab.MIN_SEARCH_BODY)
        & F.contains(F.col("_snippet_key"), focus_key)
    )
    method = F.when(from_body, F.lit("search-raw-content")).when(
        F.coalesce(from_snippet, F.lit(False)), F.lit("advanced-search")
    )
    by_body = F.col("retrieval_method") == "search-raw-content"
    chosen = bind(keyed, retrieval_method=method).where(F.col("retrieval_method").isNotNull())
    short_title = F.when(title == "", F.when(by_body, F.col("coverage_key")).otherwise(focus)).otherwise(
        F.when(by_body, limited(title, title_length)).otherwise(title)
    )
    return chosen.select(
        "url", short_title.alias("title"),
        limited(F.when(by_body, body).otherwise(snippet), text_length).alias("text"),
        F.when(by_body, F.col("published_at")).alias("published_at"),
        F.concat("lane", F.lit(" · "), "coverage_key").alias("source"),
        F.lit(None).cast("string").alias("profile_company"), "focus_company", "retrieval_method", "arrival",
    )
