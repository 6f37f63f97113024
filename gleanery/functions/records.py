"""Dates, enumerations, windows and scores of intelligence records as column expressions."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

from gleanery.functions import vocab
from gleanery.functions.binding import let
from gleanery.functions.text import SPACE, strip_space


_ISO = r"^\d{4}-\d{2}-\d{2}([T ]\d{2}:\d{2}(:\d{2}(\.\d+)?)?\s*(Z|[+-]\d{2}:?\d{2})?)?$"


def _col(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def parse_date(value: Column | str) -> Column:
    """ISO-8601 or RFC-2822 text to a timestamp, NULL when it is not a date."""
    def read(text: Column) -> Column:
        plain = F.regexp_replace(text, r"^[A-Za-z]{3,9},?\s+", "")
        zoned = F.regexp_replace(plain, r"\s+(GMT|UTC|UT|Z)$", " +0000")
        formats = ["d MMM yyyy HH:mm:ss Z", "d MMM yyyy HH:mm Z", "d MMM yyyy HH:mm:ss XXX", "d MMM yyyy"]
        feed = let(zoned, lambda z: F.coalesce(*[F.try_to_timestamp(z, F.lit(f)) for f in formats]))
        return F.when(text.rlike(_ISO), F.try_to_timestamp(text)).when(text.rlike(r"\d [A-Za-z]{3} \d{4}"), feed)

    return let(strip_space(value), read)


def effective_date(published: Column | str, effective: Column | str, observed: Column | str) -> Column:
    return F.coalesce(_col(published), _col(effective), _col(observed))


def date_basis(published: Column | str) -> Column:
    return F.when(_col(published).isNotNull(), F.lit("published")).otherwise(F.lit("observed"))


def normalise_dates(df, generated_at: Column):
    """Recompute ``effective_at``, ``observed_at`` and ``date_basis`` of an item table."""
    observed = F.coalesce(F.col("observed_at"), generated_at)
    return (
        df.withColumn("observed_at", observed)
        .withColumn("effective_at", effective_date("published_at", "effective_at", "observed_at"))
        .withColumn("date_basis", date_basis("published_at"))
    )


def in_window(date: Column | str, as_of: Column, days: int = vocab.WINDOW_DAYS) -> Column:
    """Rolling window, both ends inclusive, future dates rejected; NULL for an unknown date.

    A bare range, so a filter on a stored date reaches the scan.
    """
    return _col(date).between(as_of - F.make_dt_interval(F.lit(days)), as_of)


def in_collection_window(published: Column | str, start_day: Column) -> Column:
    date = _col(published)
    return date.isNull() | (date >= start_day.cast("timestamp"))


def lookup(value: Column, table: dict[str, str]) -> Column:
    entries = F.create_map(*[F.lit(x) for x in chain(*table.items())])
    return F.try_element_at(entries, value)


def coerce_enum(value: Column | str, allowed: list[str], aliases: dict[str, str], default: str) -> Column:
    """Exact member, else alias of the lower-cased value, else the default."""
    compact = F.regexp_replace(F.coalesce(_col(value), F.lit("")), f"{SPACE}+", "")
    return let(
        compact,
        lambda c: F.when(c.isin(allowed), c).otherwise(F.coalesce(lookup(F.lower(c), aliases), F.lit(default))),
    )


def normalise_category(value: Column | str) -> Column:
    v = _col(value)
    return F.when(v.isin(vocab.CATEGORIES), v).otherwise(
        F.coalesce(lookup(v, vocab.LEGACY_CATEGORIES), F.lit(vocab.DEFAULT_CATEGORY))
    )


def infer_category(
    supplied: Column | str, title: Column | str, summary: Column | str,
    rules: list[tuple[str, str]] | None = None, fallback: Column | None = None,
) -> Column:
    """First keyword rule that matches the claim, else the supplied value after aliasing."""
    supplied_value = fallback if fallback is not None else coerce_enum(
        supplied, vocab.CATEGORIES, vocab.CATEGORY_ALIASES, vocab.DEFAULT_CATEGORY
    )

    def match(corpus: Column) -> Column:
        result = supplied_value
        for category, pattern in reversed(vocab.CATEGORY_RULES if rules is None else rules):
            result = F.when(corpus.rlike(pattern), F.lit(category)).otherwise(result)
        return result

    return let(F.lower(F.concat(_col(title), F.lit(" "), _col(summary))), match)


def parse_confidence(value: Column | str) -> Column:
    """Share from a number or percentage text; 0.7 when unreadable, clamped to 0..1."""
    text = F.regexp_replace(strip_space(F.coalesce(_col(value).cast("string"), F.lit(""))), "%", "")
    digits = F.regexp_extract(text, r"^([+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)", 1)

    def share(raw: Column) -> Column:
        part = F.when(raw > 1, raw / 100).otherwise(raw)
        return F.when(raw.isNull(), F.lit(0.7)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), part)))

    return let(digits.try_cast("double"), share)


def split_values(value: Column | str) -> Column:
    """Delimited text to a list of non-empty trimmed parts."""
    parts = F.split(F.coalesce(_col(value), F.lit("")), "[、,，；;\n]")
    return F.filter(F.transform(parts, strip_space), lambda p: p != "")


def importance_points(importance: Column | str) -> Column:
    v = _col(importance)
    points = F.lit(0)
    for name, value in vocab.IMPORTANCE_POINTS.items():
        points = F.when(v == name, F.lit(value)).otherwise(points)
    return points


def priority_score(
    importance: Column | str, pages: Column | str, confidence: Column | str,
    effective: Column | str, as_of: Column,
) -> Column:
    """Importance + capped corroboration + confidence + freshness."""
    age = (F.unix_micros(as_of) - F.unix_micros(_col(effective))) / F.lit(86_400_000_000.0)
    age = F.coalesce(F.greatest(F.lit(0.0), age), F.lit(float(vocab.WINDOW_DAYS)))
    return (
        importance_points(importance)
        + F.least(_col(pages), F.lit(4)) * 6
        + F.floor(_col(confidence) * 20 + 0.5)
        + F.greatest(F.lit(0.0), 14 - age / 2)
    )


def is_major_signal(
    importance: Column | str, confidence: Column | str, citations: Column | str,
    pages: Column | str, best_authority: Column | str,
) -> Column:
    level, sure = _col(importance), _col(confidence)
    critical = (level == "critical") & (sure >= 0.72) & (_col(citations) >= 1)
    backed = (_col(pages) >= 2) | (_col(best_authority) >= 2)
    return critical | ((level == "high") & (sure >= 0.82) & backed)


def research_start(as_of: Column, last_finished: Column, full: bool) -> Column:
    """First day of the collection window."""
    if full:
        return F.to_date(as_of - F.make_dt_interval(F.lit(vocab.WINDOW_DAYS)))
    floor = as_of - F.make_dt_interval(F.lit(2))
    return F.to_date(F.greatest(floor, last_finished - F.make_dt_interval(F.lit(2))))
