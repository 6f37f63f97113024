"""Extraction JSON with alternative field names to event and profile records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleanery.functions import records, vocab
from gleanery.functions.binding import bind, let
from gleanery.functions.text import strip_space

MAX_ITEMS, MAX_PROFILES = 30, 15


def _pick(record: Column, names: list[str]) -> Column:
    """First name that is present, even when its value is JSON null."""
    return F.coalesce(*[F.try_variant_get(record, f"$.{n}", "variant") for n in names])


def _text(value: Column) -> Column:
    return strip_space(F.coalesce(F.try_variant_get(value, "$", "string"), F.lit("")))


def _list(value: Column) -> Column:
    return F.try_variant_get(value, "$", "array<variant>")


def _values(value: Column) -> Column:
    items = F.filter(F.transform(_list(value), _text), lambda t: t != "")
    return F.coalesce(items, records.split_values(_text(value)))


def _citations(value: Column) -> Column:
    return F.transform(
        F.coalesce(_list(value), F.array().cast("array<variant>")),
        lambda c: F.struct(
            F.regexp_extract(_text(_pick(c, vocab.CITATION_DOCUMENT)), r"^([+-]?\d+)", 1)
            .try_cast("int").alias("document"),
            _text(_pick(c, vocab.CITATION_QUOTE)).alias("quote"),
        ),
    )


def _item(record: Column) -> Column:
    field = {k: _pick(record, names) for k, names in vocab.ITEM_FIELDS.items()}
    title, summary = _text(field["title"]), _text(field["summary"])
    company = _text(field["company"])
    return F.struct(
        title.alias("title"),
        summary.alias("summary"),
        _text(field["implication"]).alias("implication"),
        records.infer_category(_text(field["category"]), title, summary).alias("category"),
        records.coerce_enum(
            _text(field["topic"]), vocab.TOPICS, vocab.TOPIC_ALIASES, vocab.DEFAULT_TOPIC
        ).alias("topic"),
        records.coerce_enum(
            _text(field["importance"]), vocab.IMPORTANCE, vocab.IMPORTANCE_ALIASES, "normal"
        ).alias("importance"),
        let(company, lambda c: F.when(c == "", F.lit(vocab.INDUSTRY)).otherwise(c)).alias("company"),
        _text(field["event_key"]).alias("event_key"),
        records.parse_confidence(_text(field["confidence"])).alias("confidence"),
        _citations(field["evidence"]).alias("citations"),
    )


def _profile(record: Column) -> Column:
    field = {k: _pick(record, names) for k, names in vocab.PROFILE_FIELDS.items()}
    funding = _text(field["funding"])
    return F.struct(
        *[_text(field[k]).alias(k) for k in ("name", "narrative", "positioning")],
        *[_values(field[k]).alias(k) for k in ("solutions", "capabilities")],
        let(funding, lambda f: F.when(f == "", F.lit(vocab.UNDISCLOSED)).otherwise(f)).alias("funding"),
        _text(field["implication"]).alias("implication"),
        _citations(field["evidence"]).alias("citations"),
    )


def _sized(value: Column, low: int, high: int) -> Column:
    return F.length(value).between(low, high)


def valid_citations(citations: Column) -> Column:
    return F.size(citations).between(1, 5) & F.forall(
        citations, lambda c: F.coalesce(c["document"] >= 0, F.lit(False)) & _sized(c["quote"], 12, 350)
    )


def valid_item(r: Column) -> Column:
    return (
        _sized(r["title"], 5, 200) & _sized(r["summary"], 10, 900) & _sized(r["implication"], 0, 500)
        & _sized(r["company"], 0, 100) & _sized(r["event_key"], 3, 180) & valid_citations(r["citations"])
    )


def valid_profile(r: Column) -> Column:
    def short(values: Column) -> Column:
        return (F.size(values) <= 10) & F.forall(values, lambda v: F.length(v) <= 250)

    return (
        _sized(r["name"], 1, 100) & _sized(r["narrative"], 0, 600) & _sized(r["positioning"], 0, 500)
        & short(r["solutions"]) & short(r["capabilities"]) & _sized(r["funding"], 0, 500)
        & _sized(r["implication"], 0, 500) & valid_citations(r["citations"])
    )


def normalise_extraction(payloads: DataFrame, body: str = "body") -> DataFrame:
    """One row per batch: valid ``items`` and ``profiles``, how many were offered, batch verdict.

    Everything about a batch is in its own row, so the whole step runs without a shuffle.
    """
    parsed = bind(payloads, _v=F.try_parse_json(F.col(body))).drop(body)
    none = F.array().cast("array<variant>")
    offered = bind(
        parsed,
        _items=F.coalesce(_list(_pick(F.col("_v"), vocab.ITEM_LISTS)), none),
        _profiles=F.coalesce(_list(_pick(F.col("_v"), vocab.PROFILE_LISTS)), none),
    )
    usable = bind(
        offered,
        items=F.filter(F.transform("_items", _item), valid_item),
        profiles=F.filter(F.transform("_profiles", _profile), valid_profile),
        offered_items=F.size("_items"),
        offered_profiles=F.size("_profiles"),
    )
    fits = (F.size("items") <= MAX_ITEMS) & (F.size("profiles") <= MAX_PROFILES)
    return usable.withColumn("accepted", fits).drop("_v", "_items", "_profiles")


def extracted_items(normalised: DataFrame, batch: str = "batch_id") -> DataFrame:
    rows = normalised.where("accepted").select(batch, F.posexplode("items").alias("record_no", "r"))
    return rows.select(batch, "record_no", "r.*")


def extracted_profiles(normalised: DataFrame, batch: str = "batch_id") -> DataFrame:
    rows = normalised.where("accepted").select(batch, F.posexplode("profiles").alias("record_no", "r"))
    return rows.select(batch, "record_no", "r.*")
