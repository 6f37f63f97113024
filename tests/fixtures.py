"""Small item and document fixtures shared by the tests."""

from __future__ import annotations

from datetime import datetime, timezone

from gleanery import schemas


def at(value):
    return datetime.fromisoformat(value).replace(tzinfo=timezone.utc) if value else None


BASE = {
    "id": "item-1", "event_key": "event-1", "title": "工业智能平台发布", "summary": "企业披露工业智能平台及面向制造现场的应用能力。",
    "implication": "研究判断", "category": "解决方案", "topic": "工业智能", "importance": "high", "company": "测试公司",
    "published_at": "2026-09-08T10:00:00", "effective_at": None, "observed_at": "2026-09-08T10:00:00", "date_basis": None,
    "confidence": 0.8, "evidence": [], "run_id": "run-1", "first_seen_run_id": None, "arrival": 0,
}
FIELDS = list(BASE)


def item(**changes):
    row = {**BASE, **changes}
    if "event_key" in changes and "id" not in changes:
        row["id"] = changes["event_key"]
    for name in ("published_at", "effective_at", "observed_at"):
        row[name] = at(row[name])
    row["evidence"] = [
        {"url": e[0], "title": e[1], "quote": e[2]} if isinstance(e, tuple) else e for e in row["evidence"]
    ]
    return tuple(row[f] for f in FIELDS)


def items(spark, *rows):
    numbered = [r[:-1] + (i,) for i, r in enumerate(rows)]
    return spark.createDataFrame(numbered, schemas.ITEM)
