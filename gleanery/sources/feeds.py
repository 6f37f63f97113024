"""RSS and Atom payloads to documents."""

from __future__ import annotations

from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

from gleanery.functions import urls, vocab
from gleanery.sources.pages import limited
from gleanery.functions.binding import bind
from gleanery.functions.records import parse_date
from gleanery.functions.text import SPACE, strip_space

FIELDS = ["href", "link", "title", "date", "text"]
GROUPS = {
    "link": "link", "title": "title", "pubdate": "date", "published": "date", "updated": "date",
    "description": "text", "summary": "text", "content": "text",
}
FIRST_ONLY = ("date", "text")


class _Plain(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.parts: list[str] = []

    def handle_data(self, data):
        self.parts.append(data)


class _FeedReader(HTMLParser):
    """Lenient reader: entries anywhere in the document, fields anywhere in an entry."""

    CDATA_CONTENT_ELEMENTS = ()
    RCDATA_CONTENT_ELEMENTS = ()

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.entries: list[dict] = []
        self.entry: dict | None = None
        self.field = ""
        self.tag = ""

    def handle_starttag(self, tag, attrs):
        if tag in ("item", "entry"):
            self.entry = dict.fromkeys(FIELDS, "")
            self.entries.append(self.entry)
        elif self.entry is not None and not self.field and tag in GROUPS:
            field = GROUPS[tag]
            if field in FIRST_ONLY and field in self.entry.get("_seen", ()):
                return
            self.entry.setdefault("_seen", set()).add(field)
            self.field, self.tag = field, tag
            if field == "link" and "_first" not in self.entry:
                self.entry["_first"] = True
                self.entry["href"] = dict(attrs).get("href") or ""

    def handle_endtag(self, tag):
        if tag in ("item", "entry"):
            self.entry, self.field = None, ""
        elif tag == self.tag:
            self.field = self.tag = ""

    def handle_data(self, data):
        if self.entry is not None and self.field:
            self.entry[self.field] += data

    def unknown_decl(self, data):
        if data.startswith("CDATA["):
            self.handle_data(data[6:])


def _read(body: str | None) -> list[dict]:
    reader = _FeedReader()
    reader.feed(body or "")
    reader.close()
    out = []
    for entry in reader.entries:
        plain = _Plain()
        plain.feed(entry["text"])
        plain.close()
        out.append({**{k: entry[k] for k in FIELDS}, "text": "".join(plain.parts)})
    return out


@F.arrow_udf(ArrayType(StructType([StructField(k, StringType()) for k in FIELDS])))
def read_feed(bodies: pa.Array) -> pa.Array:
    kind = pa.list_(pa.struct([(k, pa.string()) for k in FIELDS]))
    return pa.array([_read(b) for b in bodies.to_pylist()], kind)


def parse_feeds(feeds: DataFrame, deep: bool = False, body: str = "body", text_length: int | None = None) -> DataFrame:
    """First 6 (deep) or 3 entries of every feed; entries without an acceptable link are skipped."""
    entries = feeds.withColumn("_e", F.slice(read_feed(F.col(body)), 1, 6 if deep else 3)).drop(body)
    rows = entries.select(*[c for c in entries.columns if c != "_e"], F.posexplode("_e").alias("entry_no", "_r"))
    link = F.when(F.col("_r.href") != "", F.col("_r.href")).otherwise(F.col("_r.link"))
    return (
        bind(rows, url=urls.canonical_url(strip_space(link)))
        .where(F.col("url").isNotNull())
        .withColumn("title", F.col("_r.title"))
        .withColumn("text", limited(F.regexp_replace("_r.text", f"{SPACE}+", " "), text_length))
        .withColumn("published_at", parse_date("_r.date"))
        .drop("_r")
    )
