"""Fetched HTML pages to research documents, page states and follow-up links."""

from __future__ import annotations

import json
import re
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, StringType, StructField, StructType

from gleanery.functions import urls, vocab
from gleanery.functions.binding import bind, let
from gleanery.functions.records import parse_date
from gleanery.functions.text import collapse_space, sliced, strip_space

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
DROPPED = frozenset(vocab.DROPPED_ELEMENTS)
# An entity without its semicolon, as a page that was cut short leaves behind.
UNTERMINATED = re.compile(r"&(?=#?[0-9A-Za-z]+(?![0-9A-Za-z;]))")

PARSED = StructType(
    [
        StructField("title", StringType()),
        StructField("body", StringType()),
        StructField("stated_date", StringType()),
        StructField("data_dates", ArrayType(StringType())),
        StructField("hrefs", ArrayType(StringType())),
        StructField("notice", StringType()),
        StructField("shell", BooleanType()),
    ]
)


class _PageReader(HTMLParser):
    """One pass over a page that keeps only what a document needs."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.open: list[str] = []
        self.dropped = 0  # open elements that never contribute text
        self.main_at = 0  # stack depth of the first main container, 0 before, -1 after it closed
        self.h1_at = 0
        self.meta: dict[str, str] = {}
        self.time = ""
        self.hrefs: list[str] = []
        self.text: dict[str, list[str]] = {k: [] for k in ("title", "h1", "main", "body", "noscript")}
        self.data: list[str] = []
        self.in_data = False
        self.script_files = 0
        self.shell_root = False

    def handle_starttag(self, tag, attrs):
        at = {k: v or "" for k, v in reversed(attrs)}
        if tag == "meta":
            for key in (at.get("property"), at.get("name")):
                if key and "content" in at:
                    self.meta.setdefault(key, at["content"])
        elif tag == "time" and "datetime" in at:
            self.time = self.time or at["datetime"]
        elif tag == "a" and at.get("href"):
            self.hrefs.append(at["href"])
        elif tag == "script":
            self.script_files += "src" in at
            self.in_data = at.get("type") == "application/ld+json"
            if self.in_data:
                self.data.append("")
        self.shell_root |= at.get("id") in vocab.SHELL_IDS
        if tag in VOID:
            return
        self.open.append(tag)
        depth = len(self.open)
        self.dropped += tag in DROPPED
        if not self.h1_at and tag == "h1":
            self.h1_at = depth
        is_main = tag in ("article", "main") or at.get("id") == "js_content"
        if is_main and not self.main_at and not self.dropped:
            self.main_at = depth

    def handle_endtag(self, tag):
        if tag not in self.open:
            return
        while True:
            depth, closed = len(self.open), self.open.pop()
            self.dropped -= closed in DROPPED
            self.in_data = False
            self.main_at = -1 if self.main_at == depth else self.main_at
            self.h1_at = -1 if self.h1_at == depth else self.h1_at
            if closed == tag:
                return

    def handle_data(self, data):
        if self.in_data:
            self.data[-1] += data
        if "noscript" in self.open:
            self.text["noscript"].append(data)
        if "title" in self.open and "svg" not in self.open:
            self.text["title"].append(data)
        if self.h1_at > 0:
            self.text["h1"].append(data)
        if self.dropped or "head" in self.open or "title" in self.open:
            return
        self.text["body"].append(data)
        if self.main_at > 0:
            self.text["main"].append(data)

    def data_dates(self) -> list[str]:
        found = []
        for block in self.data:
            try:
                value = json.loads(block)
                nodes = value if isinstance(value, list) else [value, *(value.get("@graph") or [])]
                date = next((n["datePublished"] for n in nodes if n.get("datePublished")), None)
            except (ValueError, AttributeError, TypeError):
                continue
            if date:
                found.append(str(date))
        return found

    def result(self) -> dict:
        joined = {k: "".join(v) for k, v in self.text.items()}
        meta = self.meta
        return {
            "title": meta.get("og:title") or joined["h1"] or joined["title"],
            "body": joined["main"] if self.main_at else joined["body"],
            "stated_date": meta.get("article:published_time") or meta.get("date") or self.time,
            "data_dates": self.data_dates(),
            "hrefs": self.hrefs,
            "notice": joined["noscript"],
            "shell": self.script_files > 0 and self.shell_root,
        }


def _read(html: str | None) -> dict:
    reader = _PageReader()
    reader.feed(html or "")
    reader.close()
    return reader.result()


_ARROW = pa.struct(
    [
        ("title", pa.string()), ("body", pa.string()), ("stated_date", pa.string()),
        ("data_dates", pa.list_(pa.string())), ("hrefs", pa.list_(pa.string())),
        ("notice", pa.string()), ("shell", pa.bool_()),
    ]
)


@F.arrow_udf(PARSED)
def read_html(pages: pa.Array) -> pa.Array:
    return sliced(pages, _read, _ARROW)


@F.arrow_udf(PARSED)
def read_html_terminated(pages: pa.Array) -> pa.Array:
    """Only entities with their semicolon are decoded, others stay as they are written."""
    return sliced(pages, lambda html: _read(UNTERMINATED.sub("&amp;", html or "")), _ARROW)


def is_restricted(text: Column) -> Column:
    return F.substring(text, 1, 500).rlike(f"(?i){vocab.RESTRICTED_PATTERN}")


def page_state(title: Column, body: Column, notice: Column, shell: Column) -> Column:
    """restricted, dynamic, empty or ok, in this order of precedence."""
    dynamic = notice.rlike(f"(?i){vocab.SCRIPT_NOTICE_PATTERN}") | shell
    return (
        F.when(is_restricted(F.concat(title, F.lit(" "), body)), F.lit("restricted"))
        .when((F.length(body) < vocab.MIN_BODY) & dynamic, F.lit("dynamic"))
        .when(F.length(body) < vocab.MIN_BODY, F.lit("empty"))
        .otherwise(F.lit("ok"))
    )


def limited(text: Column, length: int | None) -> Column:
    """The text, cut only where a length is given."""
    return text if length is None else F.substring(text, 1, length)


def parse_pages(
    pages: DataFrame, html: str = "html", text_length: int | None = None, title_length: int | None = None, terminated: bool = False,
) -> DataFrame:
    """Adds title, text, published_at, hrefs and state; the HTML itself is dropped.  Texts stay whole unless lengths are given.

    Browsers also decode some entities without a semicolon; with ``terminated`` those stay as they are written.
    """
    read = read_html_terminated if terminated else read_html
    parsed = pages.withColumn("_p", read(F.col(html))).drop(html)
    dates = F.filter(F.transform("_p.data_dates", parse_date), lambda d: d.isNotNull())
    staged = bind(
        parsed,
        text=limited(collapse_space("_p.body"), text_length),
        title=limited(strip_space("_p.title"), title_length),
        published_at=F.coalesce(parse_date("_p.stated_date"), F.try_element_at(dates, F.lit(-1))),
        hrefs=F.col("_p.hrefs"),
    )
    state = page_state(F.col("_p.title"), F.col("text"), F.col("_p.notice"), F.col("_p.shell"))
    return bind(staged, state=state).drop("_p")


def follow_links(url: Column | str, hrefs: Column | str, pattern: str = vocab.LINK_PATTERN) -> Column:
    """Distinct canonical same-host links whose location matches ``pattern``, in page order."""
    page = F.col(url) if isinstance(url, str) else url
    anchors = F.col(hrefs) if isinstance(hrefs, str) else hrefs

    def matching(host: Column) -> Column:
        resolved = F.transform(anchors, lambda h: urls.resolve_link(h, page))
        same_host = F.filter(
            resolved,
            lambda link: (urls.host_of(link) == host)
            & F.regexp_extract(link, r"(?s)^[A-Za-z]+:[/\\]+[^/\\?#]*(.*)$", 1).rlike(f"(?i){pattern}"),
        )
        canonical = F.transform(same_host, urls.canonical_url)
        return F.array_distinct(F.filter(canonical, lambda c: c.isNotNull() & (c != page)))

    return let(urls.host_of(page), matching)


def next_links(links: Column | str, official: bool = False, deep: bool = False) -> Column:
    """The links that are read next: 2 narrow ones on official sites, else 3 (deep) or 1."""
    found = F.col(links) if isinstance(links, str) else links
    if official:
        found = F.filter(found, lambda c: c.rlike(f"(?i){vocab.OFFICIAL_LINK_PATTERN}"))
    return F.slice(found, 1, 2 if official else 3 if deep else 1)
