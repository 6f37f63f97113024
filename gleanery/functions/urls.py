"""URL canonicalisation, safety, site membership and source trust as column expressions."""

from __future__ import annotations

import ipaddress
from dataclasses import dataclass, field
from urllib.parse import urlsplit

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType

from gleanery.functions import vocab
from gleanery.functions.binding import let

# scheme, credentials with @, host, port, path, query with ?, fragment with #
_SHAPE = (
    r"(?s)^(?i:(https?)):[/\\]{2,}([^/\\?#]*@)?(\[[^\]/?#]*\]|[^/\\?#:@\[\]\s]+)(?::(\d*))?"
    r"([/\\][^?#]*)?(\?[^#]*)?(#.*)?$"
)
_SCHEME, _CREDENTIALS, _HOST, _PORT, _PATH, _QUERY, _FRAGMENT = range(7)
_MARK = "\x01"
_PARTS = _MARK.join(f"${i}" for i in range(1, 8))
_UNSAFE_PATH = r"[\x00-\x20\"<>`{}\x7F-\x{10FFFF}]"
_HASH_ROUTE = r"^#!?/"


def _col(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def _clean(value: Column | str) -> Column:
    return F.regexp_replace(_col(value), r"^[\x00-\x20]+|[\x00-\x20]+$|[\t\n\r\x01]", "")


def _parse(url: Column | str) -> Column:
    """The seven parts of an http(s) URL from one regular expression; one part for anything else."""
    parts = F.split(F.regexp_replace(_clean(url), _SHAPE, _PARTS), _MARK)
    return F.transform(parts, lambda p, i: F.when(i.isin(_SCHEME, _HOST), F.lower(p)).otherwise(p))


def _is_web(parts: Column) -> Column:
    return F.coalesce(F.size(parts) == 7, F.lit(False))


def is_web_url(url: Column | str) -> Column:
    return F.coalesce(_clean(url).rlike(_SHAPE), F.lit(False))


def host_of(url: Column | str) -> Column:
    """Lower-case host of an http(s) URL, NULL for anything else."""
    return F.nullif(F.lower(F.regexp_extract(_clean(url), _SHAPE, _HOST + 1)), F.lit(""))


def _percent_encode(part: Column) -> Column:
    """Encode only what a path or fragment may not carry verbatim."""

    def encode(text: Column) -> Column:
        characters = F.transform(
            F.split(text, ""),
            lambda c: F.when(
                c.rlike(_UNSAFE_PATH), F.regexp_replace(F.url_encode(c), r"\+", "%20")
            ).otherwise(c),
        )
        return F.when(text.rlike(_UNSAFE_PATH), F.array_join(characters, "")).otherwise(text)

    return let(part, encode)


def _resolve_dots(path: Column) -> Column:
    """Remove '.' and '..' segments the way a URL parser does."""

    def step(kept: Column, segment: Column) -> Column:
        shorter = F.slice(kept, F.lit(1), F.greatest(F.size(kept) - 1, F.lit(1)))
        return (
            F.when(segment == "..", shorter)
            .when(segment == ".", kept)
            .otherwise(F.concat(kept, F.array(segment)))
        )

    def fold(text: Column) -> Column:
        segments = F.split(text, "/")
        folded = F.aggregate(F.slice(segments, F.lit(2), F.size(segments)), F.array(F.lit("")), step)
        closing = F.when(text.rlike(r"/\.{1,2}$"), F.array(F.lit(""))).otherwise(F.array().cast("array<string>"))
        joined = F.array_join(F.concat(folded, closing), "/")
        fixed = F.when(joined == "", F.lit("/")).otherwise(joined)
        return F.when(text.rlike(r"/\.{1,2}(/|$)"), fixed).otherwise(text)

    return let(path, fold)


def _query(raw: Column) -> Column:
    """Query re-encoded as a form: tracking parameters removed, stable sort by name."""

    def decode(part: Column) -> Column:
        return F.coalesce(F.try_url_decode(part), part)

    def form(query: Column) -> Column:
        pieces = F.filter(F.split(F.substr(query, F.lit(2)), "&"), lambda p: p != "")
        pairs = F.transform(
            pieces,
            lambda p, i: F.struct(
                decode(F.regexp_extract(p, r"(?s)^([^=]*)", 1)).alias("name"),
                i.alias("place"),
                decode(F.regexp_extract(p, r"(?s)^[^=]*=(.*)$", 1)).alias("value"),
            ),
        )
        kept = F.array_sort(F.filter(pairs, lambda p: ~p["name"].rlike(f"(?i){vocab.TRACKING_PATTERN}")))
        fields = F.transform(
            kept, lambda p: F.concat(F.url_encode(p["name"]), F.lit("="), F.url_encode(p["value"]))
        )
        return let(
            F.array_join(fields, "&"), lambda t: F.when(t == "", t).otherwise(F.concat(F.lit("?"), t))
        )

    return F.when(raw == "", raw).otherwise(let(raw, form))


def _serialise(parts: Column) -> Column:
    port = parts[_PORT]
    default = F.concat(parts[_SCHEME], port).isin("http80", "https443")
    shown_port = F.when((port == "") | default, F.lit("")).otherwise(F.concat(F.lit(":"), port))
    path = F.concat(F.when(parts[_PATH] == "", F.lit("/")).otherwise(F.lit("")), F.regexp_replace(parts[_PATH], r"\\", "/"))
    routed = parts[_FRAGMENT].rlike(_HASH_ROUTE)
    fragment = F.when(routed, _percent_encode(parts[_FRAGMENT])).otherwise(F.lit(""))
    return F.concat(
        parts[_SCHEME], F.lit("://"), parts[_CREDENTIALS], parts[_HOST], shown_port,
        _percent_encode(_resolve_dots(path)), _query(parts[_QUERY]), fragment,
    )


def _v4_number(host: Column) -> Column:
    """Numeric value of a host in any IPv4 notation, NULL when it is a name."""

    def number(part: Column) -> Column:
        return (
            F.when(part.rlike(r"^0x[0-9a-f]*$"), F.conv(F.concat(F.lit("0"), F.substr(part, F.lit(3))), 16, 10))
            .when(part.rlike(r"^0[0-7]+$"), F.conv(part, 8, 10))
            .when(part.rlike(r"^[0-9]+$"), part)
            .try_cast("bigint")
        )

    def combine(values: Column) -> Column:
        count, tail = F.size(values), F.element_at(values, -1)
        tail_power = F.pow(F.lit(256), 5 - count).cast("bigint")
        head = F.aggregate(
            F.slice(values, F.lit(1), F.greatest(count - 1, F.lit(0))),
            F.lit(0).cast("bigint"),
            lambda acc, v: F.when((v >= 0) & (v < 256), acc * 256 + v),
        )
        return F.when((count <= 4) & (tail < tail_power), head * tail_power + tail)

    labels = F.split(F.regexp_replace(host, r"\.$", ""), r"\.")
    return let(F.transform(labels, number), combine)


def _public_v4(value: Column) -> Column:
    def check(number: Column) -> Column:
        blocked = F.lit(False)
        for block in vocab.NON_PUBLIC_V4:
            net = ipaddress.ip_network(block)
            first = int(net.network_address)
            blocked = blocked | number.between(first, first + net.num_addresses - 1)
        return number.isNotNull() & ~blocked

    return let(value, check)


def _is_public(parts: Column) -> Column:
    host = parts[_HOST]
    numeric = host.rlike(r"(^|\.)([0-9]+|0x[0-9a-f]*)\.?$")
    dotted = F.when(numeric, _public_v4(_v4_number(host))).otherwise(host.contains(".") & ~host.startswith("["))
    accepted = (
        F.regexp_replace(parts[_CREDENTIALS], "[:@]", "").isin("")
        & parts[_PORT].isin("", "80", "443")
        & (host != "localhost")
        & ~F.endswith(host, F.lit(".local"))
        & dotted
    )
    return F.when(_is_web(parts), F.coalesce(accepted, F.lit(False))).otherwise(F.lit(False))


def is_public_url(url: Column | str) -> Column:
    """http(s) on a standard port, no credentials, a dotted host that is not local or reserved.

    Bracketed IPv6 hosts never contain a dot once serialised, so they are rejected here.
    """
    return let(_parse(url), _is_public)


def canonical_url(url: Column | str) -> Column:
    """Canonical form of a public URL, NULL when the URL is not acceptable."""
    return let(_parse(url), lambda parts: F.when(_is_public(parts), _serialise(parts)))


def evidence_url(url: Column | str) -> Column:
    """Identity of the page behind a citation; unusable input is returned unchanged."""

    def key(parts: Column) -> Column:
        routed = parts[_FRAGMENT].rlike(_HASH_ROUTE)
        return let(_serialise(parts), lambda full: F.when(routed, full).otherwise(F.regexp_replace(full, "/$", "")))

    return let(_parse(url), lambda parts: F.when(_is_web(parts), key(parts)).otherwise(_col(url)))


def resolve_link(href: Column | str, base: Column | str) -> Column:
    """Absolute http(s) URL of an anchor on a page, NULL for other schemes."""

    def resolve(parts: Column, link: Column) -> Column:
        port = F.when(parts[_PORT] == "", F.lit("")).otherwise(F.concat(F.lit(":"), parts[_PORT]))
        origin = F.concat(parts[_SCHEME], F.lit("://"), parts[_HOST], port)
        path = F.when(parts[_PATH] == "", F.lit("/")).otherwise(parts[_PATH])
        return (
            F.when(link.rlike(r"^(?i:https?):"), link)
            .when(link.rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*:"), F.lit(None).cast("string"))
            .when(link.rlike(r"^[/\\]{2}"), F.concat(parts[_SCHEME], F.lit(":"), link))
            .when(link.startswith("/"), F.concat(origin, link))
            .when(link.startswith("?"), F.concat(origin, path, link))
            .when(link.startswith("#"), F.concat(origin, path, parts[_QUERY], link))
            .when(link == "", F.concat(origin, path, parts[_QUERY]))
            .otherwise(F.concat(origin, F.regexp_replace(path, "[^/]*$", ""), link))
        )

    return let(_parse(base), lambda parts: let(_clean(href), lambda link: F.when(_is_web(parts), resolve(parts, link))))


def site_root(url: Column | str) -> Column:
    return F.regexp_replace(host_of(url), r"^www\.", "")


def host_in_site(host: Column, root: Column) -> Column:
    return F.coalesce((host == root) | F.endswith(host, F.concat(F.lit("."), root)), F.lit(False))


def belongs_to_site(url: Column | str, website: Column | str) -> Column:
    """The host equals the site's root or is one of its subdomains."""
    return let(host_of(url), lambda host: let(site_root(website), lambda root: host_in_site(host, root)))


@F.pandas_udf(BooleanType())
def is_public_address(addresses: pd.Series) -> pd.Series:
    """Public unicast test for resolved v4 and v6 addresses, v4-mapped forms unwrapped."""
    blocks = [ipaddress.ip_network(b) for b in vocab.NON_PUBLIC_V4]

    def check(text: str) -> bool:
        try:
            ip = ipaddress.ip_address(text)
        except ValueError:
            return False
        ip = getattr(ip, "ipv4_mapped", None) or ip
        if ip.version == 4:
            return not any(ip in block for block in blocks)
        return ip.is_global and not ip.is_multicast

    return addresses.map(check)


def host_suffixes(host: Column) -> Column:
    """Every dot-suffix of a host, the host itself first."""
    return let(
        F.split(host, r"\."),
        lambda labels: F.transform(
            labels, lambda _, i: F.array_join(F.slice(labels, i + 1, F.size(labels)), ".")
        ),
    )


def trustable_host(url: Column | str) -> Column:
    """Host of a web address without credentials, else NULL."""
    def host(parts: Column) -> Column:
        plain = F.regexp_replace(parts[_CREDENTIALS], "[:@]", "") == ""
        return F.when(_is_web(parts) & plain, parts[_HOST])

    return let(_parse(url), host)


@dataclass(frozen=True)
class TrustPolicy:
    """Domain lists of the three trusted tiers; at most a few hundred fixed entries.

    ``websites`` are the configured company sites.  Their number is limited by the settings
    check, so the lists are embedded in the plan as literals and no join is needed.  A domain in
    ``single_hosts`` gives its tier to the host of that name alone, not to its subdomains.
    """

    primary: tuple[str, ...] = tuple(vocab.PRIMARY_DOMAINS)
    authoritative: tuple[str, ...] = tuple(vocab.AUTHORITATIVE_DOMAINS)
    professional: tuple[str, ...] = tuple(vocab.PROFESSIONAL_DOMAINS)
    websites: tuple[str, ...] = ()
    builtin_sites: tuple[str, ...] = tuple(vocab.COMPANY_WEBSITES.values())
    single_hosts: tuple[str, ...] = ()
    limit: int = field(default=1000, repr=False)

    def __post_init__(self) -> None:
        if len(self.domains()) > self.limit:
            raise ValueError(f"more than {self.limit} trusted domains; use operators.trust.with_tiers")

    @staticmethod
    def _root(website: str) -> str | None:
        parts = urlsplit(website)
        if parts.scheme not in ("http", "https") or parts.username or parts.password or not parts.hostname:
            return None
        return parts.hostname.removeprefix("www.").lower()

    def primary_domains(self) -> list[str]:
        sites = [r for r in map(self._root, [*self.builtin_sites, *self.websites]) if r]
        return list(dict.fromkeys([*self.primary, *sites]))

    def domains(self) -> list[str]:
        return list(dict.fromkeys([*self.primary_domains(), *self.authoritative, *self.professional]))

    def tier(self, url: Column | str) -> Column:
        ranked = [
            ("professional", list(self.professional)),
            ("authoritative", list(self.authoritative)),
            ("primary", self.primary_domains()),
        ]

        def rank(suffixes: Column) -> Column:
            tier = F.lit("untrusted")
            for name, domains in ranked:
                if domains:
                    tier = F.when(_listed(suffixes, domains), F.lit(name)).otherwise(tier)
            return tier

        suffixes = host_suffixes(trustable_host(url))
        if self.single_hosts:
            suffixes = F.filter(suffixes, lambda s, i: (i == 0) | ~s.isin(*self.single_hosts))
        return let(suffixes, rank)

    def publisher(self, url: Column | str) -> Column:
        """First listed trusted domain that the host belongs to, empty when there is none."""
        def first(suffixes: Column) -> Column:
            hits = F.filter(_strings(self.domains()), lambda d: F.array_contains(suffixes, d))
            return F.coalesce(F.try_element_at(hits, F.lit(1)), F.lit(""))

        return let(host_suffixes(host_of(url)), first)

    def is_trusted(self, url: Column | str) -> Column:
        return self.tier(url) != "untrusted"

    def authority(self, url: Column | str, anchored: bool = False) -> Column:
        """Evidence authority 0-3.  ``anchored`` matches newsrooms by domain suffix only."""
        sites = [r for r in map(self._root, self.builtin_sites) if r]

        def grade(host: Column) -> Column:
            suffixes = host_suffixes(host)
            official = _listed(suffixes, sites) if sites else F.lit(False)
            if anchored:
                news = _listed(suffixes, vocab.AUTHORITY_NEWS_DOMAINS)
            else:
                news = host.rlike(vocab.AUTHORITY_NEWS_PATTERN)
            bare = F.regexp_replace(host, r"^www\.", "")
            return (
                F.when(host.isNull(), F.lit(0))
                .when(official | bare.rlike(vocab.AUTHORITY_TOP_PATTERN), F.lit(3))
                .when(news, F.lit(2))
                .otherwise(F.lit(1))
            )

        return let(host_of(url), grade)


def _strings(values: list[str]) -> Column:
    return F.array(*[F.lit(v) for v in values])


def _listed(suffixes: Column, domains: list[str]) -> Column:
    """One of the suffixes is in the list, which is hashed once and not for each row."""
    return F.exists(suffixes, lambda s: s.isin(*domains))
