"""Text keys, similarity, number tokens and excerpts as column expressions."""

from __future__ import annotations

import re
import string
import unicodedata
from collections.abc import Callable
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType

from gleanery.functions import vocab
from gleanery.functions.binding import let

# The white-space set of the source semantics; Java's \s is ASCII only.
SPACE = r"[\t\n\x0B\f\r \xA0\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]"
SPACES = "\t\n\x0b\f\r \xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000\ufeff"
# White space, punctuation and symbols of ASCII.
ASCII_MARKS = "\t\n\x0b\f\r " + string.punctuation
NUMBER = r"(\d+(?:\.\d+)?" + SPACE + "*(?:" + "|".join(vocab.NUMBER_UNITS) + "))"


# Rows of a batch that are Python strings at one time.
SLICE = 256


def sliced(values: pa.Array, change: Callable, kind: pa.DataType) -> pa.Array:
    """``change`` of every value; the Python objects of one slice at a time, so memory follows the Arrow batch."""
    parts = [pa.array([change(v) for v in values.slice(at, SLICE).to_pylist()], kind) for at in range(0, len(values), SLICE)]
    return pa.concat_arrays(parts) if parts else pa.array([], kind)


def _normal(value: str | None) -> str | None:
    # The Arrow kernel of this name leaves letters decomposed, so the standard library is used.
    return None if value is None else unicodedata.normalize("NFKC", value)


@F.arrow_udf(StringType())
def nfkc(values: pa.Array) -> pa.Array:
    return sliced(values, _normal, pa.string())


@F.arrow_udf(ArrayType(StringType()))
def nfkc_each(lists: pa.Array) -> pa.Array:
    return sliced(lists, lambda values: None if values is None else [_normal(v) for v in values], pa.list_(pa.string()))


def identity_key(value: str) -> str:
    """The identity key of one configured name, for literals and for the ordered merge."""
    key = unicodedata.normalize("NFKC", value).lower()
    for pattern, canonical in _COMPILED_ALIASES:
        key = pattern.sub(canonical, key)
    return "".join(c for c in key if not c.isspace() and unicodedata.category(c)[0] not in "PS" and c != "\ufeff")


_COMPILED_ALIASES = [(re.compile(p), c) for p, c in vocab.IDENTITY_ALIASES]


def _col(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def strip_space(value: Column | str) -> Column:
    return F.regexp_replace(_col(value), f"^{SPACE}+|{SPACE}+$", "")


def collapse_space(value: Column | str) -> Column:
    return strip_space(F.regexp_replace(_col(value), f"{SPACE}+", " "))


def fold_key(value: Column | str) -> Column:
    """Spaceless lower-case form used for quote containment and hashing."""
    return F.lower(F.regexp_replace(_col(value), f"{SPACE}+", ""))


def needles(pattern: str) -> list[str]:
    """The beginning of every alternative of an alias; a text without any of them has no match."""
    starts = [re.match(r"[^\\\[(?*+{.^$]+(?![?*{])", a) for a in re.split(r"\|(?![^(]*\))", pattern)]
    if not all(starts):
        raise ValueError(f"an alternative does not begin with letters: {pattern}")
    return [s.group() for s in starts]


def _renamed(key: Column, alias: tuple[str, str]) -> Column:
    """One alias replaced; its pattern only runs over texts that hold one of its beginnings."""
    pattern, canonical = alias
    held = lambda k: reduce(Column.__or__, [F.contains(k, F.lit(n)) for n in needles(pattern)])
    return let(key, lambda k: F.when(held(k), F.regexp_replace(k, pattern.replace(r"\s", SPACE), canonical)).otherwise(k))


def identity_from_nfkc(value: Column) -> Column:
    """JVM-side part of the identity key; the input is already NFKC."""
    key = reduce(_renamed, vocab.IDENTITY_ALIASES, F.lower(value))
    # The pattern is left to texts with other characters than ASCII.
    pattern = SPACE[:-1] + r"\p{P}\p{S}]+"
    return let(key, lambda k: F.when(F.octet_length(k) > F.length(k), F.regexp_replace(k, pattern, "")).otherwise(F.translate(k, ASCII_MARKS, "")))


def identity_text(value: Column | str) -> Column:
    return identity_from_nfkc(nfkc(_col(value)))


def bigrams(key: Column | str) -> Column:
    """Distinct character bigrams of an identity key, each as its two code points in one number.

    Numbers keep the sets small and let Spark intersect them without comparing strings.
    """
    # Empty matches move on by half a character beyond U+FFFF, where no pair begins.
    pairs = F.array_distinct(F.regexp_extract_all(_col(key), F.lit(r"(?s)(?![\x{DC00}-\x{DFFF}])(?=(..))"), F.lit(1)))
    return F.transform(
        pairs, lambda g: F.ascii(g).cast("bigint") * 2_097_152 + F.ascii(F.substring(g, 2, 1)).cast("bigint")
    )


def key_grams(keys: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(row, gram) of the distinct bigrams of each key, sorted by both."""
    points = np.frombuffer("".join(keys).encode("utf-32-le"), np.uint32).astype(np.int64)
    row = np.repeat(np.arange(len(keys)), [len(k) for k in keys])
    inside = np.flatnonzero(row[1:] == row[:-1])
    row, gram = row[inside], points[inside] * 2_097_152 + points[inside + 1]
    if len(keys) < 1 << 21:
        # Two code points have 42 bits, so row and gram fit into one number.
        both = np.sort((row << 42) | gram)
        row, gram = both >> 42, both & ((1 << 42) - 1)
    else:
        order = np.lexsort((gram, row))
        row, gram = row[order], gram[order]
    first = np.ones(len(row), dtype=bool)
    first[1:] = (row[1:] != row[:-1]) | (gram[1:] != gram[:-1])
    return row[first], gram[first]


def gram_lists(keys: pa.Array) -> pa.Array:
    """The distinct bigrams of each key."""
    row, gram = key_grams(keys.fill_null("").to_pylist())
    ends = np.searchsorted(row, np.arange(len(keys) + 1))
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(gram, pa.int64()), mask=keys.is_null())


@F.arrow_udf(ArrayType(ArrayType(LongType())))
def bigrams_each(lists: pa.Array) -> pa.Array:
    """``bigrams`` of every key of a list, in ascending order."""
    parts = []
    for at in range(0, len(lists), SLICE):
        some = lists.slice(at, SLICE)
        ends = np.concatenate([[0], np.cumsum(some.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))])
        parts.append(pa.ListArray.from_arrays(pa.array(ends, pa.int32()), gram_lists(some.flatten()), mask=some.is_null()))
    return pa.concat_arrays(parts) if parts else pa.array([], pa.list_(pa.list_(pa.int64())))


def dice(left: Column, right: Column) -> Column:
    """Dice coefficient of two distinct bigram arrays; zero when either is empty."""
    total = F.size(left) + F.size(right)
    shared = F.size(F.array_intersect(left, right))
    return F.when((F.size(left) > 0) & (F.size(right) > 0), 2.0 * shared / total).otherwise(F.lit(0.0))


def text_similarity(left: Column | str, right: Column | str) -> Column:
    return dice(bigrams(identity_text(left)), bigrams(identity_text(right)))


def number_tokens(value: Column | str) -> Column:
    """Quantities with a unit, inner white space removed, in order of appearance."""
    found = F.regexp_extract_all(_col(value), F.lit(NUMBER), F.lit(1))
    return F.transform(found, lambda t: F.regexp_replace(t, f"{SPACE}+", ""))


def long_excerpt(value: Column | str) -> Column:
    """Head and tail of a text above the analysis limit, the text itself below it."""
    body = _col(value)
    return F.when(
        F.length(body) > vocab.EXCERPT_LIMIT,
        F.concat(
            F.substring(body, 1, vocab.EXCERPT_HEAD),
            F.lit(vocab.EXCERPT_MARK),
            F.substring(body, -vocab.EXCERPT_TAIL, vocab.EXCERPT_TAIL),
        ),
    ).otherwise(body)


def token_excerpt(body: Column | str, token: Column | str) -> Column:
    """Original text around the first white-space-free match of ``token``; empty when absent.

    The window runs from 110 characters before the first matched character to 150 after the
    character that follows the match (the last character of the text when nothing follows).
    """
    text = _col(body)

    def cut(start: Column, matched: Column) -> Column:
        last = F.length(F.rtrim(text, F.lit(SPACES)))
        after = F.substr(text, start + matched)
        gap = F.length(after) - F.length(F.ltrim(after, F.lit(SPACES)))
        following = start - 1 + matched + gap
        end = F.least(F.length(text), F.least(following, last - 1) + 150)
        begin = F.greatest(F.lit(0), start - 1 - 110)
        return F.substring(collapse_space(F.substr(text, begin + 1, end - begin)), 1, 350)

    def find(core: Column) -> Column:
        return let(F.regexp_instr(text, core), lambda start: F.when(
            start > 0, let(F.length(F.regexp_substr(text, core)), lambda matched: cut(start, matched))).otherwise(F.lit("")))

    def pattern(needle: Column) -> Column:
        # One pattern per token: its characters quoted, white space allowed between them.
        pieces = F.transform(F.split(needle, ""), lambda c: F.concat(F.lit(r"\Q"), c, F.lit(r"\E")))
        core = F.array_join(F.filter(pieces, lambda p: p != F.lit(r"\Q\E")), f"{SPACE}*")
        return F.when(F.length(needle) > 0, let(core, find)).otherwise(F.lit(""))

    return let(F.regexp_replace(_col(token), f"{SPACE}+", ""), pattern)


def short_hash(value: Column | str) -> Column:
    return F.substring(F.sha2(_col(value).cast("string"), 256), 1, 24)


def event_key(company: Column | str, key: Column | str) -> Column:
    """Stable event key: prefixed keys are kept, others are hashed with their company."""
    raw = _col(key)
    hashed = short_hash(F.concat(fold_key(company), F.lit(":"), fold_key(raw)))
    return F.when(F.startswith(raw, F.lit("evt-")), raw).otherwise(F.concat(F.lit("evt-"), hashed))
