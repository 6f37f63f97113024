"""Chat formatting: a finite-state machine over roles writes turns by a declarative template.

A template names its control strings, the segments of each role, and which roles may follow which.  The machine reads the turns
of a conversation in order, says for each whether its role may stand there, and emits its segments: literal strings, the escaped
text (or role), and for each segment whether it is trained on.  A turn out of order is marked and written all the same.

A control string inside a text gets an escape character after its first character, and one more if it has some there already;
reading takes one away.  So no text holds a control string, other texts stay as they are, and every text comes back unchanged.

``formatted`` gives one row per turn: conv_id, pos (from 1), formatted, loss (spans in code points of ``formatted``), in_order.
The formatted text of a conversation is the concatenation over pos.  ``read_back`` parses the rows with the template alone.

Turns are ordered by turn (null first), then role, then text.  A null role or text is empty; any role that the template doesn't
name is written with its name.  Rows with a null conv_id are one conversation.  Repeated rows are turns of their own.  Only
these four columns are read.  A conversation is one sorted stream through one task, which holds one turn at a time.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from enum import Enum

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class Part(Enum):
    """What a segment takes from the turn."""

    TEXT = "text"
    ROLE = "role"


TEXT, ROLE = Part.TEXT, Part.ROLE
OTHER = None
Segments = tuple[tuple[object, bool], ...]


@dataclass(frozen=True)
class Template:
    controls: tuple[str, ...]
    opening: str
    roles: dict[str | None, Segments]
    follows: dict[str, tuple[str, ...]]
    escape: str = "\\"
    _add: re.Pattern = field(init=False, repr=False)
    _take: re.Pattern = field(init=False, repr=False)

    def __post_init__(self) -> None:
        for a in self.controls:
            for b in self.controls:
                if any(a[k:].startswith(b) or b.startswith(a[k:]) for k in range(1, len(a))) or self.escape in a or len(a) < 2:
                    raise ValueError(f"control strings {a!r} and {b!r} overlap")
        mark = re.escape(self.escape)
        sites = "|".join(f"(?<={re.escape(c[0])}){{}}(?={re.escape(c[1:])})" for c in self.controls)
        object.__setattr__(self, "_add", re.compile(sites.replace("{}", f"{mark}*")))
        object.__setattr__(self, "_take", re.compile(sites.replace("{}", f"{mark}+")))
        for role, segments in self.roles.items():
            if sum(part is TEXT for part, _ in segments) != 1 or (role is OTHER) != any(part is ROLE for part, _ in segments):
                raise ValueError("each role has its text once, and only other roles have their name")

    def escaped(self, text: str) -> str:
        return self._add.sub(lambda m: m[0] + self.escape, text)

    def unescaped(self, text: str) -> str:
        return self._take.sub(lambda m: m[0][len(self.escape) :], text)

    def state(self, role: str) -> str:
        """The machine's state after a turn of this role."""
        return role if role in self.roles else ""

    def written(self, role: str, text: str, first: bool) -> list[tuple[str, bool]]:
        """Segments of a turn with their loss flags."""
        out = [(self.opening, False)] if first else []
        for part, loss in self.roles.get(role, self.roles[OTHER]):
            out.append((self.escaped(text) if part is TEXT else self.escaped(role) if part is ROLE else part, loss))
        return out

    def reader(self) -> re.Pattern:
        """Matches one written turn; the groups of role k are t<k> for the text and r<k> for the name."""
        kinds = []
        for k, segments in enumerate(self.roles.values()):
            kinds.append("".join(f"(?P<t{k}>.*?)" if p is TEXT else f"(?P<r{k}>.*?)" if p is ROLE else re.escape(p) for p, _ in segments))
        return re.compile(f"(?:{re.escape(self.opening)})?(?:{'|'.join(kinds)})", re.S)

    def read(self, turn: str, reader: re.Pattern) -> tuple[str, str]:
        """Role and text of one written turn."""
        found = reader.fullmatch(turn)
        for k, role in enumerate(self.roles):
            if found and found[f"t{k}"] is not None:
                return (self.unescaped(found[f"r{k}"]) if role is OTHER else role), self.unescaped(found[f"t{k}"])
        raise ValueError(f"not a written turn: {turn[:80]!r}")


INSTRUCT = Template(
    controls=("<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "[ROLE]", "[TEXT]", "[/ROLE]"),
    opening="<s>",
    roles={
        "system": (("<<SYS>>\n", False), (TEXT, False), ("\n<</SYS>>\n", False)),
        "user": (("[INST] ", False), (TEXT, False), (" [/INST]", False)),
        "assistant": ((" ", False), (TEXT, True), (" </s>", False)),
        OTHER: (("[ROLE] ", False), (ROLE, False), (" [TEXT] ", False), (TEXT, False), (" [/ROLE]", False)),
    },
    follows={"start": ("system", "user"), "system": ("user",), "user": ("assistant",), "assistant": ("user",), "": ()},
)

_NEVER = object()
FORMATTED = "conv_id bigint, pos bigint, formatted string, loss array<struct<begin: bigint, end: bigint>>, in_order boolean"
_SPAN = pa.struct([("begin", pa.int64()), ("end", pa.int64())])
_FORMATTED = pa.schema([("conv_id", pa.int64()), ("pos", pa.int64()), ("formatted", pa.string()), ("loss", pa.list_(_SPAN)), ("in_order", pa.bool_())])


def _write(template: Template) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, pos, state = _NEVER, 0, "start"
        for batch in batches:
            out: list[list] = [[], [], [], [], []]
            for conv, role, text in zip(*(batch.column(k).to_pylist() for k in range(3))):
                if conv != current:
                    current, pos, state = conv, 0, "start"
                pos += 1
                allowed, state = role in template.follows[state], template.state(role)
                at, parts, spans = 0, [], []
                for part, loss in template.written(role, text, pos == 1):
                    if loss:
                        spans.append({"begin": at, "end": at + len(part)})
                    parts.append(part)
                    at += len(part)
                for column, value in zip(out, (conv, pos, "".join(parts), spans, allowed)):
                    column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(out, _FORMATTED)], schema=_FORMATTED)

    return run


def formatted(turns: DataFrame, template: Template = INSTRUCT) -> DataFrame:
    """One row per turn of ``turns`` (conv_id, turn, role, text)."""
    plain = turns.select(
        F.col("conv_id").cast("bigint").alias("conv_id"), F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), "turn")
    ordered = plain.repartition("conv_id").sortWithinPartitions("conv_id", F.asc_nulls_first("turn"), "role", "text")
    return ordered.select("conv_id", "role", "text").mapInArrow(_write(template), FORMATTED)


READ = "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint, in_order boolean"
_READ = pa.schema([
    ("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()),
    ("formatted_chars", pa.int64()), ("in_order", pa.bool_())])


class _Digest:
    """What is known of a conversation so far."""

    def __init__(self, conv: int | None):
        self.conv, self.turns, self.chars, self.loss_chars, self.in_order = conv, 0, 0, 0, True
        self.all, self.loss = hashlib.sha256(), hashlib.sha256()

    def row(self) -> tuple:
        return self.conv, self.turns, self.all.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.chars, self.in_order


def _read(template: Template) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader, held = template.reader(), None
        for batch in batches:
            done = []
            for conv, text, spans, in_order in zip(*(batch.column(k).to_pylist() for k in range(4))):
                if held is None or conv != held.conv:
                    if held:
                        done.append(held.row())
                    held = _Digest(conv)
                role, told = template.read(text, reader)
                held.all.update(f"{role}\n{told}\n".encode("utf-8", "surrogatepass"))
                for span in spans:
                    trained = template.unescaped(text[span["begin"] : span["end"]])
                    held.loss_chars += len(trained)
                    held.loss.update(trained.encode("utf-8", "surrogatepass"))
                held.turns += 1
                held.chars += len(text)
                held.in_order &= in_order
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*done), _READ)], schema=_READ)
        if held:
            yield pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(held.row(), _READ)], schema=_READ)

    return run


def read_back(rows: DataFrame, template: Template = INSTRUCT) -> DataFrame:
    """Turns, digests and lengths of every conversation, parsed from rows of ``formatted``."""
    ordered = rows.repartition("conv_id").sortWithinPartitions("conv_id", "pos")
    return ordered.select("conv_id", "formatted", "loss", "in_order").mapInArrow(_read(template), READ)


SQL = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'
), o AS (
  SELECT *, row_number() OVER w AS pos, lag(role) OVER w AS before,
    length(regexp_replace(text, '([<\[])(\\*)(s>|/s>|INST\]|/INST\]|<SYS>>|</SYS>>|ROLE\]|TEXT\]|/ROLE\])', '\1\2\\\3', 'g')) AS chars,
    length(regexp_replace(role, '([<\[])(\\*)(s>|/s>|INST\]|/INST\]|<SYS>>|</SYS>>|ROLE\]|TEXT\]|/ROLE\])', '\1\2\\\3', 'g')) AS name_chars
  FROM t WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)
)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY pos)) AS turns_sha256,
  sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY pos) FILTER (role = 'assistant'), '')) AS loss_sha256,
  (3 + sum(chars + CASE role WHEN 'system' THEN 18 WHEN 'user' THEN 15 WHEN 'assistant' THEN 6 ELSE 23 + name_chars END))::BIGINT AS formatted_chars,
  bool_and(CASE WHEN pos = 1 THEN role IN ('system', 'user') WHEN role = 'user' THEN before IN ('system', 'assistant')
    ELSE role = 'assistant' AND before = 'user' END) AS in_order
FROM o GROUP BY conv_id
"""
