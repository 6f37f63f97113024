"""Quality rules: a table of thresholds compiled into one projection, without user functions and without a shuffle.

Words are runs of characters other than 0x20 and 0x09-0x0D.  ``base_failed`` marks texts of fewer than 50 words and texts in
which more than half of the words lie in three-word windows that occur again.  ``kept`` also needs every rule of the table.

Nulls and texts without words have zero counts and fail the base rule.  Repeated rows are judged each for itself.  Only the
id and text columns are read; names of other columns don't matter.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleanery.functions.binding import let

SPACES = r"[\x20\x09-\x0D]+"
SYMBOLS = "[#*$%&|<>]"
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
WINDOW = 3

# Frequent function words of the languages served; a text of prose holds some of them.
STOP_WORDS = (
    "the and of to in is that for was with "
    "der die und das ist von den mit ein zu "
    "de la le les et des un une du que "
    "el los en y se las por con para del"
).split()


@dataclass(frozen=True)
class Rule:
    """``metric`` must lie between ``least`` and ``most``, both included; None leaves that side open."""

    name: str
    metric: str
    least: float | None = None
    most: float | None = None


RULES = (
    Rule("length", "n_words", 50, 1_000_000),
    Rule("word_length", "mean_word_chars", 2.0, 15.0),
    Rule("symbols", "symbol_ratio", None, 0.15),
    Rule("stop_words", "stop_ratio", 0.02, None),
    Rule("duplicate_lines", "dup_line_ratio", None, 0.3),
)


def _repeat_words(words: Column) -> Column:
    """Number of words that lie in a window found twice or more; sorts windows by their words, so n log n in the text."""
    n = F.size(words)
    windows = F.transform(
        F.sequence(F.lit(0), n - WINDOW), lambda i: F.concat_ws(" ", *[F.get(words, i + k) for k in range(WINDOW)])
    )

    def covered(every: Column) -> Column:
        placed = F.sort_array(F.transform(every, lambda t, i: F.struct(t.alias("t"), i.alias("i"))))
        places = let(placed, lambda s: F.sort_array(F.filter(
            F.transform(s, lambda x, j: F.when((x["t"] == F.get(s, j - 1)["t"]) | (x["t"] == F.get(s, j + 1)["t"]), x["i"])),
            lambda p: p.isNotNull(),
        )))
        return let(places, lambda p: F.aggregate(
            F.transform(p, lambda x, k: F.least(F.coalesce(F.get(p, k + 1) - x, F.lit(WINDOW)), F.lit(WINDOW))),
            F.lit(0), lambda total, x: total + x,
        ))

    # Most texts repeat no window at all, which a hash set tells without sorting.
    return F.when(n < WINDOW + 1, F.lit(0)).otherwise(let(windows, lambda every: F.when(
        F.size(F.array_distinct(every)) == F.size(every), F.lit(0)).otherwise(covered(every))))


def measures(text: Column) -> dict[str, Column]:
    """Struct of the counts that the rules use."""
    text = F.coalesce(text, F.lit(""))
    lines = F.filter(F.split(text, "\n", -1), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))

    def counts(words: Column) -> Column:
        return F.struct(
            F.size(words).cast("bigint").alias("n_words"),
            F.length(F.array_join(words, "")).cast("bigint").alias("word_chars"),
            (F.length(text) - F.length(F.regexp_replace(text, SYMBOLS, ""))).cast("bigint").alias("n_symbols"),
            let(lines, lambda x: F.struct(
                F.size(x).alias("all"), (F.size(x) - F.size(F.array_distinct(x))).cast("bigint").alias("dup"))).alias("lines"),
            _repeat_words(words).cast("bigint").alias("n_repeat_words"),
            F.size(F.filter(words, lambda w: F.lower(w).isin(STOP_WORDS))).alias("stop"),
        )

    return let(F.filter(F.split(text, SPACES, -1), lambda w: w != ""), counts)


def compiled(rules: tuple[Rule, ...], metrics: dict[str, Column]) -> list[tuple[str, Column]]:
    """One boolean expression per rule; a metric without a value fails no rule."""
    out = []
    for rule in rules:
        checks = []
        if rule.least is not None:
            checks.append(metrics[rule.metric] >= rule.least)
        if rule.most is not None:
            checks.append(metrics[rule.metric] <= rule.most)
        passed = checks[0] if len(checks) == 1 else checks[0] & checks[1]
        out.append((rule.name, F.coalesce(passed, F.lit(True))))
    return out


def judged(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(id, counts, base_failed, kept, broken_rules) for every row."""
    held = docs.select(F.col(id_column).alias("_id"), F.inline(F.array(F.struct(measures(F.col(text_column).cast("string")).alias("_m")))))
    m = {k: F.col(f"_m.{k}") for k in ("n_words", "word_chars", "n_symbols", "n_repeat_words", "stop")}
    m["n_lines"], m["n_dup_lines"] = F.col("_m.lines.all").cast("bigint"), F.col("_m.lines.dup")
    per_word = lambda c: F.when(m["n_words"] > 0, c / m["n_words"])
    metrics = {
        **m, "mean_word_chars": per_word(m["word_chars"]), "symbol_ratio": per_word(m["n_symbols"]), "stop_ratio": per_word(m["stop"]),
        "dup_line_ratio": F.when(m["n_lines"] > 0, m["n_dup_lines"] / m["n_lines"]),
    }
    base_failed = (m["n_words"] < MIN_WORDS) | (m["n_repeat_words"] * 100 > m["n_words"] * MAX_REPEAT_PERCENT)
    checks = compiled(rules, metrics)
    broken = F.concat_ws(",", *[F.when(~ok, F.lit(name)) for name, ok in checks])
    return held.select(
        F.col("_id").alias(id_column), m["n_words"].alias("n_words"), m["word_chars"].alias("word_chars"), m["n_symbols"].alias("n_symbols"),
        m["n_dup_lines"].alias("n_dup_lines"), m["n_repeat_words"].alias("n_repeat_words"), base_failed.alias("base_failed"),
        broken.alias("broken_rules"),
    ).withColumn("kept", ~F.col("base_failed") & (F.col("broken_rules") == ""))


SQL = r"""
WITH w AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws,
    length(coalesce(text, '')) - length(regexp_replace(coalesce(text, ''), '[#*$%&|<>]', '', 'g')) AS n_symbols,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls
  FROM documents
), p AS (
  SELECT doc_id, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS t
  FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 1)) AS i FROM w)
), r AS (
  SELECT doc_id, i FROM p WHERE (doc_id, t) IN (SELECT (doc_id, t) FROM p GROUP BY doc_id, t HAVING count(*) > 1)
), c AS (
  SELECT doc_id, sum(least(3, coalesce(nxt - i, 3))) AS n_repeat_words
  FROM (SELECT doc_id, i, lead(i) OVER (PARTITION BY doc_id ORDER BY i) AS nxt FROM r) GROUP BY doc_id
), m AS (
  SELECT w.doc_id, len(ws)::BIGINT AS n_words, length(array_to_string(ws, ''))::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols,
    (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, len(ls) AS n_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words,
    len(list_filter(ws, lambda x: lower(x) IN ({stop}))) AS stop
  FROM w LEFT JOIN c USING (doc_id)
), v AS (
  SELECT *, n_words < 50 OR n_repeat_words * 100 > n_words * 50 AS base_failed,
    array_to_string(list_filter([
      CASE WHEN n_words < 50 OR n_words > 1000000 THEN 'length' END,
      CASE WHEN word_chars / n_words < 2.0 OR word_chars / n_words > 15.0 THEN 'word_length' END,
      CASE WHEN n_symbols / n_words > 0.15 THEN 'symbols' END,
      CASE WHEN stop / n_words < 0.02 THEN 'stop_words' END,
      CASE WHEN n_dup_lines / n_lines > 0.3 THEN 'duplicate_lines' END], lambda x: x IS NOT NULL), ',') AS broken_rules
  FROM m
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, broken_rules,
  NOT base_failed AND broken_rules = '' AS kept
FROM v
""".replace("{stop}", ", ".join(f"'{w}'" for w in dict.fromkeys(STOP_WORDS)))
