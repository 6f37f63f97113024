"""Text keys, similarity, number tokens and excerpts over whole texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from gleanery.functions import text, vocab
from gleanery.plans.registry import register, table


def identity_sql(expression: str) -> str:
    """The identity key in SQL, for tables whose text is already NFKC."""
    out = f"lower({expression})"
    for pattern, canonical in vocab.IDENTITY_ALIASES:
        out = f"regexp_replace({out}, '{pattern}', '{canonical}', 'g')"
    return f"regexp_replace({out}, '[\\s\\p{{P}}\\p{{S}}]', '', 'g')"


def bigram_sql(key: str) -> str:
    return (
        f"list_distinct(list_transform(range(1, length({key})), lambda i: substr({key}, i, 2)))"
    )


@register(f"SELECT doc_id, md5(k) AS key_hash, length(k) AS key_length FROM (SELECT doc_id, {identity_sql('text')} AS k FROM documents)")
def identity_keys(spark, sf):
    key = text.identity_text("text")
    keyed = table(spark, sf, "documents").select("doc_id", key.alias("k"))
    return keyed.select("doc_id", F.md5("k").alias("key_hash"), F.length("k").cast("bigint").alias("key_length"))


@register(
    f"""
  WITH k AS (SELECT conv_id, turn, {identity_sql('text')} AS k FROM conversations),
  g AS (SELECT conv_id, turn, {bigram_sql('k')} AS g FROM k)
  SELECT a.conv_id, a.turn,
         CASE WHEN len(a.g) = 0 OR len(b.g) = 0 THEN 0.0
              ELSE round(2.0 * len(list_intersect(a.g, b.g)) / (len(a.g) + len(b.g)), 6) END::DOUBLE AS similarity
  FROM g a JOIN g b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1
"""
)
def turn_similarity(spark, sf):
    """Dice similarity of every turn with the one that follows it in the conversation."""
    turns = table(spark, sf, "conversations").select(
        "conv_id", "turn", text.bigrams(text.identity_text("text")).alias("grams")
    )
    following = turns.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("grams").alias("next_grams"))
    return turns.join(following, ["conv_id", "turn"]).select(
        "conv_id", "turn", F.round(text.dice(F.col("grams"), F.col("next_grams")), 6).alias("similarity")
    )


CLAIM_SQL = """('交付 ' || l_quantity::BIGINT || ' 台，税率' || round(l_tax * 100)::BIGINT || ' %，折扣' ||
   round(l_discount * 100)::BIGINT || '%，批次' || l_linenumber || '项')"""


def line_claim():
    return F.concat(
        F.lit("交付 "), F.col("l_quantity").cast("bigint"), F.lit(" 台，税率"), F.round(F.col("l_tax") * 100).cast("bigint"),
        F.lit(" %，折扣"), F.round(F.col("l_discount") * 100).cast("bigint"), F.lit("%，批次"), F.col("l_linenumber"), F.lit("项"),
    )


@register(
    """
  SELECT l_orderkey, l_linenumber,
         l_quantity::BIGINT || '台|' || round(l_tax * 100)::BIGINT || '%|' || round(l_discount * 100)::BIGINT || '%|' ||
         l_linenumber || '项' AS tokens
  FROM lineitem
"""
)
def claim_numbers(spark, sf):
    tokens = text.number_tokens(line_claim())
    return table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", F.array_join(tokens, "|").alias("tokens")
    )


@register(
    """
  WITH w AS (SELECT doc_id, text, list_filter(string_split(text, ' '), lambda x: x <> '' AND NOT contains(x, chr(10))) AS words FROM documents),
  t AS (SELECT doc_id, text, words[len(words) // 2 + 1] AS token FROM w WHERE len(words) > 0),
  c AS (SELECT doc_id, text, token, regexp_replace(text, '\\s+', '', 'g') AS compact, string_split(text, '') AS chars FROM t),
  p AS (SELECT *, strpos(compact, token) - 1 AS found,
          list_filter(list_transform(chars, lambda ch, i: CASE WHEN ch IN (' ', chr(10)) THEN 0 ELSE i END), lambda i: i > 0) AS spots FROM c),
  b AS (SELECT *, spots[found + 1] - 1 AS first_pos,
          spots[least(len(spots) - 1, found + length(token)) + 1] - 1 AS last_pos FROM p WHERE found >= 0)
  SELECT doc_id, token,
    substr(trim(regexp_replace(substr(text, greatest(0, first_pos - 110) + 1,
       least(length(text), last_pos + 150) - greatest(0, first_pos - 110)), '\\s+', ' ', 'g')), 1, 350) AS excerpt
  FROM b
"""
)
def token_excerpts(spark, sf):
    """Text around the first occurrence of each document's middle word."""
    words = F.filter(F.split("text", " "), lambda w: (w != "") & ~w.contains("\n"))
    tokens = (
        table(spark, sf, "documents")
        .select("doc_id", "text", words.alias("words"))
        .where(F.size("words") > 0)
        .select("doc_id", "text", F.element_at("words", F.floor(F.size("words") / 2).cast("int") + 1).alias("token"))
    )
    return tokens.select("doc_id", "token", text.token_excerpt("text", "token").alias("excerpt"))


@register(
    f"""
  SELECT doc_id, length(x) AS size, md5(x) AS excerpt_hash FROM (
    SELECT doc_id, CASE WHEN length(text) > 4800
      THEN substr(text, 1, 3800) || '{vocab.EXCERPT_MARK}' || right(text, 800) ELSE text END AS x
    FROM documents)
"""
)
def long_excerpts(spark, sf):
    cut = table(spark, sf, "documents").select("doc_id", text.long_excerpt("text").alias("x"))
    return cut.select("doc_id", F.length("x").cast("bigint").alias("size"), F.md5("x").alias("excerpt_hash"))


@register(
    """
  SELECT c_custkey,
    CASE WHEN c_custkey % 5 = 0 THEN 'evt-' || c_custkey
         ELSE 'evt-' || substr(sha256(lower(regexp_replace(n_name, '\\s+', '', 'g')) || ':' ||
              lower(regexp_replace(c_name || ' ' || c_mktsegment, '\\s+', '', 'g'))), 1, 24) END AS event_key
  FROM customer JOIN nation ON c_nationkey = n_nationkey
"""
)
def event_keys(spark, sf):
    raw = F.when(F.col("c_custkey") % 5 == 0, F.concat(F.lit("evt-"), "c_custkey")).otherwise(
        F.concat_ws(" ", "c_name", "c_mktsegment")
    )
    joined = table(spark, sf, "customer").join(
        table(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey")
    )
    return joined.select("c_custkey", text.event_key(F.col("n_name"), raw).alias("event_key"))
