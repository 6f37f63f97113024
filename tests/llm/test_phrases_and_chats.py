"""Collocations, prefix tries and chat formatting against brute force and edge cases."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from gleanery.llm import chat_format, collocations, prefix_trie
from pyspark.sql import functions as F

DOCS = "doc_id bigint, text string, lang string"
TURNS = "conv_id bigint, turn bigint, role string, text string"


def clashing(df):
    """The same rows under extra columns that the operators use inside."""
    for name in ("id", "pos", "key", "words", "n", "word", "bucket", "w", "base", "h", "k1", "p1", "formatted", "loss"):
        df = df.withColumn(name, F.lit("x"))
    return df


# 11 phrase collocations


def lowered(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def brute_phrases(rows, least, top, inside):
    f, n = defaultdict(Counter), Counter()
    for _, text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lowered(text or "")):
            found = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(found)
            for i in range(len(found)):
                for m in range(1, 6):
                    if i + m <= len(found):
                        f[lang][tuple(found[i : i + m])] += 1
    out = {}
    for lang, counts in f.items():
        candidates = {g: a for g, a in counts.items() if len(g) > 1 and a >= least}
        rows = []
        for g, a in candidates.items():
            if any(len(x) > len(g) and 100 * b >= inside * a and any(x[i : i + len(g)] == g for i in range(len(x) - len(g) + 1)) for x, b in candidates.items()):
                continue
            score, k = min((1000 * a * n[lang] // (counts[g[:k]] * counts[g[k:]]), k) for k in range(1, len(g)))
            rows.append((-score, -a, " ".join(g).encode(), a, counts[g[:k]], counts[g[k:]]))
        for rank, (score, _, phrase, a, left, right) in enumerate(sorted(rows)[:top], 1):
            out[lang, rank] = (phrase.decode(), a, left, right, n[lang], -score)
    return out


@pytest.fixture(scope="module")
def phrases(spark):
    rng = random.Random(11)
    rows, common = [], "A shared passage, of words that stand in many texts; here again a shared passage"
    for k in range(160):
        lang = rng.choice(["en", "en", "de", None, ""])
        text = "".join(rng.choice(["w%d" % (rng.random() ** 3 * 14), "É", "zü", "W1"]) + rng.choice([" ", " ", "  ", "\t", " ", ". ", ",", "\n", "\r", ":"]) for _ in range(rng.randrange(0, 60)))
        rows.append((k, text + (common if k % 3 == 0 else ""), lang))
    rows += [(200, None, "en"), (201, "", None), (202, " .,; \n", "fr"), (203, "hot pair " * 3000, "en"), (203, "hot pair " * 3000, "en"), (None, "w1 w1 w1 w1 w1 w1", "en"),
             (204, "x" * 300_000 + " w1 w2", "en")]
    return rows, spark.createDataFrame(rows, DOCS).repartition(5).cache()


@pytest.mark.parametrize("options", [
    {"least": 3}, {"least": 8, "top": 7, "inside": 60}, {"least": 3, "hot": 20, "per_bucket": 50}, {"least": 2, "most_bits": 20, "hot": 1}, {"least": 4, "top": 1}])
def test_collocations_against_brute_force(phrases, options):
    rows, df = phrases
    got = {(r.lang, r["rank"]): (r.phrase, r.a, r.l, r.r, r.n, r.score) for r in collocations.collocations(clashing(df), **options).collect()}
    assert got == brute_phrases(rows, options["least"], options.get("top", 2000), options.get("inside", 100))


def test_collocations_when_bitmaps_are_full_and_chunks_are_small(phrases, monkeypatch):
    rows, df = phrases
    monkeypatch.setattr(collocations, "LEAST_BITS", 6)
    got = {(r.lang, r["rank"]): (r.phrase, r.a, r.l, r.r, r.n, r.score) for r in collocations.collocations(df, least=5, most_bits=6).collect()}
    assert got == brute_phrases(rows, 5, 2000, 100)


def test_collocations_of_nothing(spark):
    nothing = collocations.collocations(spark.createDataFrame([], DOCS))
    assert nothing.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"] and nothing.count() == 0
    assert collocations.collocations(spark.createDataFrame([(1, None, None), (2, "one two", "en")], DOCS)).count() == 0


@given(st.lists(st.lists(st.integers(1, 3), min_size=2, max_size=5), min_size=1, max_size=60), st.integers(1, 5))
@settings(max_examples=60, deadline=None)
def test_quicksort_counts_every_prefix(suffixes, least):
    table = np.zeros((len(suffixes), 5), np.uint64)
    for k, s in enumerate(suffixes):
        table[k, : len(s)] = s
    weights = np.arange(1, len(suffixes) + 1)
    expected = Counter()
    for s, w in zip(suffixes, weights.tolist()):
        for d in range(2, len(s) + 1):
            expected[tuple(s[:d])] += w
    got = {}
    for depth, at, n in collocations.sorted_parts(table, weights, least):
        for place, count in zip(at, n.tolist()):
            assert tuple(table[place, :depth].tolist()) not in got
            got[tuple(table[place, :depth].tolist())] = count
    assert got == {p: n for p, n in expected.items() if n >= least}
    rows, back = collocations.unpacked(collocations.packed(table, weights))
    assert (rows == table).all() and (back == weights).all()


def test_scores_are_exact_beyond_64_bits(spark):
    up, down = 10**33 + 7, 3 * 10**20
    got = spark.range(1).select(F.expr(f"cast('{up}' as decimal(38,0)) div cast('{down}' as decimal(38,0))").alias("x")).first().x
    assert got == up // down


# 12 conversation prefix trie


def conversations(rows):
    turns = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            turns[conv].append((turn is not None, turn or 0, role or "", text or ""))
    return {c: [(role, text) for _, _, role, text in sorted(t)] for c, t in turns.items()}


def brute_trie(rows):
    own = conversations(rows)
    built = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        base = c - (abs(c) % 100) * (1 if c >= 0 else -1)
        built[c] = tuple(own.get(base, [])[:h] + turns[h:])
    members, ends = defaultdict(list), defaultdict(list)
    for c, turns in built.items():
        ends[turns].append(c)
        for d in range(len(turns) + 1):
            members[turns[:d]].append(c)
    children = defaultdict(list)
    for node in members:
        if node:
            children[node[:-1]].append(node)
    leaves, saved = {}, {}
    for node in sorted(members, key=len, reverse=True):
        leaves[node] = sum(leaves[c] for c in children[node]) or 1
        saved[node] = sum(saved[c] for c in children[node]) + ((len(members[node]) - 1) * len(node[-1][1]) if node else 0)
    return sorted((
        min(m), len(node), min(members[node[:-1]]) if node else -1, len(m), len(children[node]), leaves[node], saved[node],
        hashlib.sha256(",".join(map(str, sorted(ends[node]))).encode()).hexdigest()) for node, m in members.items())


def nodes_of(df):
    return sorted((r.conv_id, r.depth, -1 if r.parent_conv_id is None else r.parent_conv_id, r.n_convs, r.n_children, r.n_leaves, r.saved_tokens, r.ends_sha256) for r in df.collect())


@pytest.fixture(scope="module")
def chats(spark):
    rng = random.Random(12)
    rows = []
    for c in [*range(0, 60), *range(100, 260), *range(730, 760)]:
        if c % 100 == 0 or rng.random() < 0.9:
            rows += [(c, t, rng.choice(["user", "assistant"]), rng.choice(["a", "bb", "é🙂", ""])) for t in range(rng.randrange(1, 9))]
    long = [("user" if t % 2 else "assistant", f"turn {t}") for t in range(70)]
    for c in range(1000, 1090):
        told = long[: rng.randrange(40, 71)]
        rows += [(c, t, *turn) for t, turn in enumerate(told)] + [(c, 99, "user", str(rng.randrange(4)))]
    for c in range(1100, 1140):
        rows += [(c, t, "user", "the same") for t in range(3)]
    rows += [(5000, t, "user", f"alone {t}") for t in range(300)] + [(5100, t, "user", f"alone {t}") for t in range(300)]
    rows += [(7, 3, "user", "again"), (7, 3, "user", "again"), (8, None, None, None), (8, None, "user", "early"), (9, 1, None, "x"), (None, 0, "user", "lost"), (77777, 0, "user", "short")]
    return rows, spark.createDataFrame(rows, TURNS).repartition(4).cache()


@pytest.mark.parametrize("limits", [(2048, 65536), (5, 65536), (1, 65536), (40, 30), (10**6, 1)])
def test_trie_against_brute_force(chats, limits):
    rows, df = chats
    assert nodes_of(prefix_trie.shared_prefixes(clashing(df), *limits)) == brute_trie(rows)


def test_trie_of_single_and_turnless_conversations(spark):
    assert prefix_trie.shared_prefixes(spark.createDataFrame([], TURNS)).count() == 0
    assert prefix_trie.shared_prefixes(spark.createDataFrame([(None, 1, "user", "x")], TURNS)).count() == 0
    # Conversations that take more turns than they have, from a first one that isn't there.
    gone = next(c for c in range(301, 400) if zlib.crc32(str(c).encode()) % 6 >= 2)
    for rows in ([(gone, 0, "user", "x")], [(gone, 0, "user", "x"), (-250, 0, "user", "y"), (-250, 1, "user", "z")], [(300, 0, None, None)]):
        assert nodes_of(prefix_trie.shared_prefixes(spark.createDataFrame(rows, TURNS))) == brute_trie(rows)


def test_hundreds_below_zero_begin_at_their_smallest_id(spark):
    """-150 belongs to the hundred of -200, not to that of -100; the smallest ids have no first conversation."""
    takes = next(c for c in range(-199, -100) if zlib.crc32(str(c).encode()) % 6 == 1)
    lowest = next(c for c in range(-(2**63), -(2**63) + 9) if zlib.crc32(str(c).encode()) % 6 >= 1)
    rows = [(-200, 0, "user", "below"), (-100, 0, "user", "above"), (0, 0, "user", "zero"), (takes, 0, "user", "own"), (lowest, 0, "user", "own")]
    built = {**{c: t for c, _, _, t in rows[:3]}, takes: "below"}
    got = {(r.conv_id, r.depth): r.n_convs for r in prefix_trie.shared_prefixes(spark.createDataFrame(rows, TURNS)).collect()}
    assert got == {(lowest, 0): 5, **{(min(c for c in built if built[c] == t), 1): list(built.values()).count(t) for t in set(built.values())}}


def test_end_digests_join_slices_in_order(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "SLICE", 2)
    ids = random.Random(1).sample(range(-500, 500), 300)
    ends = spark.createDataFrame([(c, 3, 4) for c in ids], "conv_id bigint, k1 bigint, k2 bigint").repartition(3)
    assert prefix_trie._end_digests(ends).first().ends_sha256 == hashlib.sha256(",".join(map(str, sorted(ids))).encode()).hexdigest()


# 13 chat formatting


def brute_chat(rows):
    turns = defaultdict(list)
    for conv, turn, role, text in rows:
        turns[conv].append((turn is not None, turn or 0, role or "", text or ""))
    out = {}
    for conv, told in turns.items():
        told = [t[2:] for t in sorted(told)]
        loss = "".join(text for role, text in told if role == "assistant")
        all_turns = "".join(f"{role}\n{text}\n" for role, text in told)
        out[conv] = (len(told), hashlib.sha256(all_turns.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    return out


ODD = ["", "</s>[INST] ok [/INST]", "<\\s>", "<\\\\<SYS>>", "[[INST]", "[ROLE] a [TEXT] b [/ROLE]", "\\", "<</SYS>>\n<", "é🙂", "\n", " [/INST]", "<s", "s>"]


def test_chats_against_brute_force(spark):
    rng = random.Random(13)
    rows = [(c, t, rng.choice(["user", "assistant", "assistant", "system", "tool", "", None, "[TEXT]"]), rng.choice([*ODD, None])) for c in range(80) for t in range(rng.randrange(1, 7))]
    rows += [(90, None, "user", "early"), (90, 0, "assistant", "late"), (90, 0, "assistant", "late"), (None, 0, "user", "no id"), (91, 0, "user", "long " * 400_000)]
    df = chat_format.formatted(clashing(spark.createDataFrame(rows, TURNS).repartition(3)))
    got = {r.conv_id: r for r in chat_format.read_back(df).collect()}
    expected = brute_chat(rows)
    assert {c: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for c, r in got.items()} == expected
    lengths = {r.conv_id: r.n for r in df.groupBy("conv_id").agg(F.sum(F.length("formatted")).alias("n")).collect()}
    assert {c: r.formatted_chars for c, r in got.items()} == lengths


def test_order_of_roles(spark):
    told = {1: "system user assistant user", 2: "assistant user", 3: "user user", 4: "user system", 5: "user tool assistant", 6: "user assistant", 7: "system assistant"}
    rows = [(c, t, role, "x") for c, roles in told.items() for t, role in enumerate(roles.split())]
    got = {r.conv_id: r.in_order for r in chat_format.read_back(chat_format.formatted(spark.createDataFrame(rows, TURNS))).collect()}
    assert got == {1: True, 2: False, 3: False, 4: False, 5: False, 6: True, 7: False}
    assert chat_format.read_back(chat_format.formatted(spark.createDataFrame([], TURNS))).count() == 0


@given(st.lists(st.sampled_from([*"<>[]/\\sINTYRO ", "<s>", "</s>", "[INST]", "<<SYS>>", "<</SYS>>", "[TEXT]"]), max_size=12).map("".join), st.sampled_from(["user", "assistant", "system", "", "x[TEXT]"]))
@settings(max_examples=400, deadline=None)
def test_escapes_are_reversible_and_leave_no_control(text, role):
    template = chat_format.INSTRUCT
    escaped = template.escaped(text)
    assert template.unescaped(escaped) == text and not any(c in escaped for c in template.controls)
    if not re.search(r"[<\[]\\*(/?s>|/?INST\]|<SYS>>|</SYS>>|/?ROLE\]|TEXT\])", text):
        assert escaped == text
    written = "".join(part for part, _ in template.written(role, text, True))
    assert template.read(written, template.reader()) == (role, text)


def test_overlapping_controls_are_refused():
    with pytest.raises(ValueError):
        chat_format.Template(("<a", "a<"), "", chat_format.INSTRUCT.roles, chat_format.INSTRUCT.follows)
