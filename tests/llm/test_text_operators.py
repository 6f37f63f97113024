"""Operators for training data against brute force, libraries and edge cases."""

from __future__ import annotations

import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from gleanery.llm import (
    decontamination, jaccard_join, language_id, line_dedup, lm_scoring, quality_classifier, quality_rules, sentencepiece_fst,
    token_counts, token_output, words,
)
from pyspark.sql import functions as F

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lowered(text: str) -> str:
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def shouted(text: str) -> str:
    return "".join(c.upper() if c.isascii() else c for c in text)


def prose(rng: random.Random, n: int, vocabulary: int = 400) -> list[str]:
    return [f"w{rng.randrange(vocabulary)}é" if rng.random() < 0.2 else f"w{rng.randrange(vocabulary)}" for _ in range(n)]


@pytest.fixture(scope="module")
def corpus(spark):
    """Plain, near and exact copies, common lines, nulls, empties, a long text, repeated rows and ids."""
    rng = random.Random(4)
    rows, base = [], prose(rng, 300)
    common = " ".join(prose(rng, 12))
    for k in range(60):
        text = prose(rng, rng.randrange(1, 120))
        rows.append((k, " ".join(text[: len(text) // 2]) + f"\n{common}  \n" + " ".join(text[len(text) // 2 :]), "en", "s", 1))
    for k in range(60, 110):
        copy = list(base)
        for _ in range(rng.randrange(0, 8)):
            copy[rng.randrange(len(copy))] = f"x{rng.randrange(10**6)}"
        rows.append((k, " ".join(copy), "de", "hot", 2))
    rows += [(110, None, None, None, None), (111, "", "fr", "s", 0), (112, " \n\t ", "fr", "s", 3), (113, "one two", "fr", "s", 7),
             (114, "ONE  two", "fr", "s", 8), (115, " ".join(prose(rng, 20_000)), "en", "s", 5), (5, rows[5][1], "en", "s", 1), (116, "\n\n", "en", "s", 2),
             (117, common.upper(), "en", "s", 2), (118, " ".join(["the same three"] * 40), "en", "s", 9)]
    return rows, spark.createDataFrame(rows, DOCS).repartition(3).cache()


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], DOCS)


def clashing(df, **more):
    """The same rows under extra columns that the operators use inside."""
    for name in ("id", "hits", "row", "bucket", "_id", "n", "cls", "key", "token", "text2", "Content"):
        df = df.withColumn(name, F.lit("x"))
    return df


# words


@given(st.lists(st.one_of(st.none(), st.text(max_size=40)), max_size=8))
@settings(max_examples=60, deadline=None)
def test_word_spans_equal_the_regular_expression(texts):
    hashed, first = words.word_hashes(texts)
    for k, text in enumerate(texts):
        found = WORD.findall(lowered(text or ""))
        own = hashed[first[k] : first[k + 1]]
        assert len(own) == len(found)
        alone, _ = words.word_hashes(found)
        assert (own == alone).all()


def test_hashes_do_not_depend_on_the_window():
    data = np.frombuffer(("ab " * 500_000 + "z" * 1_200_000 + " ab").encode(), np.uint8)
    starts, ends = words.spans(data)
    hashed = words.hashes(data, starts, ends)
    assert len(set(hashed[:500_000].tolist())) == 1 and hashed[0] == hashed[-1] != hashed[-2]


@given(st.lists(st.one_of(st.none(), st.text(max_size=30)), max_size=30), st.integers(1, 60))
@settings(max_examples=60, deadline=None)
def test_bounded_batches_hold_the_same_rows(texts, most):
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts)), pa.int64()), pa.array(texts, pa.string())], names=["id", "text"])
    parts = list(words.bounded([batch], 1, most))
    assert [x for p in parts for x in p.column(1).to_pylist()] == texts
    assert all(p.num_rows == 1 or sum(len((t or "").encode()) for t in p.column(1).to_pylist()) <= most for p in parts)


# 1 quality rules


def repeat_words(found: list[str]) -> int:
    count = Counter(tuple(found[i : i + 3]) for i in range(len(found) - 2))
    return len({j for i in range(len(found) - 2) if count[tuple(found[i : i + 3])] > 1 for j in range(i, i + 3)})


def test_quality_rules_against_brute_force(corpus, nothing):
    rows, df = corpus
    got = quality_rules.judged(clashing(df)).collect()
    assert len(got) == len(rows)
    by_id = {r.doc_id: r for r in got}
    for doc, text, *_ in rows:
        found = WORD.findall(text or "")
        lines = [x for x in (text or "").split("\n") if WORD.search(x)]
        r = by_id[doc]
        assert (r.n_words, r.word_chars) == (len(found), sum(map(len, found)))
        assert r.n_dup_lines == len(lines) - len(set(lines)) and r.n_repeat_words == repeat_words(found)
        assert r.base_failed == (len(found) < 50 or 100 * repeat_words(found) > 50 * len(found))
    assert by_id[118].base_failed and not by_id[118].kept
    assert quality_rules.judged(nothing).count() == 0
    assert "Python" not in quality_rules.judged(df)._jdf.queryExecution().toString()


# 2 SentencePiece


@pytest.fixture(scope="module")
def library():
    import public_tokenizers
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(sentencepiece_fst.MODEL))


def test_shortest_paths_equal_the_library(library):
    rng = random.Random(3)
    pieces = [library.id_to_piece(i).replace("▁", " ") for i in range(259, library.get_piece_size())]
    texts = ["", None, " ", " a", "a ", "a  b", "\n\n x\t y", " x ▁y", "漢字 🤖🤖", "<s> </s>", "\x00 a\x00b", "a" * 500, "  " * 33]
    texts += ["".join(rng.choice(pieces) for _ in range(rng.randrange(1, 8))) for _ in range(1500)]
    texts += ["".join(rng.choice("abcdefghio .,éñ\n<🤖1") for _ in range(rng.randrange(1, 60))) for _ in range(500)]
    ids = sentencepiece_fst.encoded(texts)
    for text, got in zip(texts, ids):
        assert np.frombuffer(got, "<i4").tolist() == library.encode(text or "")
        assert sentencepiece_fst.decoded(got) == library.decode(library.encode(text or ""))


def test_pieces_of_a_table(corpus, nothing, library):
    rows, df = corpus
    got = {r.id: r for r in sentencepiece_fst.pieces(clashing(df)).collect()}
    for doc, text, *_ in rows:
        assert np.frombuffer(got[doc].ids, "<i4").tolist() == library.encode(text or "") and got[doc].decoded == (text or "")
    digests = sentencepiece_fst.piece_digests(df).collect()
    assert len(digests) == len(rows) and all(r.round_trip for r in digests)
    assert {(r.id, r.n_pieces, r.ids_crc32) for r in digests} == {(r.id, len(r.ids) // 4, zlib.crc32(r.ids)) for r in got.values()}
    assert sentencepiece_fst.piece_digests(nothing).count() == 0


# 3 quality classifier


def test_classifier_separates_grades_and_keeps_rows(spark, nothing):
    rng = random.Random(8)
    docs, labels = [], []
    for k in range(900):
        text, grade = prose(rng, 80), k % 3
        if grade == 0:
            text = [f"{w}%%%" for w in text]
        if grade == 1:
            text[10:14] = ["nastyword"] * 4
        docs.append((k, " ".join(text), "en", "s", 1))
        if k < 600:
            labels.append((k, int(grade > 0), int(grade == 1)))
    docs += [(900, None, None, None, None), (901, "", "en", "s", 0), (0, docs[0][1], "en", "s", 1)]
    df = spark.createDataFrame(docs, DOCS)
    rated = spark.createDataFrame([*labels, (None, 1, 0), (7, None, None)], "doc_id bigint, quality int, toxic int")
    got = quality_classifier.scored(clashing(df), rated)
    assert got.columns[: len(clashing(df).columns)] == clashing(df).columns
    rows = got.collect()
    assert len(rows) == len(docs)
    held = [r for r in rows if 600 <= r.doc_id < 900]
    assert sum(r["_kept"] == (r.doc_id % 3 == 2) for r in held) > 0.95 * len(held)
    mean = [np.mean([r["_expected_grade"] for r in held if r.doc_id % 3 == g]) for g in range(3)]
    assert mean[0] < mean[1] < mean[2]
    assert all(r["_p_top"] == 0 and not r["_kept"] for r in rows if r.doc_id in (900, 901))
    assert quality_classifier.scored(nothing, rated).count() == 0
    assert all(r["_kept"] for r in quality_classifier.scored(df.where("doc_id < 3"), rated.limit(0)).collect())


def test_few_toxic_words_count_in_long_texts(spark):
    rng = random.Random(3)
    docs, labels = [], []
    for k in range(600):
        text, toxic = prose(rng, 1200, 5000), k % 6 == 0
        if toxic:
            text[rng.randrange(1200)] = f"nasty{rng.randrange(8)}"
        docs.append((k, " ".join(text), "en", "s", 1))
        if k < 420:
            labels.append((k, 1, int(toxic)))
    df, rated = spark.createDataFrame(docs, DOCS), spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")
    held = quality_classifier.scored(df, rated).where("doc_id >= 420").select("doc_id", "_p_top").collect()
    toxic, good = ([r["_p_top"] for r in held if (r.doc_id % 6 == 0) == t] for t in (True, False))
    assert np.mean([t < g for t in toxic for g in good]) > 0.75


# 4 language


def test_language_on_held_out_rows(spark, nothing):
    rng = random.Random(2)
    letters = {"aa": "abcdef", "bb": "defghé", "cc": "xyzabß"}
    rows = []
    for k in range(600):
        lang = rng.choice(list(letters))
        rows.append((k, " ".join("".join(rng.choice(letters[lang]) for _ in range(5)) for _ in range(30)), lang, "s", 1))
    rows += [(600, None, "aa", "s", 0), (601, "12 34 !", "aa", "s", 0), (602, rows[0][1], None, "s", 0), (603, "", None, "s", 0), (605, "½ ² ① Ⅷ ٣", None, "s", 0), rows[1]]
    df = spark.createDataFrame(rows, DOCS)
    model = language_id.train(df, F.col("doc_id") % 4 != 2)
    got = language_id.identified(clashing(df), model).collect()
    assert len(got) == len(rows)
    truth = {r[0]: r[2] for r in rows}
    held = [r for r in got if r.doc_id % 4 == 2 and r.doc_id < 600]
    assert sum(r.lang_pred == truth[r.doc_id] for r in held) >= 0.97 * len(held)
    assert all(0 <= r.score <= 1 for r in got)
    assert {(r.doc_id, r.lang_pred, r.score) for r in got if r.doc_id in (600, 601, 603, 605)} == {(k, "und", 0.0) for k in (600, 601, 603, 605)}
    assert next(r for r in got if r.doc_id == 602).lang_pred == rows[0][2]
    assert (model.weights == 0).mean() > 0.5 and model.temperature > 0
    none = language_id.train(nothing, F.lit(True))
    assert {r.lang_pred for r in language_id.identified(df.limit(5), none).collect()} == {"und"}
    assert language_id.identified(nothing, model).count() == 0


# 5 Jaccard join


def components(rows, percent: int = 80):
    sets = []
    for doc, text, *_ in rows:
        found = WORD.findall(lowered(text or ""))
        sets.append((doc, {tuple(found[i : i + 5]) for i in range(len(found) - 4)} if len(found) >= 5 else {tuple(found)} - {()}))
    root = list(range(len(sets)))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for a in range(len(sets)):
        for b in range(a):
            x, y = sets[a][1], sets[b][1]
            if x and y and 100 * len(x & y) >= percent * len(x | y):
                root[find(a)] = find(b)
    least = defaultdict(lambda: 1 << 60)
    for k, (doc, s) in enumerate(sets):
        if doc is not None:
            least[find(k)] = min(least[find(k)], doc)
    named = lambda x: None if x == 1 << 60 else x
    return sorted(((doc, len(s), named(least[find(k)]) if s else doc) for k, (doc, s) in enumerate(sets)), key=str)


def test_jaccard_links_through_rows_without_an_id(spark):
    rng = random.Random(8)
    base = prose(rng, 120)
    steps = [" ".join(base[6 * k :] + [f"new{k}x{j}" for j in range(6 * k)]) for k in range(4)]
    rows = [(5, steps[0]), (None, steps[1]), (9, steps[2]), (None, steps[1]), (None, steps[3]), (None, "alone in the world of words"), (None, "alone in the world of words"), (None, None), (None, "")]
    assert any(c == (9, 116, 5) for c in components(rows))
    got = jaccard_join.similar_components(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)).collect()
    assert sorted(((r.id, r.n_shingles, r.component_id) for r in got), key=str) == components(rows)


@pytest.mark.parametrize("many, group, rounds, frequent", [(16, 64, 4, 8), (2, 3, 1, 2), (1000, 64, 4, 1000), (2, 8, 0, 2)])
def test_jaccard_components_do_not_depend_on_bounds(corpus, monkeypatch, many, group, rounds, frequent):
    rows, df = corpus
    monkeypatch.setattr(jaccard_join, "MANY", many)
    monkeypatch.setattr(jaccard_join, "FREQUENT_IN_BATCH", frequent)
    got = jaccard_join.similar_components(clashing(df).drop("id"), group_size=group, rounds=rounds).collect()
    assert sorted(((r.id, r.n_shingles, r.component_id) for r in got), key=str) == components(rows)


def test_jaccard_of_nothing(nothing, spark):
    assert jaccard_join.similar_components(nothing).count() == 0
    lone = spark.createDataFrame([(3, None), (4, ""), (5, "a b")], "doc_id bigint, text string")
    assert sorted(map(tuple, jaccard_join.similar_components(lone).collect())) == [(3, 0, 3), (4, 0, 4), (5, 1, 5)]


# 6 decontamination


def slow_tiles(doc: list[str], item: list[str], least: int) -> int:
    """Greedy string tiling as it is defined: the longest unmarked match first."""
    used_d, used_i = [False] * len(doc), [False] * len(item)
    while True:
        best = (0, 0, 0)
        for a in range(len(doc)):
            for b in range(len(item)):
                n = 0
                while a + n < len(doc) and b + n < len(item) and doc[a + n] == item[b + n] and not used_d[a + n] and not used_i[b + n]:
                    n += 1
                if n > best[0]:
                    best = (n, a, b)
        n, a, b = best
        if n < least:
            return sum(used_i)
        for j in range(n):
            used_d[a + j] = used_i[b + j] = True


def test_tiling_against_brute_force(spark, nothing):
    rng = random.Random(6)
    items = [prose(rng, rng.randrange(3, 40), 12) for _ in range(25)] + [["alone"]]
    docs = []
    for _ in range(60):
        item = rng.choice(items)
        cut = rng.randrange(len(item) + 1)
        moved = item[cut:] + (prose(rng, 3) if rng.random() < 0.5 else []) + item[:cut]
        docs.append([*prose(rng, rng.randrange(30), 12), *moved, *prose(rng, rng.randrange(30), 12)])
    table = spark.createDataFrame([(k, shouted(" ".join(d)).replace(" ", ", "), "en", "s", 1) for k, d in enumerate(docs)] + [(98, None, None, None, None), (99, "", "", "", 0)], DOCS)
    bench = spark.createDataFrame([(k, " ".join(i)) for k, i in enumerate(items)] + [(200, None), (201, ""), (202, " ".join(items[0]))], "item_id bigint, text string")
    want = {}
    for k, d in enumerate(docs):
        for j, i in [*enumerate(items), (202, items[0])]:
            n = slow_tiles(d, i, min(5, len(i)))
            if 100 * n >= 80 * len(i):
                want[k, j] = n
    for block in (decontamination.BLOCK_BYTES, 600):
        got = decontamination.benchmark_hits(clashing(table), bench, block_bytes=block)
        assert got.columns == [*clashing(table).columns, "_hits"]
        rows = got.collect()
        assert len(rows) == 62
        assert {(r.doc_id, h.item_id): h.covered for r in rows for h in r["_hits"]} == want
    kept = {r.doc_id for r in decontamination.decontaminated(table, bench).collect()}
    assert kept == ({*range(60), 98, 99} - {k for k, _ in want})
    assert decontamination.benchmark_hits(nothing, bench).count() == 0
    assert decontamination.decontaminated(table, bench.limit(0)).count() == 62


# 7 token output


def test_a_query_hands_on_one_link_of_a_group():
    rng = np.random.default_rng(3)
    base = rng.integers(-2**62, 2**62, 60)

    def edited(n):
        return np.sort(np.concatenate((base[n:], rng.integers(-2**62, 2**62, n))))

    members, asking = [edited(int(n)) for n in rng.integers(0, 6, 40)], [edited(int(n)) for n in rng.integers(0, 25, 30)]
    left, right = (pa.table({name: list(range(at, at + len(x))), tokens: pa.array([t.tolist() for t in x], pa.list_(pa.int64()))})
                   for name, tokens, at, x in (("cls", "tokens", 100, asking), ("member", "held", 0, members)))
    got = jaccard_join._first_links(80)(left, right).to_pylist()
    links = {100 + k: [m for m, t in enumerate(members) if 100 * len(np.intersect1d(q, t)) >= 80 * len(np.union1d(q, t))] for k, q in enumerate(asking)}
    assert 0 < len(got) < len(asking) and got == [{"a": q, "b": met[0]} for q, met in links.items() if met]


def test_token_writer_holds_a_slice_of_a_batch(monkeypatch):
    held, whole = [], token_output.encoded
    monkeypatch.setattr(token_output, "TOGETHER", 1000)
    monkeypatch.setattr(token_output, "encoded", lambda texts, name: held.append(sum(map(len, texts))) or whole(texts, name))
    monkeypatch.setattr("pyspark.TaskContext.get", lambda: type("Task", (), {"partitionId": lambda self: 0})())
    batch = pa.record_batch({"id": list(range(50)), "text": ["some words " * 10] * 50})
    shards = list(token_output._writer(token_output.TOKENIZER, 2, 1 << 20)(iter([batch])))
    assert sum(len(s.column(1)[0]) for s in shards) == 50 and max(held) <= 1000


def test_token_files_round_trip(spark, corpus, nothing, tmp_path):
    rows, df = corpus
    rows = [r for r in rows if r[0] != 5] + [(5, " a  b.,c 'll don't,'s 1.5<|endoftext|> x\x1c. y\n\nz", "en", "s", 1)]
    df = spark.createDataFrame(rows, DOCS).repartition(4)
    path = token_output.write(clashing(df), str(tmp_path / "t"), most=3000, task_bytes=20_000)
    got = sorted(token_output.read(spark, path).collect())
    start, tokenizer = 0, token_output.tokenizer()
    for (doc, text, *_), r in zip(sorted(rows, key=lambda x: x[0]), got):
        ids = np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 2], "<u4")
        assert tuple(r) == (doc, start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
    assert spark.read.parquet(path).count() > 4
    empty = token_output.write(nothing, str(tmp_path / "e"))
    assert token_output.read(spark, empty).count() == 0


@given(st.lists(st.integers(0, 70000), max_size=1500), st.integers(0, 70000))
@settings(max_examples=25, deadline=None)
def test_wavelet_matrix_queries(values, token):
    array = np.array(values, np.uint32)
    _, planes, zeros = token_output.build(array)
    matrix = token_output.WaveletMatrix(len(array), planes, zeros)
    assert matrix.values().tolist() == values
    for i in range(0, len(values), max(1, len(values) // 7)):
        assert matrix.access(i) == values[i]
        places = [k for k, v in enumerate(values) if v == values[i]]
        assert matrix.count(values[i]) == len(places) and matrix.locate(values[i], len(places) - 1) == places[-1]
    assert matrix.count(token) == values.count(token)


# 8 token counts


def test_token_counts_and_cache(spark, corpus, nothing, tmp_path, library, monkeypatch):
    rows, df = corpus
    cache = str(tmp_path / "cache")
    want = sorted((d, len((t or "").encode()), len(library.encode(t or "")), len(library.encode(t or "")) > 4096) for d, t, *_ in rows)
    assert sorted(map(tuple, token_counts.token_counts(clashing(df), cache).collect())) == want
    entries = spark.read.parquet(cache).count()
    assert entries == len({t or "" for _, t, *_ in rows})
    assert sorted(map(tuple, token_counts.token_counts(df, cache).collect())) == want
    assert spark.read.parquet(cache).count() == entries  # nothing new was encoded
    assert token_counts.token_counts(nothing, cache).count() == 0
    other = token_counts.token_counts(df, cache, "byte_bpe_50k.json").collect()
    tokenizer = token_output.tokenizer()
    assert {(r.doc_id, r.n_tokens) for r in other} == {(d, len(tokenizer.encode(t or "").ids)) for d, t, *_ in rows}
    assert spark.read.parquet(cache).count() == 2 * entries


def test_counts_of_awkward_texts(library):
    texts = ["", " ", "a  b", " x", "x ", "▁ ▁", "<s>", "a b c", "\n \n", "é\x00 ü"]
    assert token_counts.counted(texts) == [len(library.encode(t)) for t in texts]


# 9 line dedup


def deduped(rows, least: int = 20, docs: int = 3):
    strip = " \t\n\x0b\x0c\r"
    held = defaultdict(set)
    for doc, text, *_ in rows:
        for line in (text or "").split("\n"):
            if len(key := lowered(line.strip(strip))) >= least:
                held[key].add(doc)
    largest = {k: max(v) for k, v in held.items() if len(v) >= docs}
    out = []
    for doc, text, *_ in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if largest.get(lowered(x.strip(strip)), doc) == doc]
        out.append((doc, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out)


@pytest.mark.parametrize("shard, block", [(1 << 16, 1 << 20), (3, 3), (2, 8)])
def test_line_dedup_against_brute_force(spark, corpus, nothing, shard, block):
    rows, _ = corpus
    rng = random.Random(1)
    lines = [f"  Line number {k} that comes again {k}" for k in range(30)]
    more = [(200 + k, "\n".join(rng.choice(lines) for _ in range(rng.randrange(1, 9))), "en", "s", 1) for k in range(80)]
    # Two documents hold a line in three rows; three documents hold another in four.
    twice, thrice = "held by two documents in three rows", "held by three documents in four rows"
    more += [(301, twice, "en", "s", 1), (301, f"{twice}\n{thrice}", "en", "s", 1), (300, f"{twice}\n{thrice}", "en", "s", 1), (302, thrice, "en", "s", 1), (302, thrice, "en", "s", 1)]
    every = rows + more
    df = spark.createDataFrame(every, DOCS).repartition(5)
    out = line_dedup.dropped_lines(clashing(df), keys_per_shard=shard, keys_per_block=block)
    assert out.columns[:-2] == clashing(df).columns
    got = sorted((r.doc_id, r["_n_lines"], r["_n_lines"] - r["_n_left"], r.text) for r in out.collect())
    assert got == deduped(every)
    kept = {r.doc_id: r.text for r in out.where("doc_id in (300, 302)").collect()}
    assert kept == {300: twice, 302: thrice}
    assert line_dedup.dropped_lines(nothing).count() == 0


def test_perfect_hash_has_one_slot_per_key():
    keys = np.random.default_rng(0).integers(0, 2**63, 5000, dtype=np.uint64)
    _, slots = line_dedup.build(keys)
    assert sorted(slots.tolist()) == list(range(5000))


# 10 language model


def test_language_model_scores(spark, corpus, nothing):
    rows, df = corpus
    teaches = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 != 2
    for size in (lm_scoring.BUCKET_BYTES, 20_000):
        got = lm_scoring.scored(clashing(df).drop("id"), teaches, bucket_bytes=size).collect()
        assert len(got) == len(rows)
        tokens = {d: [*WORD.findall(lowered(t or "")), None] for d, t, *_ in rows}
        count = Counter()
        for d, *_ in rows:  # a repeated row counts each time
            if zlib.crc32(str(d).encode()) % 7 != 2:
                count.update(tokens[d])
        n, v = sum(count.values()), len(count)
        for r in got:
            own = tokens[r.id]
            assert (r.n_tokens, r.n_known, r.train_tokens) == (len(own), sum(count[t] > 0 for t in own), n)
            assert r.base_score == pytest.approx(sum(math.log10((count[t] + 1) / (n + v + 1)) for t in own))
            assert math.isfinite(r.score) and r.score < 0
    assert lm_scoring.scored(nothing, teaches).count() == 0


def test_documents_and_words_travel_packed():
    texts = ["the same words " * 300, "", "Ein Wort\u2028 mehr"] * 10
    docs = {"id": [None, *range(29)], "teaches": [k % 3 == 0 for k in range(30)], "text": texts}
    batch = pa.record_batch({"bucket": [k % 2 for k in range(30)], **docs})
    packs = list(lm_scoring._packs(2)(iter([batch])))
    assert sum(len(p.column(1)[0].as_py()) for p in packs) < sum(map(len, texts)) / 5
    assert [lm_scoring._unpacked_docs(p.column(1)).to_pylist() for p in packs] == [
        [dict(zip(docs, row)) for k, row in enumerate(zip(*docs.values())) if k % 2 == b] for b in range(2)]
    # Every bucket gets the totals of its words over all buckets, in the order of its words.
    rows = [r for b, p in enumerate(packs) for r in lm_scoring._word_rows(1)((pa.scalar(b),), iter([p]))]
    out = [r for batch in lm_scoring._sums((pa.scalar(0),), iter(rows)) for r in batch.to_pylist()]
    count = Counter(t for k, x in enumerate(texts) if k % 3 == 0 for t in lm_scoring._tokens([x])[0].tolist())
    for row in out[:-1]:
        mine = np.unique(lm_scoring._tokens([x for k, x in enumerate(texts) if k % 2 == row["bucket"]])[0])
        assert lm_scoring._widened(row["packed"], 1)[0].tolist() == [count[w] for w in mine.tolist()]
    assert [r["bucket"] for r in out] == [0, 1, -1]


@given(st.lists(st.tuples(*[st.integers(0, 2**31 - 1)] * 4), max_size=40))
@settings(max_examples=40, deadline=None)
def test_packed_grams_come_back(rows):
    gram = np.array(rows, np.int64).reshape(-1, 4).T
    gram = gram[:, np.argsort(gram[2], kind="stable")]
    assert (lm_scoring._unpacked(lm_scoring._packed(gram), 4) == gram).all()


def test_log_bilinear_probabilities_sum_to_one_and_learn():
    rng = np.random.default_rng(0)
    n = 20
    unigram = np.full(n, 1 / n)
    context = rng.integers(0, n, 4000)
    gram = (context * lm_scoring.VOCABULARY + context) * lm_scoring.VOCABULARY + (context + 1) % n
    keys, times = np.unique(gram, return_counts=True)
    model = lm_scoring.LogBilinear.start(unigram)
    model.train(keys, times, unigram, 300, 1)
    c = np.repeat(np.array([3 * lm_scoring.VOCABULARY + 3]), n)
    p = np.exp(model.log_probabilities(c, np.arange(n)))
    assert p.sum() == pytest.approx(1, abs=1e-4) and p.argmax() == 4
    again = lm_scoring.LogBilinear.unpacked(model.packed(), n)
    assert (again.target == model.target).all()


def test_vocabulary_follows_the_data(spark, monkeypatch):
    monkeypatch.setattr(lm_scoring, "PART_GRAMS", 500)
    rows = [(k, " ".join(f"w{(15 * k + j) % 900}" for j in range(300)) + f" rare{k}", "en", "s", 1) for k in range(60)]
    docs = spark.createDataFrame(rows, DOCS)
    totals = spark.createDataFrame([(int(w), int(c)) for w, c in zip(*np.unique(lm_scoring._tokens([r[1] for r in rows])[0], return_counts=True))],
                                   "word bigint, total bigint")
    keys, number, model, unigram, _ = lm_scoring.train(docs.select("text"), totals)
    assert len(keys) == 901 and sorted(number) == [0, *range(2, 902)] and unigram.sum() == pytest.approx(1)
    for before in (5, 700):
        p = np.exp(model.log_p(np.full(902, before), np.full(902, before + 1), np.arange(902)))
        assert p.sum() == pytest.approx(1, abs=1e-3)
    got = lm_scoring.scored(docs, F.col("doc_id") < 50).where("id >= 50").agg(F.sum("base_score"), F.sum("score")).first()
    assert got[1] > 0.9 * got[0]


# pipeline


def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline

    rng = random.Random(5)
    bench = " ".join(prose(rng, 30))
    rows = []
    for k in range(240):
        text = prose(rng, 90, 3000)
        rows.append([k, " ".join(text), "en", "s", 1])
    for k in range(0, 60):
        rows[k][1] = " ".join(f"{w}%%%" for w in rows[k][1].split())
    # Copies in lines too short to be dropped, and a text that is one repeated line.
    pairs = rows[100][1].split()
    rows[100][1] = "\n".join(" ".join(pairs[k : k + 2]) for k in range(0, len(pairs), 2))
    for k in range(60, 64):
        rows[k][1] = rows[100][1]
    for k in (220, 221, 222):
        rows[k][1] = rows[222][1]
    rows[200][1] += " " + bench
    for k in (210, 211, 212):
        rows[k][1] += "\nThis very line is shared by three documents"
    rows[213][1] = "This very line is shared by three documents"
    rows.append([240, None, None, None, None])
    rows.append([None, rows[100][1], "en", "s", 1])
    spark.createDataFrame([tuple(r) for r in rows], DOCS).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(k, int(k >= 60), 0) for k in range(0, 240, 2)], "doc_id bigint, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(0, bench)], "item_id bigint, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs, seen = spark.read.parquet(str(tmp_path / "documents.parquet")), []
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, str(tmp_path)).cache()
        seen.append(docs)
        if stage is not corpus_pipeline.tokens:
            assert docs.columns == list(corpus_pipeline.COLUMNS)
    ids = [{r.doc_id for r in d.select("doc_id").collect()} for d in seen]
    assert not ids[0] & {*range(60), 240} and len(ids[0]) > 170
    texts = {r.doc_id: r.text for r in seen[1].collect()}
    assert [("shared by" in texts[k]) for k in (210, 211, 212)] == [False, False, 213 not in ids[0]] and ids[1] == ids[0]
    assert all(d.where("doc_id IS NULL").count() == seen[0].where("doc_id IS NULL").count() for d in seen[1:4])
    same = sorted(k for k in (60, 61, 62, 63, 100) if k in ids[1])
    assert len(same) > 2 and ids[1] - ids[2] == set(same[1:])
    emptied = {k for k in (220, 221, 222) if k in ids[0]}
    assert {k for k in emptied if not texts[k]} == emptied - {max(emptied)} and len(emptied) == 3
    assert ids[2] - ids[3] == {200}
    assert all(r.round_trip for r in seen[4].collect()) and ids[4] == ids[3]
    assert {r.doc_id for r in corpus_pipeline.run(spark, str(tmp_path)).collect()} == ids[4]


