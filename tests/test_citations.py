"""Citations kept by matrix products, and bigram lists of Arrow batches, against the column expressions."""

import random

from pyspark.sql import functions as F

from gleanery.functions import text
from gleanery.operators import evidence


def test_kept_places_equal_the_expression(spark, monkeypatch):
    rng = random.Random(5)
    base = ["".join(rng.choice("abcd\U0001f600é") for _ in range(n)) for n in (0, 1, 2, 5, 30, 40)]
    rows = []
    for n in range(120):
        entries = []
        for place in range(rng.randrange(0, 14)):
            key = rng.choice(base)
            if key and rng.random() < 0.6:
                cut = rng.randrange(len(key))
                key = key[:cut] + rng.choice("xyz") + key[cut + 1:]
            entries.append((place, rng.choice(["p", "q", None]), None if rng.random() < 0.05 else key[: rng.choice([3, 99])]))
        rows.append((n, entries))
    df = spark.createDataFrame(rows, "n int, d array<struct<place: int, page: string, key: string>>")
    details = F.transform("d", lambda d: F.struct(d["place"], d["page"], d["key"], text.bigrams(d["key"]).alias("grams")))
    wanted = {r["n"]: r["k"] for r in df.select("n", F.transform(evidence.dedupe(details), lambda d: d["place"]).alias("k")).collect()}
    got = evidence.deduped(df.withColumn("details", details)).select("n", F.transform("details", lambda d: d["place"]).alias("k"))
    assert {r["n"]: r["k"] for r in got.collect()} == wanted
    monkeypatch.setattr(evidence, "CHUNK", 3)
    for n, entries in rows:
        assert evidence.kept_places([e[1] for e in entries], [e[2] for e in entries]) == wanted[n]


def test_bigram_lists_and_keys(spark):
    values = [["ab", "", None, "a\U0001f600b\U0001f600b", "aaaa"], None, [], ["Ça & là — «5»", "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~\t\x0b x", " y　"]]
    df = spark.createDataFrame([(v,) for v in values], "v array<string>")
    plain = F.transform("v", lambda k: F.array_sort(text.bigrams(k)))
    for row in df.select(text.bigrams_each("v").alias("a"), plain.alias("b"), F.transform("v", text.identity_from_nfkc).alias("k")).collect():
        assert row["a"] == row["b"]
    assert row["k"] == ["çalà5", "x", "y"]
