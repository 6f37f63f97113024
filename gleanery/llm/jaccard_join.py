"""Exact Jaccard self-join on word shingles with a token-group matrix.

1. Documents with the same shingle set are one class; only classes are compared.
2. A class is found by its *probe tokens*: of n shingles in one global order it takes the first n - ceil(t n) + 1.  Two
   classes with a similarity of t or more share a probe token in any order.  Shingles that are frequent in some task come
   last, so that common passages are hardly ever probe tokens; which ones those are changes the cost, never the result.
3. Similar classes are gathered into groups first.  At every probe token that many classes share, a class meets one other
   class from the heaviest component there: in one round that with the largest share of frequent shingles, which the original of
   many edited copies has, in the next one picked at random; one such meeting a component and round is
   compared, the one that most tokens propose.  The links found give provisional components, so a large group of near copies is joined with a few
   comparisons per member.  Groups are pieces of at most about ``group_size`` classes of one component.
4. The matrix holds (token, group) with the least place and size of a member.  Only classes of *another* component are
   queries to a group; the smaller component asks.  A query opens a group only if
   - the sizes fit,
   - for a group of one class, the probe tokens shared so far and the shingles left after the last of them allow the overlap,
     and so do the parities of both sets (see ``parities``), which are far smaller than the sets.  Only shared tokens with no
     less than the overlap from their own place on in both sets are looked at, as the first shared one always is such a token,
     and none whose places alone rule the overlap out,
   - for a larger group, it has a probe token in common with a member.
5. A query is compared exactly with all members of an opened group in one step over the group's sorted tokens, a slice of its
   queries at a time.  It hands on the first link, which is enough, as the members are connected; all links give the components.

No pair of different classes in different provisional components escapes steps 4 and 5, hence the components are exact.
Shingles are 64-bit hashes and classes 64-bit digests of their sets (see ``words``).

Nulls, empty texts and texts without words have an empty set and link with nothing.  A text with fewer words than a shingle
has its whole sequence as its one shingle.  Repeated ids are each a row of their own.  A null id links like any other: such rows
carry a stand-in from their text on the way, return a null id, and a null component if no row with an id is reachable.  Extra
columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleanery.llm import words as W
from gleanery.operators.components import connected_components
from gleanery.session import stored

SHINGLE = 5
PERCENT = 80
GROUP_SIZE = 64
# Queries that meet a group in one call, about.
QUERIES = 256
ROUNDS = 4
MEETINGS = 1
# Tokens of more classes than this gather groups first; all others go straight to the matrix.
MANY = 64
# Tokens by which a class meets others while groups are gathered: the first frequent ones in its order.
MEETING_TOKENS = 8
# Ids that are broadcast at most (16 bytes each); beyond, texts are fetched by a shuffled join.
BROADCAST_IDS = 1_000_000
# A shingle in so many classes of one batch is reported; the most frequent ones of all batches are put last (8 MB at most).
FREQUENT_IN_BATCH = 2
MOST_FREQUENT = 1 << 20
# Stand-ins for null ids begin here; given ids are smaller.
NO_ID = 1 << 62
# Characters of text that are hashed together.
WINDOW = 2_000_000
_SHORT = np.uint64(0xA5A5A5A5DEADBEEF)


def shingle_sets(texts: list, size: int = SHINGLE) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text; texts are hashed together up to ``WINDOW`` characters."""
    at = 0
    while at < len(texts):
        to, held = at, 0
        while to < len(texts) and (to == at or held < WINDOW):
            held += len(texts[to] or "")
            to += 1
        hashed, first = W.word_hashes(texts[at:to])
        every = W.windows(hashed, size)
        for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
            if b - a >= size:
                yield np.unique(every[a : b - size + 1])
            elif b > a:
                with np.errstate(over="ignore"):
                    yield W.mix(np.array([(hashed[a:b] * W.STEP[10 : 10 + b - a]).sum(dtype=np.uint64) + _SHORT * W.U64(b - a)], np.uint64))
            else:
                yield every[:0]
        at = to


def digest(tokens: np.ndarray) -> int:
    """64 bits of a set, whatever its order."""
    with np.errstate(over="ignore"):
        total = tokens.sum(dtype=np.uint64) + W.mix(tokens ^ W.U64(0x5851F42D4C957F2D)).sum(dtype=np.uint64) * W.STEP[30]
        return int(W.mix(np.array([total + W.U64(len(tokens))], np.uint64)).view(np.int64)[0])


def parities(tokens: np.ndarray) -> np.ndarray:
    """Whether an odd number of tokens falls on each of 2,048 places, as 32 words.

    A token in one of two sets only changes one place, so places that differ are at most as many as such tokens.
    """
    odd = np.bincount((tokens >> W.U64(53)).astype(np.int64), minlength=2048) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def needed(n: int, percent: int) -> int:
    """Least overlap of a set of n with any set that it links with."""
    return -(-n * percent // 100)


def _first_pass(size: int) -> Callable:
    schema = pa.schema([("id", pa.int64()), ("n", pa.int64()), ("cls", pa.int64()), ("odd", pa.list_(pa.int64())), ("token", pa.int64()), ("times", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_pylist()
            sizes, keys, odd, seen, held = [], [], [], set(), []
            for tokens in shingle_sets(batch.column(1).to_pylist(), size):
                sizes.append(len(tokens))
                keys.append(digest(tokens) if len(tokens) else None)
                odd.append(parities(tokens) if len(tokens) else None)
                if len(tokens) and keys[-1] not in seen:
                    seen.add(keys[-1])
                    held.append(tokens)
            none = [None] * len(ids)
            ids, sizes, keys, none = (pa.array(x, pa.int64()) for x in (ids, sizes, keys, none))
            yield pa.RecordBatch.from_arrays([ids, sizes, keys, pa.array(odd, pa.list_(pa.int64())), none, none], schema=schema)
            if held:
                every = np.sort(np.concatenate(held))
                edge = np.flatnonzero(np.concatenate(([True], every[1:] != every[:-1], [True])))
                times = np.diff(edge)
                often = times >= FREQUENT_IN_BATCH
                token, times = every[edge[:-1][often]].view(np.int64), times[often]
                none = pa.nulls(len(token), pa.int64())
                yield pa.RecordBatch.from_arrays([none, none, none, pa.nulls(len(token), pa.list_(pa.int64())), pa.array(token), pa.array(times)], schema=schema)

    return run


def _probe_pass(size: int, percent: int, frequent) -> Callable:
    schema = pa.schema([("token", pa.int64()), ("cls", pa.int64()), ("n", pa.int64()), ("pos", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = frequent.value
        for batch in batches:
            seen, parts, keys, sizes = set(), [], [], []
            for tokens in shingle_sets(batch.column(0).to_pylist(), size):
                if not len(tokens) or (key := digest(tokens)) in seen:
                    continue
                seen.add(key)
                if len(last):
                    at = np.minimum(np.searchsorted(last, tokens), len(last) - 1)
                    common = last[at] == tokens
                    tokens = np.concatenate((tokens[~common], tokens[common]))
                n = len(tokens)
                parts.append(tokens[: n - needed(n, percent) + 1])
                keys.append(key)
                sizes.append(n)
            if parts:
                count = [len(p) for p in parts]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(parts).view(np.int64)), pa.array(np.repeat(np.array(keys, np.int64), count)),
                     pa.array(np.repeat(np.array(sizes, np.int64), count)), pa.array(np.concatenate([np.arange(c) for c in count]))],
                    schema=schema)

    return run


def _set_pass(size: int, frequent) -> Callable:
    """Class, set, and how many of a thousand shingles are frequent."""
    schema = pa.schema([("cls", pa.int64()), ("tokens", pa.list_(pa.int64())), ("common", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = frequent.value
        for batch in batches:
            sets = list(shingle_sets(batch.column(0).to_pylist(), size))
            offsets = np.zeros(len(sets) + 1, np.int32)
            np.cumsum([len(s) for s in sets], out=offsets[1:])
            flat = np.concatenate([*sets, np.empty(0, np.uint64)]).view(np.int64)
            lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))
            common = [int(np.isin(s, last, assume_unique=True).sum()) * 1000 // max(1, len(s)) for s in sets]
            yield pa.RecordBatch.from_arrays([pa.array([digest(s) for s in sets], pa.int64()), lists, pa.array(common, pa.int64())], schema=schema)

    return run


def _linked(a: Column, b: Column, percent: int) -> Column:
    both = F.size(F.array_intersect(a, b))
    return both * 100 >= (F.size(a) + F.size(b) - both) * percent


def _fits(a: Column, b: Column, percent: int) -> Column:
    return (F.least(a, b) * 100 >= F.greatest(a, b) * percent)


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The (a, b) whose sets link."""
    left = sets.select(F.col("cls").alias("a"), F.col("tokens").alias("ta"))
    right = sets.select(F.col("cls").alias("b"), F.col("tokens").alias("tb"))
    return pairs.join(left, "a").join(right, "b").where(_linked(F.col("ta"), F.col("tb"), percent)).select("a", "b")


def _first_links(percent: int) -> Callable:
    """Of one group: each query with the first member that it links with, if any.

    Members of a group are connected already, so one link connects a query with all of them.
    """
    def run(queries: pa.Table, members: pa.Table) -> pa.Table:
        a, b = [], []
        if queries.num_rows and members.num_rows:
            lists, name = members["held"].combine_chunks(), members["member"].to_numpy()
            size = lists.value_lengths().to_numpy()
            flat, owner = lists.flatten().to_numpy(), np.repeat(np.arange(len(size)), size)
            order = np.argsort(flat)
            flat, owner = flat[order], owner[order]
            for cls, tokens in zip(queries["cls"].to_pylist(), queries["tokens"]):
                tokens = tokens.values.to_numpy()
                low = np.searchsorted(flat, tokens)
                times = np.searchsorted(flat, tokens, "right") - low
                at = np.repeat(low - (np.cumsum(times) - times), times) + np.arange(times.sum())
                both = np.bincount(owner[at], minlength=len(size))
                linked = np.flatnonzero(both * 100 >= (len(tokens) + size - both) * percent)
                if len(linked):
                    a.append(cls), b.append(int(name[linked[0]]))
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return run


def _components(links: DataFrame, nodes: DataFrame) -> DataFrame:
    """(cls, comp) of every node."""
    found = connected_components(links).select(F.col("node").alias("cls"), "component")
    return nodes.select("cls").distinct().join(found, "cls", "left").select("cls", F.coalesce("component", "cls").alias("comp"))


def _sets(texts: DataFrame, classes: DataFrame, wanted: DataFrame, size: int, frequent) -> DataFrame:
    """(cls, tokens, common) of the wanted classes, each read from one of its documents."""
    ids = stored(wanted.join(classes, "cls").select("id"), "wanted")
    ids = F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids
    # Rows that repeat an id may give a set twice, which only repeats a comparison.
    return stored(texts.join(ids, "id", "left_semi").select("text").mapInArrow(W.released(_set_pass(size, frequent)), "cls bigint, tokens array<bigint>, common bigint"), "sets")


def similar_components(
    docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", shingle: int = SHINGLE, percent: int = PERCENT,
    group_size: int = GROUP_SIZE, rounds: int = ROUNDS,
) -> DataFrame:
    """(id, n_shingles, component_id): size of each document's set and the smallest id reachable by links."""
    spark = docs.sparkSession
    text = F.col(text_column).cast("string")
    stand_in = F.lit(NO_ID) + F.shiftrightunsigned(F.xxhash64(text), 2)
    texts = docs.select(F.coalesce(F.col(id_column).cast("bigint"), stand_in).alias("id"), text.alias("text"))
    first = stored(texts.mapInArrow(W.released(_first_pass(shingle)), "id bigint, n bigint, cls bigint, odd array<bigint>, token bigint, times bigint"), "shingles")
    members = first.where("token is null").select("id", "n", "cls")
    top = first.where("token is not null").groupBy("token").agg(F.sum("times").alias("times")).where(
        F.col("times") > MANY // 2).orderBy(F.desc("times"), "token").limit(MOST_FREQUENT)
    frequent = spark.sparkContext.broadcast(np.sort(np.array(top.select("token").toArrow().column(0).to_pylist(), np.int64).view(np.uint64)))

    probes = texts.select("text").mapInArrow(W.released(_probe_pass(shingle, percent, frequent)), "token bigint, cls bigint, n bigint, pos bigint")
    # Copies in other batches count as well; a token of one class alone is of no use later on and does no harm.
    met = probes.groupBy("token").agg(F.count("*").alias("shared")).where("shared > 1")
    rows = stored(probes.join(met, "token").distinct(), "probes")
    classes = members.where("cls is not null").groupBy("cls").agg(F.min("id").alias("id"))
    nodes = stored(rows.select("cls").distinct(), "nodes")

    state, links = nodes.withColumn("comp", F.col("cls")), None
    first_ones = F.row_number().over(Window.partitionBy("cls").orderBy("pos"))
    many = stored(rows.where(F.col("shared") > MANY).withColumn("k", first_ones).where(F.col("k") <= MEETING_TOKENS).drop("k"), "meeting")
    sets = _sets(texts, classes, many.select("cls").distinct(), shingle, frequent)
    many = many.join(sets.groupBy("cls").agg(F.max("common").alias("common")), "cls")
    for turn in range(rounds):
        weight = state.groupBy("comp").agg(F.count("*").alias("weight"))
        placed = many.join(state, "cls").join(weight, "comp")
        one = F.struct("cls", "n", "comp")
        order = F.struct("weight", F.lit(0).cast("bigint") if turn % 2 else F.col("common"), F.xxhash64("cls", "token", F.lit(turn)))
        hub = placed.groupBy("token").agg(F.max_by(one, order).alias("hub"))
        own = placed.groupBy("token", "comp").agg(F.max_by(F.struct("cls", "n"), order).alias("own"))
        meets = own.join(hub, "token").where("comp <> hub.comp").where(_fits(F.col("own.n"), F.col("hub.n"), percent))
        pairs = meets.groupBy("comp", F.col("own.cls").alias("a"), F.col("hub.cls").alias("b")).agg(F.count("*").alias("times"))
        best = Window.partitionBy("comp").orderBy(F.desc("times"), F.xxhash64("a", "b"))
        chosen = pairs.withColumn("k", F.row_number().over(best)).where(F.col("k") <= MEETINGS).select("a", "b")
        found = stored(_verified(chosen, sets, percent), "links")
        if found.isEmpty():
            break
        links = found if links is None else links.unionByName(found)
        state = stored(_components(links, nodes), "state")

    placed = rows.join(state, "cls")
    count = state.groupBy("comp").agg(F.count("*").alias("weight"))
    open_tokens = placed.groupBy("token").agg(F.min("comp").alias("x"), F.max("comp").alias("y")).where("x <> y").select("token")
    piece = F.pmod(F.xxhash64("cls"), F.ceil(F.col("weight") / group_size))
    left = stored(placed.join(open_tokens, "token").join(count, "comp").withColumn("piece", piece).drop("shared"), "open")
    matrix = left.groupBy("token", "comp", "weight", "piece").agg(
        F.min("n").alias("low"), F.max("n").alias("high"), F.min("pos").alias("place"))
    queries = left.select("token", "cls", "n", "pos", F.col("comp").alias("own"), F.col("weight").alias("own_weight"))
    after = F.least(F.col("n") - F.col("last"), F.col("low") - F.col("place")) - 1
    # Shared tokens of single classes that may be the first of a link, and whose places allow one.
    least = (F.col("n") + F.col("low")) * percent
    first_of_link = (F.least(F.col("n") - F.col("pos"), F.col("low") - F.col("place")) * (100 + percent) >= least) & (
        (F.least("pos", "place") + F.least(F.col("n") - F.col("pos"), F.col("low") - F.col("place"))) * (100 + percent) >= least)
    asks = (
        queries.join(matrix, "token")
        .where("(own_weight, own) < (weight, comp)")
        .where((F.col("high") * 100 >= F.col("n") * percent) & (F.col("low") * percent <= F.col("n") * 100))
        .where((F.col("weight") > 1) | first_of_link)
        .groupBy("cls", "n", "comp", "piece", "weight")
        .agg(F.count("*").alias("hits"), F.max("pos").alias("last"), F.max("place").alias("place"), F.min("low").alias("low"))
        .where((F.col("weight") > 1) | ((F.col("hits") + after) * (100 + percent) >= least))
        .select("cls", "n", "comp", "piece", "weight", "low")
    )
    asks = stored(asks, "asks")
    # A component of one class is named after it.
    pairs = asks.where("weight = 1").select(F.col("cls").alias("a"), F.col("comp").alias("b"), "n", F.col("low").alias("m"))
    mine = pairs.select(F.explode(F.array("a", "b")).alias("cls")).distinct()
    odd = first.where("cls is not null").select("cls", "odd").join(mine, "cls").groupBy("cls").agg(F.any_value("odd").alias("odd"))
    differ = F.aggregate(F.zip_with("oa", "ob", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda t, x: t + x)
    overlap = F.ceil((F.col("n") + F.col("m")) * percent / F.lit(100 + percent) - 1e-9)
    lone = stored(
        pairs.join(odd.select(F.col("cls").alias("a"), F.col("odd").alias("oa")), "a").join(odd.select(F.col("cls").alias("b"), F.col("odd").alias("ob")), "b")
        .where(differ <= F.col("n") + F.col("m") - 2 * overlap).select("a", "b"), "pairs")
    asks = asks.where("weight > 1")
    inside = left.where("weight > 1").select("cls", F.col("n").alias("m"), "comp", "piece").distinct()
    inside = stored(inside.join(asks.select("comp", "piece").distinct(), ["comp", "piece"]), "members")
    compared = lone.select(F.explode(F.array("a", "b")).alias("cls")).unionByName(asks.select("cls")).unionByName(inside.select("cls"))
    sets = _sets(texts, classes, compared.distinct(), shingle, frequent)
    # A piece holds about group_size members and a slice about QUERIES queries, so what meets in one call is bounded.
    slices = asks.groupBy("comp", "piece").agg(F.ceil(F.count("*") / QUERIES).alias("slices"))
    asking = asks.join(slices, ["comp", "piece"]).select("cls", "comp", "piece", F.pmod(F.xxhash64("cls"), "slices").alias("slice")).join(sets, "cls")
    asked = inside.join(slices, ["comp", "piece"]).select("cls", "comp", "piece", F.explode(F.sequence(F.lit(0), F.col("slices") - 1)).alias("slice"))
    group = ["comp", "piece", "slice"]
    asked = asked.join(sets, "cls").select(*[F.col(c).alias(c) for c in group], F.col("cls").alias("member"), F.col("tokens").alias("held"))
    opened = asking.select(*group, "cls", "tokens").groupBy(group).cogroup(asked.groupBy(group)).applyInArrow(
        _first_links(percent), "a bigint, b bigint")
    found = stored(opened.unionByName(_verified(lone, sets, percent)), "links")
    final = _components(found if links is None else links.unionByName(found), nodes)

    placed = classes.join(final, "cls", "left").withColumn("comp", F.coalesce("comp", "cls"))
    least = placed.groupBy("comp").agg(F.min("id").alias("component"))
    named = placed.join(least, "comp").select("cls", "component")
    given = lambda c: F.when(c < NO_ID, c)
    return members.join(named, "cls", "left").select(
        given(F.col("id")).alias("id"), F.col("n").alias("n_shingles"), given(F.coalesce("component", "id")).alias("component_id"))
