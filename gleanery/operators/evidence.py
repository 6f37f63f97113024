"""Evidence details, per-item de-duplication and distinct counts."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType

from gleanery.functions import text, urls
from gleanery.functions.binding import bind, let
from gleanery.operators.similarity import prefix_index
from gleanery.session import stored

SAME_PAGE, OTHER_PAGE, MIN_QUOTE = 0.82, 0.95, 24


def detail(df: DataFrame, policy: urls.TrustPolicy, column: str = "evidence", into: str = "details") -> DataFrame:
    """Adds an array with rank, page key, quote key and bigrams of every citation.

    The rank sorts by authority, then quote length, then position.
    """
    quotes = F.transform(column, lambda e: e["quote"])
    keyed = bind(df.withColumn("_nfkc", text.nfkc_each(quotes)), _keys=F.transform("_nfkc", text.identity_from_nfkc)).drop("_nfkc")
    sets = keyed.withColumn("_grams", text.bigrams_each("_keys"))

    def describe(entry: Column, i: Column) -> Column:
        return F.struct(
            (-policy.authority(entry["url"])).alias("weak"),
            (-F.length(entry["quote"])).alias("short"),
            i.alias("place"),
            urls.evidence_url(entry["url"]).alias("page"),
            F.col("_keys")[i].alias("key"),
            F.col("_grams")[i].alias("grams"),
            policy.tier(entry["url"]).alias("tier"),
            entry.alias("entry"),
        )

    return bind(sets, **{into: F.transform(column, describe)}).drop("_keys", "_grams")


def _alike(kept: Column, new: Column, threshold: float) -> Column:
    """Dice at or above the threshold; sets of too different size are not intersected."""
    a, b = F.size(kept["grams"]), F.size(new["grams"])
    comparable = F.least(a, b) >= F.greatest(a, b) * (threshold / (2 - threshold)) - 1e-9
    return F.when(comparable, text.dice(new["grams"], kept["grams"]) >= threshold).otherwise(False)


def _repeats(kept: Column, new: Column) -> Column:
    same_text = F.contains(new["key"], kept["key"]) | F.contains(kept["key"], new["key"])
    long_enough = (F.length(new["key"]) >= MIN_QUOTE) & (F.length(kept["key"]) >= MIN_QUOTE)
    return F.when(new["page"] == kept["page"], same_text | _alike(kept, new, SAME_PAGE)).otherwise(
        long_enough & _alike(kept, new, OTHER_PAGE)
    )


def dedupe(details: Column | str) -> Column:
    """Strongest citations first; later ones that repeat a kept one are dropped."""
    given = F.col(details) if isinstance(details, str) else details
    ranked = F.array_sort(given)

    def step(kept: Column, new: Column) -> Column:
        return F.when(F.exists(kept, lambda k: _repeats(k, new)), kept).otherwise(F.concat(kept, F.array(new)))

    return let(ranked, lambda r: F.aggregate(r, F.slice(r, 1, 0), step))


# Citations whose bigram sets are compared in one matrix product.
CHUNK = 512


def kept_places(pages: list[str | None], keys: list[str | None]) -> list[int]:
    """Places that ``dedupe`` keeps of citations given strongest first; sizes of common sets come from matrix products."""
    row, gram = text.key_grams([k or "" for k in keys])
    size = np.bincount(row, minlength=len(keys))
    kept: list[int] = []

    def incidence(places: list[int], columns: np.ndarray) -> np.ndarray:
        matrix = np.zeros((len(places), len(columns)), dtype=np.float32)
        for k, place in enumerate(places):
            low, high = np.searchsorted(row, (place, place + 1))
            at = np.minimum(np.searchsorted(columns, gram[low:high]), len(columns) - 1)
            matrix[k, at[columns[at] == gram[low:high]]] = 1
        return matrix

    def repeats(old: int, new: int, shared: int) -> bool:
        if keys[old] is None or keys[new] is None:
            return False
        alike = 2.0 * shared / (size[old] + size[new]) if shared else 0.0
        if pages[old] is not None and pages[old] == pages[new]:
            return alike >= SAME_PAGE or (shared == min(size[old], size[new]) and (keys[old] in keys[new] or keys[new] in keys[old]))
        return alike >= OTHER_PAGE and min(len(keys[old]), len(keys[new])) >= MIN_QUOTE

    for start in range(0, len(keys), CHUNK):
        fresh = list(range(start, min(start + CHUNK, len(keys))))
        own = slice(*np.searchsorted(row, (fresh[0], fresh[-1] + 1)))
        columns, at = np.unique(gram[own], return_inverse=True)
        mine, likely = np.zeros((len(fresh), max(len(columns), 1)), dtype=np.float32), [[] for _ in fresh]
        mine[row[own] - start, at] = 1
        columns = columns if len(columns) else np.array([-1])
        for low in range(0, len(kept), CHUNK):
            _likely(kept[low:low + CHUNK], incidence(kept[low:low + CHUNK], columns), fresh, mine, size, likely)
        _likely(fresh, mine, fresh, mine, size, likely)
        still = set(kept)
        for place, others in zip(fresh, likely):
            if not any(old in still and repeats(old, place, shared) for old, shared in others):
                kept.append(place)
                still.add(place)
    return kept


def _likely(old: list[int], theirs: np.ndarray, fresh: list[int], mine: np.ndarray, size: np.ndarray, into: list[list[tuple[int, int]]]) -> None:
    """Collects (earlier place, size of the common set) of all pairs that are similar enough or may contain each other."""
    shared = mine @ theirs.T
    a, b = size[fresh][:, None], size[old][None, :]
    x, y = np.nonzero((2.0 * shared >= (SAME_PAGE - 1e-6) * (a + b)) | (shared == np.minimum(a, b)))
    for k, place in zip(x.tolist(), y.tolist()):
        if old[place] < fresh[k]:
            into[k].append((old[place], int(shared[k, place])))


@F.arrow_udf(ArrayType(IntegerType()))
def _kept(pages: pa.Array, keys: pa.Array) -> pa.Array:
    parts = []
    for at in range(0, len(keys), text.SLICE):
        rows = zip(pages.slice(at, text.SLICE).to_pylist(), keys.slice(at, text.SLICE).to_pylist())
        parts.append(pa.array([k if k is None else list(range(len(k))) if len(k) < 2 else kept_places(p, k) for p, k in rows], pa.list_(pa.int32())))
    return pa.concat_arrays(parts) if parts else pa.array([], pa.list_(pa.int32()))


def deduped(df: DataFrame, details: str = "details") -> DataFrame:
    """``dedupe`` of a column, its pairs compared by matrix products."""
    ranked = bind(df, **{details: F.array_sort(details)})
    placed = ranked.withColumn("_kept", _kept(F.col(f"{details}.page"), F.col(f"{details}.key")))
    return placed.withColumn(details, F.transform("_kept", lambda p: F.col(details)[p])).drop("_kept")


def entries(details: Column | str) -> Column:
    return F.transform(details, lambda d: d["entry"])


def page_count(details: Column | str) -> Column:
    return F.size(F.array_distinct(F.transform(details, lambda d: d["page"])))


def best_authority(details: Column | str) -> Column:
    return F.coalesce(-F.array_min(F.transform(details, lambda d: d["weak"])), F.lit(0))


def with_deduped(df: DataFrame, policy: urls.TrustPolicy, trusted_only: bool = False) -> DataFrame:
    """Replaces ``evidence`` by its de-duplicated form and keeps ``details`` of what remains."""
    described = detail(df, policy)
    if trusted_only:
        described = bind(described, details=F.filter("details", lambda d: d["tier"] != "untrusted"))
    reduced = deduped(described)
    return reduced.withColumn("evidence", entries("details"))


SMALL, STRONGEST, ROUNDS = 64, 32, 4


def _pairs(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Nodes that meet under the keys, each pair once."""
    met = left.withColumnRenamed("node", "a").join(right.withColumnRenamed("node", "b"), keys)
    return met.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _conflicts(nodes: DataFrame) -> DataFrame:
    """(strong, weak): citations of one group that repeat each other.

    Candidates share a rare bigram: similar ones by the prefix of their bigram sets, contained ones because the longer holds the
    rarest bigram of the shorter.  Keys of less than two characters have no bigram and meet their whole page.
    """
    sets = nodes.select("node", "g", F.col("d.page").alias("page"), F.col("d.grams").alias("grams"), F.length("d.key").alias("_len"))
    where = sets.select("node", "g", "page")
    apart = prefix_index(sets.where(F.col("_len") >= MIN_QUOTE), OTHER_PAGE).drop("size").join(where, "node").select("node", "g", "gram")
    close = prefix_index(sets, SAME_PAGE).drop("size").join(where, "node")
    rarest = prefix_index(sets, 1.0).drop("size").join(where, "node")
    every = sets.select("node", "g", "page", F.explode("grams").alias("gram"))
    tiny = where.join(sets.where(F.size("grams") == 0).select("node"), "node", "left_semi")
    pairs = (
        _pairs(apart, apart, ["g", "gram"]).unionByName(_pairs(close, close, ["g", "page", "gram"]))
        .unionByName(_pairs(rarest, every, ["g", "page", "gram"])).unionByName(_pairs(tiny, where, ["g", "page"])).distinct()
    )
    x, y = nodes.select(F.col("node").alias("a"), F.col("d").alias("da")), nodes.select(F.col("node").alias("b"), F.col("d").alias("db"))
    met = pairs.join(x, "a").join(y, "b").where(_repeats(F.col("da"), F.col("db")))
    first = F.struct("da", "a") < F.struct("db", "b")
    return met.select(F.when(first, F.col("a")).otherwise(F.col("b")).alias("strong"), F.when(first, F.col("b")).otherwise(F.col("a")).alias("weak"))


def settle(conflicts: DataFrame) -> DataFrame:
    """Nodes that go when conflicts are settled from the strongest node on: a node goes if a stronger one that stays repeats it.

    Each round settles all nodes that no open stronger node repeats, everywhere at once; rounds follow the longest chain of
    conflicts, not the number of nodes.
    """
    open_ones, gone = stored(conflicts, "conflicts"), None
    while not open_ones.isEmpty():
        stays = open_ones.select(F.col("strong").alias("node")).distinct().join(open_ones.select(F.col("weak").alias("node")), "node", "left_anti")
        goes = stored(open_ones.join(stays, open_ones["strong"] == stays["node"], "left_semi").select(F.col("weak").alias("node")).distinct(), "repeats")
        gone = goes if gone is None else gone.unionByName(goes)
        done = goes.unionByName(stays)
        left = open_ones.join(done, open_ones["strong"] == done["node"], "left_anti")
        open_ones = stored(left.join(goes, left["weak"] == goes["node"], "left_anti"), "conflicts")
    return conflicts.select(F.col("weak").alias("node")).limit(0) if gone is None else gone


def union(rows: DataFrame, group: str, small: int = SMALL, strongest: int = STRONGEST, rounds: int = ROUNDS) -> DataFrame:
    """(group, details): the de-duplicated citations of all rows of a group, strongest first.

    The result is that of ``dedupe`` over each whole group.  Exact copies are combined before the shuffle.  Groups of up to
    ``small`` citations are arrays.  In larger ones, which stay spread over tasks, the strongest open citations are settled among
    themselves and drop everything that repeats them; after ``rounds`` rounds, which empty groups of many near copies, the
    conflicts left are found by rare bigrams and settled by strength.  The bounds change the cost, never the result.
    """
    cited = rows.select(F.col(group).alias("g"), F.explode("details").alias("d"))
    distinct = cited.groupBy("g", F.col("d.page").alias("page"), F.col("d.key").alias("key")).agg(F.min("d").alias("d")).select("g", "d")
    distinct = stored(distinct.withColumn("node", F.monotonically_increasing_id()), "citations")
    sizes = distinct.groupBy("g").agg(F.count("*").alias("_n"))
    few = distinct.join(sizes.where(F.col("_n") <= small).select("g"), "g", "left_semi")
    few = few.groupBy("g").agg(F.collect_list("d").alias("details")).select("g", dedupe("details").alias("details"))
    large = sizes.where(F.col("_n") > small).select("g")
    if large.isEmpty():
        return few.withColumnRenamed("g", group)
    rest, kept = stored(distinct.join(large, "g", "left_semi"), "open"), []
    top = Window.partitionBy("g").orderBy("d", "node")
    for _ in range(rounds):
        first = rest.withColumn("_r", F.row_number().over(top)).where(F.col("_r") <= strongest)
        leaders = stored(first.groupBy("g").agg(F.collect_list("d").alias("_l"), F.max(F.struct("d", "node")).alias("_last")).select("g", "_last", dedupe("_l").alias("_l")), "leaders")
        kept.append(leaders.select("g", F.explode("_l").alias("d")))
        later = rest.join(leaders, "g").where(F.struct("d", "node") > F.col("_last"))
        rest = stored(later.where(~F.exists("_l", lambda k: _repeats(k, F.col("d")))).select(*distinct.columns), "open")
    if not rest.isEmpty():
        kept.append(rest.join(settle(_conflicts(rest)), "node", "left_anti").select("g", "d"))
    every = kept[0]
    for more in kept[1:]:
        every = every.unionByName(more)
    many = every.groupBy("g").agg(F.array_sort(F.collect_list("d")).alias("details"))
    return few.unionByName(many).withColumnRenamed("g", group)
