"""SentencePiece encoding and decoding as shortest paths through weighted transducers.

The model file is compiled once per process into
- the normaliser: a space mark before the text and in place of every space,
- the pieces: a trie over characters whose final states emit piece ids,
- byte fallback: a character outside the model emits the ids of its UTF-8 bytes,
- successor weights: 0 or infinity for two pieces side by side.
A text is composed with these; the path of least weight in the tropical semiring (minimum over paths, sum along a path) gives
its ids.  For a byte-pair model the best path by piece scores alone would not be what the library returns.  Greedy merging is
expressed by the successor weights instead: two pieces may stand side by side if and only if merging their joined characters
gives these two again.  A sequence in which all neighbours may stand side by side is the result of greedy merging, and the
only one, so each place in a text is reached by one path of finite weight, and one state per place is enough.

No piece holds the space mark after another character, so no path crosses a mark that follows one; each word with its mark is a
closed sub-lattice.  A batch's distinct words are solved together, place by place, in numpy; texts take the paths of their words.

A null text gives no ids and decodes to the empty text.  Runs of spaces, very long texts and characters outside the model are
exact.  The space mark itself decodes to a space, as in the library.  Repeated rows are encoded each for itself.  Only the id and text columns are read.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleanery.llm.words import bounded, released

MODEL = "piece_bpe_32k.model"
MARK = "▁"
_models: dict[str, Transducer] = {}


class Table:
    """Open addressing over 63-bit keys, looked up for whole arrays."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        self.shift = np.uint64(64 - max(4, int(len(keys) * 4).bit_length()))
        self.mask = (1 << (64 - int(self.shift))) - 1
        self.keys = np.full(self.mask + 1, -1, np.int64)
        self.values = np.full(self.mask + 1, -1, np.int32)
        for k, s, v in zip(keys.tolist(), self._slot(keys).tolist(), values.tolist()):
            while self.keys[s] != -1:
                s = (s + 1) & self.mask
            self.keys[s], self.values[s] = k, v

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return (keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> self.shift).astype(np.int64)

    def get(self, keys: np.ndarray) -> np.ndarray:
        """Value of each key, -1 where absent."""
        slot = self._slot(keys)
        held = self.keys[slot]
        out = np.where(held == keys, self.values[slot], np.int32(-1))
        open_ = np.flatnonzero((held != keys) & (held != -1))
        while len(open_):
            slot[open_] = (slot[open_] + 1) & self.mask
            held = self.keys[slot[open_]]
            hit = held == keys[open_]
            out[open_[hit]] = self.values[slot[open_[hit]]]
            open_ = open_[~hit & (held != -1)]
        return out


def _merged(symbols: list[str], rank: dict[str, int]) -> list[tuple[str, str]]:
    """The merges that greedy merging makes of these characters, in order."""
    done = []
    while True:
        best = min(((rank[a + b], k) for k, (a, b) in enumerate(zip(symbols, symbols[1:])) if a + b in rank), default=None)
        if best is None:
            return done if len(symbols) == 1 else []
        k = best[1]
        done.append((symbols[k], symbols[k + 1]))
        symbols = [*symbols[:k], symbols[k] + symbols[k + 1], *symbols[k + 2 :]]


class Transducer:
    def __init__(self, path: str):
        import sentencepiece.sentencepiece_model_pb2 as proto

        model = proto.ModelProto()
        with open(path, "rb") as file:
            model.ParseFromString(file.read())
        spec = model.normalizer_spec
        if model.trainer_spec.model_type != 2 or spec.precompiled_charsmap or spec.remove_extra_whitespaces or not spec.add_dummy_prefix or not model.trainer_spec.byte_fallback:
            raise ValueError("made for byte-pair models with byte fallback, a space mark in front and no character map")
        pieces = [(k, p.piece, p.score) for k, p in enumerate(model.pieces) if p.type == 1]
        if any(MARK in text.lstrip(MARK) for _, text, _ in pieces):
            raise ValueError("pieces of this model cross spaces")
        self.size = len(model.pieces)
        self.unknown = self.size  # a character outside the model, until it becomes bytes
        order = {k: r for r, (k, _, _) in enumerate(sorted(pieces, key=lambda x: (-x[2], x[0])))}
        ids = {text: k for k, text, _ in pieces}
        ranks = {text: order[k] for k, text, _ in pieces}
        if any(c not in ids for text in ids for c in text):
            raise ValueError("a piece holds a character that is no piece")
        self.byte_ids = np.zeros(256, np.int32)
        self.surface = [b""] * (self.size + 1)
        for k, p in enumerate(model.pieces):
            if p.type == 6:
                value = int(p.piece[1:-1], 16)
                self.byte_ids[value], self.surface[k] = k, bytes([value])
            elif p.type == 1:
                self.surface[k] = p.piece.replace(MARK, " ").encode()
        # Trie of pieces: (node, character) -> node, and the piece that ends at a node.
        edges: dict[int, int] = {}
        ends = [-1]
        for text, k in ids.items():
            node = 0
            for c in text:
                key = node << 21 | ord(c)
                if key not in edges:
                    edges[key] = len(ends)
                    ends.append(-1)
                node = edges[key]
            ends[node] = k
        # Pieces that greedy merging never makes out of their own characters are no pieces of any path.
        self.rank = np.zeros(self.size + 1, np.int64)
        self.left, self.right = np.full(self.size + 1, -1, np.int32), np.full(self.size + 1, -1, np.int32)
        reachable = np.zeros(self.size, bool)
        for text, k in ids.items():
            self.rank[k] = ranks[text] if len(text) > 1 else -1
            made = _merged(list(text), ranks) if len(text) > 1 else []
            if made:
                self.left[k], self.right[k] = ids[made[-1][0]], ids[made[-1][1]]
            reachable[k] = len(text) == 1 or bool(made)
        self.ends = np.array([k if k >= 0 and reachable[k] else -1 for k in ends], np.int32)
        self.edges = Table(np.array(list(edges), np.int64), np.array(list(edges.values()), np.int32))
        self.longest = max(map(len, ids))
        pairs = {ids[t[:j]] << 17 | ids[t[j:]]: k for t, k in ids.items() for j in range(1, len(t)) if t[:j] in ids and t[j:] in ids}
        self.pairs = Table(np.array(list(pairs), np.int64), np.array(list(pairs.values()), np.int32))

    def beside(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether greedy merging leaves a and b side by side: no merge across the border comes before the merges inside.

        The two pieces are taken apart along the border, the later merge first.  A merge across the border counts if it is made
        before the merges that were undone so far; of merges of one rank the one further left is made first.
        """
        fine = np.ones(len(a), bool)
        a, b = a.astype(np.int64), b.astype(np.int64)
        limit = np.full(len(a), 1 << 40, np.int64)
        work = np.flatnonzero((a >= 0) & (a != self.unknown) & (b != self.unknown))
        while len(work):
            x, y = a[work], b[work]
            whole = self.pairs.get(x << 17 | y)
            across = np.where(whole >= 0, self.rank[np.maximum(whole, 0)] * 2, 1 << 41)
            bad = across < limit[work]
            fine[work[bad]] = False
            work = work[~bad]
            x, y = a[work], b[work]
            rx, ry = np.where(self.left[x] >= 0, self.rank[x], -1), np.where(self.left[y] >= 0, self.rank[y], -1)
            split_x = (rx >= 0) & (rx > ry)
            split_y = ~split_x & (ry >= 0)
            # A merge inside a lies left of the border and wins a tie; one inside b loses it.
            limit[work[split_x]] = rx[split_x] * 2
            limit[work[split_y]] = ry[split_y] * 2 + 1
            a[work[split_x]] = self.right[x[split_x]]
            b[work[split_y]] = self.left[y[split_y]]
            work = work[split_x | split_y]
        return fine

    def solve(self, words: list[str]) -> list[np.ndarray]:
        """Ids of each word, taken with the space mark that is part of it."""
        count = np.array([len(w) for w in words], np.int64)
        first = np.concatenate(([0], np.cumsum(count)))
        chars = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
        stop = np.repeat(first[1:], count)
        total = len(chars)
        # Composition: the piece on each arc (from, length) of the lattice.
        arcs = np.full((self.longest, total), -1, np.int32)
        node, at = np.zeros(total, np.int64), np.arange(total)
        for length in range(1, self.longest + 1):
            at_end = at + length - 1
            inside = at_end < stop[at]
            at, node, at_end = at[inside], node[inside], at_end[inside]
            node = self.edges.get(node << 21 | chars[at_end]).astype(np.int64)
            alive = node >= 0
            at, node = at[alive], node[alive]
            if not len(at):
                break
            arcs[length - 1, at] = self.ends[node]
        lone = arcs[0] < 0
        arcs[0, lone] = self.unknown
        # Shortest path: at each place the one arc of finite weight.
        last, step = np.full(total, -1, np.int32), np.zeros(total, np.int8)
        longest_word = int(count.max()) if len(count) else 0
        by_size = np.argsort(-count, kind="stable")
        live = np.searchsorted(-count[by_size], -np.arange(longest_word + 1), "right")
        for place in range(longest_word):
            todo = first[:-1][by_size[: live[place + 1]]] + place
            for length in range(min(place + 1, self.longest), 0, -1):
                piece = arcs[length - 1, todo - length + 1]
                some = np.flatnonzero(piece >= 0)
                if not len(some):
                    continue
                here, piece = todo[some], piece[some]
                before = last[here - length] if place >= length else np.full(len(here), -1, np.int32)
                key, back = np.unique(before.astype(np.int64) << 17 | piece, return_inverse=True)
                good = self.beside(key >> 17, key & 0x1FFFF)[back]
                last[here[good]], step[here[good]] = piece[good], length
                keep = np.ones(len(todo), bool)
                keep[some[good]] = False
                todo = todo[keep]
                if not len(todo):
                    break
            if len(todo):
                raise RuntimeError("a place without a path")
        out = []
        last_list, step_list, byte_ids = last.tolist(), step.tolist(), self.byte_ids
        for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
            path, k = [], b
            while k > a:
                piece = last_list[k - 1]
                if piece == self.unknown:
                    path.extend(byte_ids[np.frombuffer(chr(int(chars[k - 1])).encode("utf-8", "surrogatepass"), np.uint8)][::-1].tolist())
                else:
                    path.append(piece)
                k -= step_list[k - 1]
            out.append(np.array(path[::-1], "<i4"))
        return out


def transducer(name: str = MODEL) -> Transducer:
    if name not in _models:
        import public_tokenizers

        _models[name] = Transducer(public_tokenizers.path(name))
    return _models[name]


MEMO = 500_000
_memo: dict[str, dict[str, bytes]] = {}
# Characters of words solved together.
TOGETHER = 1 << 20


def _paths(words: list[str], name: str) -> list[bytes]:
    memo = _memo.setdefault(name, {})
    missing = [w for w in words if w not in memo]
    if len(memo) + len(missing) > MEMO:
        memo.clear()
        missing = words
    at = 0
    while at < len(missing):
        to, chars = at, 0
        while to < len(missing) and (to == at or chars + len(missing[to]) <= TOGETHER):
            chars += len(missing[to])
            to += 1
        for word, ids in zip(missing[at:to], transducer(name).solve(missing[at:to])):
            memo[word] = ids.tobytes()
        at = to
    return [memo[w] for w in words]


def encoded(texts: list[str | None], name: str = MODEL) -> list[bytes]:
    """Ids of every text, little-endian 32-bit."""
    out = [b""] * len(texts)
    places = [k for k, t in enumerate(texts) if t]
    if not places:
        return out
    marked = pc.replace_substring(pa.array([" " + texts[k] for k in places], pa.large_string()), " ", MARK)
    # A mark after another character begins a word; marks side by side stay together.
    cut = pc.replace_substring_regex(marked, f"([^{MARK}])({MARK})", "\\1\x00\\2")
    odd = [k for k in places if "\x00" in texts[k]]  # the cut sign itself: solved uncut below
    parts = pc.split_pattern(cut, "\x00")
    coded = parts.flatten().dictionary_encode()
    held = np.array(_paths(coded.dictionary.to_pylist(), name), object)[coded.indices.to_numpy()].tolist()
    edge = parts.offsets.to_pylist()
    for k, a, b in zip(places, edge, edge[1:]):
        out[k] = b"".join(held[a:b])
    for k in odd:
        out[k] = _paths([(" " + texts[k]).replace(" ", MARK)], name)[0]
    return out


def decoded(ids: bytes, name: str = MODEL) -> str:
    """Text of a sequence of ids: surfaces joined, marks as spaces, without the mark in front."""
    surface = transducer(name).surface
    data = b"".join([surface[i] for i in np.frombuffer(ids, "<i4").tolist()])
    return (data[1:] if data[:1] == b" " else data).decode("utf-8", "replace")


def _run(name: str) -> Callable:
    schema = pa.schema([("id", pa.int64()), ("n_pieces", pa.int64()), ("ids", pa.binary()), ("decoded", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bounded(batches, 1):
            ids = encoded(batch.column(1).to_pylist(), name)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary()), pa.array([decoded(x, name) for x in ids], pa.string())],
                schema=schema)

    return run


def _digests(name: str) -> Callable:
    schema = pa.schema([("id", pa.int64()), ("n_pieces", pa.int64()), ("ids_crc32", pa.int64()), ("round_trip", pa.bool_())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bounded(batches, 1):
            texts = batch.column(1).to_pylist()
            ids = encoded(texts, name)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array([zlib.crc32(x) for x in ids], pa.int64()),
                 pa.array([decoded(x, name) == (t or "") for x, t in zip(ids, texts)], pa.bool_())], schema=schema)

    return run


def _pairs(docs: DataFrame, id_column: str, text_column: str) -> DataFrame:
    return docs.select(F.col(f"`{id_column}`").cast("bigint").alias("id"), F.col(f"`{text_column}`").cast("string").alias("text"))


def pieces(docs: DataFrame, name: str = MODEL, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(id, n_pieces, ids, decoded): the ids of every text and the text that they decode to."""
    return _pairs(docs, id_column, text_column).mapInArrow(released(_run(name)), "id bigint, n_pieces bigint, ids binary, decoded string")


def piece_digests(docs: DataFrame, name: str = MODEL, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(id, n_pieces, ids_crc32, round_trip): the same, reduced to digests before it leaves the task."""
    return _pairs(docs, id_column, text_column).mapInArrow(released(_digests(name)), "id bigint, n_pieces bigint, ids_crc32 bigint, round_trip boolean")
