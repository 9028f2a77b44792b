"""SentencePiece encoding by forward filtering and backward sampling, and lossless decoding.

A text is a space mark and its characters, spaces written as space marks. Its lattice has a node
between any two characters and an edge for each vocabulary piece; a character that is no piece,
and a literal space mark, has one edge of UTF-8 byte pieces. The probability of a segmentation is
proportional to ``exp(alpha * sum(log weight))`` over its edges, with weight 1 / (offset + rank) of
a piece by its place in the merge order. No piece reaches from one word into the next, so words are
filtered forward once for each distinct word, and all words of a batch are sampled backward
together: one step draws the next edge of every unfinished word from its cumulative probabilities.

The random numbers are a hash of (seed, row key, place of the word in the text, step), so a row's
segmentation depends on nothing but its key, its text and the seed. Equal rows get equal results.

Nulls: a null text encodes to an empty list, as an empty text does; null ids decode to "". A null
key counts as the key "". Other columns are ignored.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from itertools import islice

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditframe.llm.pieces import SPACE, PieceTable, piece_table

#: Characters handled together, words whose lattices are built together, and lattice edges that a
#: worker remembers before it starts anew.
BLOCK, LEARNT, REMEMBERED = 1_500_000, 30_000, 5_000_000


class Trie:
    """The pieces as a trie: a table of children for common characters, sorted arrays for the rest."""

    def __init__(self, table: PieceTable, common: int = 127):
        child: dict[tuple[int, int], int] = {}
        piece = [-1]
        uses = Counter(c for text in table.ids for c in text)
        top = [ord(c) for c, _ in uses.most_common(common)]
        self.code = np.zeros(0x110000, dtype=np.uint8)
        self.code[top] = np.arange(1, len(top) + 1)
        for text, i in table.ids.items():
            at = 0
            for c in map(ord, text):
                if (at, c) not in child:
                    child[at, c] = len(piece)
                    piece.append(-1)
                at = child[at, c]
            piece[at] = i
        self.piece = np.array(piece, dtype=np.int64)
        parent, char = np.array(list(child), dtype=np.int64).T
        own = np.fromiter(child.values(), dtype=np.int64)
        self.step = np.full((len(piece), common + 1), -1, dtype=np.int32)
        coded = self.code[char] > 0
        self.step[parent[coded], self.code[char[coded]]] = own[coded]
        keys = (parent[~coded] << 21) | char[~coded]
        order = np.argsort(keys)
        self.keys, self.child = np.r_[keys[order], np.iinfo(np.int64).max], np.r_[own[~coded][order], -1]

    def matches(self, chars: np.ndarray, room: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start, length and piece of every piece in the text; room: characters left in the word."""
        code = self.code[chars]
        found, node, start, depth = [], np.zeros(len(chars), dtype=np.int64), np.arange(len(chars)), 0
        while len(start):
            seen = code[start + depth]
            after = self.step[node, seen].astype(np.int64)
            rare = np.flatnonzero(seen == 0)
            if len(rare):
                keys = (node[rare] << 21) | chars[start[rare] + depth]
                at = np.searchsorted(self.keys, keys)
                after[rare] = np.where(self.keys[at] == keys, self.child[at], -1)
            ok = after >= 0
            start, node, depth = start[ok], after[ok], depth + 1
            own = self.piece[node]
            whole = own >= 0
            found.append((start[whole], np.full(int(whole.sum()), depth), own[whole]))
            more = room[start] > depth
            start, node = start[more], node[more]
        return tuple(np.concatenate(x) for x in zip(*found, strict=True))


class Lattices:
    """The lattices of new words behind one another, filtered forward.

    Word w has the nodes first[w] to first[w + 1] - 1, of which the first has no edges. Edges are
    in the order of the nodes that they lead into; ``order_key`` is that node plus the cumulative
    probability of its edges so far.
    """

    def __init__(self, words: list[str], sampler: Sampler):
        table, weight, alpha = sampler.table, sampler.weight, sampler.alpha
        lengths = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
        points = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.int64)
        literal = points == ord(SPACE)
        chars = np.where(points == 32, ord(SPACE), np.where(literal, 0, points))
        ends = np.cumsum(lengths)
        room = np.repeat(ends, lengths) - np.arange(len(points))
        word = np.repeat(np.arange(len(words)), lengths)
        self.first = np.r_[0, np.cumsum(lengths + 1)]
        node = np.arange(len(points)) + word  # the node before each character
        start, size, piece = sampler.trie.matches(chars, room)
        single = np.ones(len(points), dtype=bool)
        single[start[size == 1]] = False
        alone = np.flatnonzero(single)
        raw = [chr(p).encode("utf-8", "replace") for p in points[alone]]
        raw_n = np.fromiter(map(len, raw), dtype=np.int64, count=len(raw))
        spelled = np.fromiter((table.byte_id[b] for r in raw for b in r), dtype=np.int64, count=int(raw_n.sum()))
        # Piece lists: the vocabulary's own ids, then the spellings of characters outside it.
        self.pieces = np.concatenate([np.arange(table.n), spelled]).astype(np.int32)
        list_at = np.concatenate([piece, table.n + np.cumsum(raw_n) - raw_n])
        list_n = np.concatenate([np.ones(len(piece), dtype=np.int64), raw_n])
        logs = np.concatenate([alpha * weight[piece], alpha * weight[table.byte_id[0]] * raw_n])
        source = np.concatenate([node[start], node[alone]])
        into = np.concatenate([node[start] + size, node[alone] + 1])
        order = np.argsort(into, kind="stable")
        self.source, self.into, logs = source[order], into[order], logs[order]
        self.list_at, self.list_n = list_at[order], list_n[order]
        # Short words can do without logarithms; a factor for each character, equal for all their
        # segmentations, keeps the products in range.
        self.plain = int(lengths.max()) <= 64
        weights = np.exp(logs + math.log(30) * (self.into - self.source)) if self.plain else logs
        self._filter(weights)

    def _filter(self, weights: np.ndarray) -> None:
        nodes, into = int(self.first[-1]), self.into
        begins = np.flatnonzero(np.r_[True, into[1:] != into[:-1]])
        counts = np.diff(np.r_[begins, len(into)])
        self.last = np.zeros(nodes, dtype=np.int64)
        self.last[into[begins]] = begins + counts - 1
        depth = into[begins] - self.first[np.searchsorted(self.first, into[begins], side="right") - 1]
        by_depth = np.argsort(depth, kind="stable")
        bounds = np.flatnonzero(np.r_[True, np.diff(depth[by_depth]) != 0])
        alpha, share = (np.ones if self.plain else np.zeros)(nodes), np.empty(len(into))
        for lo, hi in zip(bounds, np.r_[bounds[1:], len(by_depth)], strict=True):
            group = by_depth[lo:hi]
            n = counts[group]
            heads = np.cumsum(n) - n
            edge = np.repeat(begins[group] - heads, n) + np.arange(n.sum())
            if self.plain:
                value = weights[edge] * alpha[self.source[edge]]
                total = np.add.reduceat(value, heads)
                alpha[into[begins[group]]] = total
            else:
                value = weights[edge] + alpha[self.source[edge]]
                top = np.maximum.reduceat(value, heads)
                value = np.exp(value - np.repeat(top, n))
                total = np.add.reduceat(value, heads)
                alpha[into[begins[group]]] = top + np.log(total)
            share[edge] = value / np.repeat(total, n)
        running = np.cumsum(share)
        before = np.repeat(running[begins] - share[begins], counts)
        self.order_key = into + np.minimum(running - before, 1.0)


@lru_cache(maxsize=4)
def trie(model_path: str) -> Trie:
    return Trie(piece_table(model_path))


def log_weights(table: PieceTable, offset: float) -> np.ndarray:
    return -np.log(offset + table.rank.astype(float))


def _mixed(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def row_seed(key: object, seed: int) -> int:
    return xxhash.xxh64_intdigest("" if key is None else str(key), seed)


class Numbers(dict):
    """Numbers keys in the order in which they are first looked up."""

    def __missing__(self, key: str) -> int:
        self[key] = n = len(self)
        return n


class Sampler:
    def __init__(self, model_path: str, alpha: float, offset: float, seed: int):
        self.table, self.alpha, self.seed = piece_table(model_path), alpha, seed
        self.weight = log_weights(self.table, offset)
        self.trie = trie(model_path)
        self._forget()

    def _forget(self) -> None:
        """Lattices of all known words behind one another: see ``Lattices`` for the arrays."""
        self.number = Numbers()
        self.first, self.last = np.zeros(1, dtype=np.int64), np.zeros(0, dtype=np.int32)
        self.order_key, self.source = np.zeros(0), np.zeros(0, dtype=np.int32)
        self.list_at, self.list_n = np.zeros(0, dtype=np.int32), np.zeros(0, dtype=np.int8)
        self.pieces = np.arange(self.table.n, dtype=np.int32)

    def _learn(self, words: list[str]) -> None:
        new = Lattices(words, self)
        nodes, edges, spelled = int(self.first[-1]), len(self.source), len(self.pieces) - self.table.n
        self.first = np.concatenate([self.first, new.first[1:] + nodes])
        self.last = np.concatenate([self.last, (new.last + edges).astype(np.int32)])
        self.order_key = np.concatenate([self.order_key, new.order_key + nodes])
        self.source = np.concatenate([self.source, (new.source + nodes).astype(np.int32)])
        self.list_at = np.concatenate([self.list_at, (new.list_at + np.where(new.list_at >= self.table.n, spelled, 0)).astype(np.int32)])
        self.list_n = np.concatenate([self.list_n, new.list_n.astype(np.int8)])
        self.pieces = np.concatenate([self.pieces, new.pieces[self.table.n :]])

    def encode(self, keys: list, texts: list) -> list[np.ndarray]:
        words, owner_n, seeds = [], [], []
        for key, text in zip(keys, texts, strict=True):
            own = self.table.cut(text) if text else []
            words.extend(own)
            owner_n.append(len(own))
            seeds.append(row_seed(key, self.seed))
        owner_n = np.array(owner_n, dtype=np.int64)
        if not words:
            return [np.zeros(0, dtype=np.int32) for _ in texts]
        if len(self.source) > REMEMBERED:
            self._forget()
        known = len(self.number)
        word_of = np.fromiter(map(self.number.__getitem__, words), dtype=np.int64, count=len(words))
        for begin in range(known, len(self.number), LEARNT):
            self._learn(list(islice(self.number, begin, begin + LEARNT)))
        at, floor = self.first[word_of + 1] - 1, self.first[word_of]
        place = np.arange(len(words)) - np.repeat(np.cumsum(owner_n) - owner_n, owner_n)
        state = _mixed(np.repeat(np.array(seeds, dtype=np.uint64), owner_n) + place.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        live, step = np.argsort(word_of, kind="stable"), 0  # by word, so that neighbours read neighbouring edges
        taken_word, taken_edge = [], []
        while len(live):
            u = (_mixed(state[live] + np.uint64(step)) >> np.uint64(11)).astype(float) * 2.0**-53
            node = at[live]
            edge = np.searchsorted(self.order_key, node + u, side="right")
            edge = np.minimum(edge, self.last[node])  # rounding at a node's upper end
            taken_word.append(live)
            taken_edge.append(edge)
            at[live] = self.source[edge]
            live = live[at[live] > floor[live]]
            step += 1
        # Step 0 drew the last edge of each word, so an edge's place counts from its word's end.
        drawn = np.zeros(len(words), dtype=np.int64)
        for own in taken_word:
            drawn[own] += 1
        word_end, ordered = np.cumsum(drawn), np.empty(int(drawn.sum()), dtype=np.int64)
        for back, (own, edge) in enumerate(zip(taken_word, taken_edge, strict=True)):
            ordered[word_end[own] - 1 - back] = edge
        taken_word, taken_edge = np.repeat(np.arange(len(words)), drawn), ordered
        counts = self.list_n[taken_edge].astype(np.int64)
        out = np.repeat(self.list_at[taken_edge] - (np.cumsum(counts) - counts), counts) + np.arange(counts.sum())
        ids = self.pieces[out]
        row_of = np.repeat(np.arange(len(texts)), owner_n)[taken_word]
        per_row = np.bincount(row_of, weights=counts, minlength=len(texts)).astype(np.int64)
        return np.split(ids, np.cumsum(per_row)[:-1])


def sample_encode(
    docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text", *, alpha: float = 1.0, offset: float = 100.0, seed: int = 1
) -> DataFrame:
    """Adds ``piece_ids`` (array of int) to ``id_col`` and ``text_col``: one sampled segmentation.

    Larger ``alpha`` favours the likeliest segmentation, 0 makes all equally likely.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sampler = Sampler(model_path, alpha, offset, seed)
        for batch in batches:
            keys, texts = batch["id"].tolist(), batch["text"].tolist()
            first = 0
            while first < len(texts):
                size, end = 0, first
                while end < len(texts) and (end == first or size < BLOCK):
                    size += len(texts[end] or "")
                    end += 1
                yield batch.iloc[first:end].assign(piece_ids=sampler.encode(keys[first:end], texts[first:end]))
                first = end

    kind = docs.schema[id_col].dataType.simpleString()
    source = docs.select(F.col(id_col).cast("string").alias("id"), F.col(id_col).alias("own"), F.col(text_col).alias("text"))
    done = source.mapInPandas(run, f"id string, own {kind}, text string, piece_ids array<int>")
    return done.select(F.col("own").alias(id_col), F.col("text").alias(text_col), "piece_ids")


def decoder(table: PieceTable):
    """A function from piece ids to the text that they came from."""
    parts = [b""] * table.n
    for piece, i in table.ids.items():
        parts[i] = piece.replace(SPACE, " ").encode()
    for value, i in table.byte_id.items():
        parts[i] = bytes([value])

    def decode(ids) -> str:
        if ids is None or len(ids) == 0:
            return ""
        text = b"".join(map(parts.__getitem__, ids.tolist() if hasattr(ids, "tolist") else ids)).decode("utf-8", "replace")
        return text[1:] if text.startswith(" ") else text

    return decode


def decode(encoded: DataFrame, model_path: str, id_col: str = "doc_id") -> DataFrame:
    """All columns but ``piece_ids``, and ``decoded``: the exact text that was encoded."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        back = decoder(piece_table(model_path))
        for batch in batches:
            yield batch.assign(decoded=[back(x) for x in batch["piece_ids"]]).drop(columns="piece_ids")

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in encoded.schema if f.name != "piece_ids")
    return encoded.mapInPandas(run, schema + ", decoded string")
