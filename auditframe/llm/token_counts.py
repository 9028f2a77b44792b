"""Token counts by rank-synchronous array merging.

The distinct pre-tokens of a batch lie behind one another in ragged numpy arrays, cut wherever no piece
holds the two characters on either side. In each round every sequence merges its pair of lowest rank,
all sequences at once; a sequence without a pair left leaves the arrays. What survives is counted, a
character outside the vocabulary as its UTF-8 bytes. Counts of pre-tokens are kept in each worker, in a
table of bounded size that is only a memory of results and never changes them.

A long sequence also merges, in the same round, every pair of a rank below that of all pairs around it,
as far as the longest piece reaches: whatever is merged before such a pair contains a character from
beyond and is too short to reach it. Text without spaces thus takes few rounds.

Nulls and empty texts have 0 tokens. Repeated rows give repeated rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditframe.llm.pieces import BIG, SPACE, PieceTable, piece_table

#: Pre-tokens whose counts a worker remembers, and pre-token characters merged together.
REMEMBERED, BLOCK = 400_000, 1_000_000


def surviving(words: list[str], table: PieceTable) -> np.ndarray:
    """The number of tokens of each non-empty pre-token."""
    lengths = np.array([len(w) for w in words], dtype=np.int64)
    points = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.int64)
    distinct, back = np.unique(points, return_inverse=True)
    symbols = np.array([table.symbol(chr(p)) for p in distinct], dtype=np.int64)[back]
    utf8 = 1 + (points >= 0x80) + (points >= 0x800) + (points >= 0x10000)
    word = np.repeat(np.arange(len(words)), lengths)
    # Sequences within words
    begins = np.r_[True, (word[1:] != word[:-1]) | ~table.joinable(points[:-1], points[1:])] if len(points) else np.zeros(0, dtype=bool)
    owner = np.cumsum(begins) - 1
    word = word[begins]
    # Characters outside the vocabulary count one symbol now; their further bytes are added at the
    # end for those that stay, and such a character stays unless some piece holds it.
    counts = np.zeros(len(word), dtype=np.int64)
    rank, made = _ranks(symbols, owner, table)
    extra = np.where(symbols >= table.n, utf8 - 1, 0)
    while len(symbols):
        starts = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
        sizes = np.diff(np.r_[starts, len(owner)])
        lowest = np.minimum.reduceat(rank, starts)
        done = lowest == BIG
        if done.any():
            counts[owner[starts[done]]] = sizes[done] + np.add.reduceat(extra, starts)[done]
            stay = np.repeat(~done, sizes)
            symbols, owner, rank, made, extra = symbols[stay], owner[stay], rank[stay], made[stay], extra[stay]
            if not len(symbols):
                break
            starts = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
            sizes = np.diff(np.r_[starts, len(owner)])
            lowest = lowest[~done]
        hits = _chosen(rank, symbols, made, starts, sizes, lowest, table)
        symbols[hits] = made[hits]
        extra[hits] = 0
        keep = np.ones(len(symbols), dtype=bool)
        keep[hits + 1] = False
        place = np.cumsum(keep) - 1
        symbols, owner, rank, made, extra = symbols[keep], owner[keep], rank[keep], made[keep], extra[keep]
        at = place[hits]
        at = np.unique(np.concatenate([at, np.maximum(at - 1, 0)]))
        _refresh(at, symbols, owner, rank, made, table)
    return np.bincount(word, weights=counts, minlength=len(words)).astype(np.int64)


def _ranks(symbols, owner, table):
    rank, made = np.full(len(symbols), BIG), np.full(len(symbols), -1)
    _refresh(np.arange(len(symbols)), symbols, owner, rank, made, table)
    return rank, made


def _refresh(at, symbols, owner, rank, made, table) -> None:
    """Ranks of the pairs that begin at the given places; the last symbol of a sequence has none."""
    rank[at], made[at] = BIG, -1
    at = at[at + 1 < len(symbols)]
    at = at[owner[at] == owner[at + 1]]
    rank[at], made[at] = table.look_up(symbols[at], symbols[at + 1])


def _chosen(rank, symbols, made, starts, sizes, lowest, table) -> np.ndarray:
    """Places to merge: the leftmost lowest pair of each sequence.

    A long sequence merges all its pairs of that rank that don't overlap, provided that no pair
    which such a merge makes on the way has a rank as low; else it merges the leftmost alone. It merges
    the ``_lowest_around``, too.
    """
    hit = np.flatnonzero(rank == np.repeat(lowest, sizes))
    which = np.searchsorted(starts, hit, side="right") - 1
    first = np.r_[True, which[1:] != which[:-1]]
    if not (long := sizes[which] > 32).any():
        return hit[first]
    run = np.cumsum(np.r_[True, hit[1:] != hit[:-1] + 1])
    in_run = np.arange(len(hit)) - np.flatnonzero(np.r_[True, run[1:] != run[:-1]])[run - 1]
    several = long & (in_run % 2 == 0)
    at = hit[several]
    new, floor, seq = made[at], lowest[which[several]], which[several]
    ends = (starts + sizes)[seq]
    later = symbols.copy()
    later[at] = new
    bad = np.zeros(len(at), dtype=bool)
    merged = np.zeros(len(symbols) + 1, dtype=bool)
    merged[at + 1] = True  # the right part of a merge is gone afterwards
    before = at - 1
    before = np.where((before >= 0) & merged[np.maximum(before, 0)], before - 1, before)
    ok = (before >= starts[seq])
    bad[ok] |= table.look_up(later[before[ok]], new[ok])[0] <= floor[ok]
    ok = at + 2 < ends
    bad[ok] |= table.look_up(new[ok], symbols[at[ok] + 2])[0] <= floor[ok]
    bad[ok] |= table.look_up(new[ok], later[at[ok] + 2])[0] <= floor[ok]
    unsafe = np.zeros(len(starts), dtype=bool)
    unsafe[seq[bad]] = True
    hit = hit[first | (several & ~unsafe[which])]
    return np.union1d(hit, _lowest_around(rank, symbols, made, starts, sizes, table))


def _lowest_around(rank, symbols, made, starts, sizes, table) -> np.ndarray:
    """Places in long sequences whose rank is below all within the longest piece and two symbols on either
    side, and below those of the pairs that their merges make."""
    reach = table.longest + 2
    of = np.flatnonzero(sizes > 2 * reach)
    if not len(of):
        return np.zeros(0, dtype=np.int64)
    at = np.concatenate([np.arange(starts[i], starts[i] + sizes[i]) for i in of])
    own = rank[at]
    # Least rank of the ``reach`` places after each place, by doubling; of those before it, in reverse.
    around = np.full(len(own), BIG)
    for turned in (own, own[::-1]):
        least, span = np.r_[turned[1:], np.full(reach, BIG)], 1
        while 2 * span <= reach:
            least[: len(least) - span] = np.minimum(least[:-span], least[span:])
            span *= 2
        rest = reach - span
        both = np.minimum(least[: len(own)], np.r_[least[rest:], np.full(rest, BIG)][: len(own)])
        around = np.minimum(around, both if turned is own else both[::-1])
    found = at[(own < around) & (own < BIG)]
    seq = np.searchsorted(starts, found, side="right") - 1
    ok = np.ones(len(found), dtype=bool)
    before = found > starts[seq]
    ok[before] &= table.look_up(symbols[found[before] - 1], made[found[before]])[0] > rank[found[before]]
    after = found + 2 < starts[seq] + sizes[seq]
    ok[after] &= table.look_up(made[found[after]], symbols[found[after] + 2])[0] > rank[found[after]]
    return found[ok]


def count_texts(texts: list[str], table: PieceTable, known: dict[str, int]) -> list[int]:
    """Tokens of each text."""
    cut = [table.cut(t) if t else [] for t in texts]
    new = list({w for words in cut for w in words if w not in known})
    fresh: dict[str, int] = {}
    at = 0
    while at < len(new):
        block, size = [], 0
        while at < len(new) and (not block or size + len(new[at]) <= BLOCK):
            block.append(new[at])
            size += len(new[at])
            at += 1
        fresh.update(zip(block, surviving([w.replace(" ", SPACE) for w in block], table).tolist(), strict=True))
    both = (lambda w: known[w] if w in known else fresh[w]) if len(known) + len(fresh) > REMEMBERED else None
    if both is None:
        known.update(fresh)
        both = known.__getitem__
    out = [sum(map(both, words)) for words in cut]
    if len(known) + len(fresh) > REMEMBERED:
        known.clear()
        known.update((w, n) for w, n in fresh.items() if len(w) <= 64)
    return out


def token_counts(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, n_bytes (UTF-8) and n_tokens of every row, without a shuffle."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        table, known = piece_table(model_path), {}
        for batch in batches:
            texts = batch["text"].tolist()
            yield pd.DataFrame({"id": batch["id"], "n_bytes": batch["n_bytes"], "n_tokens": count_texts(texts, table, known)})

    text = F.coalesce(F.col(text_col), F.lit(""))
    source = docs.select(F.col(id_col).alias("id"), text.alias("text"), F.octet_length(text).cast("long").alias("n_bytes"))
    kind = docs.schema[id_col].dataType.simpleString()
    counted = source.mapInPandas(run, f"id {kind}, n_bytes long, n_tokens long")
    return counted.withColumnRenamed("id", id_col)
