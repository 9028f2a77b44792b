"""Best-fit-decreasing packing of tokenised documents into sequences of a fixed length.

A document's tokens are the byte-level BPE ids of its whole text and one end token. A document
longer than a sequence is cut into full pieces, its first piece taking the remainder. Each scan
partition packs what it has tokenised, without a shuffle: pieces go by falling length into the open
sequence with the tightest room, which a segment tree over remaining capacities finds in
logarithmic time. Pieces held at once are bounded by ``block_pieces``; each block leaves at most its
own few unfilled sequences.

The ids are those of the ``tokenizers`` file; the same vocabulary as ranks is applied by the
``tiktoken`` library, which gives the same ids about four times as fast (``tests/llm`` compare the
two). The string of the file's special token in a text becomes its id, as is that file's default.

Null texts are empty texts: one piece that holds the end token. Repeated rows are packed each.
"""

from __future__ import annotations

import base64
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SPECIAL = "<|endoftext|>"
#: The public split pattern of this byte-level vocabulary (fixed value).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


@lru_cache(maxsize=2)
def byte_encoder(ranks_path: str):
    """A function from a text to its ids."""
    import tiktoken

    with open(ranks_path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    encoding = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={SPECIAL: len(ranks)})
    return lambda text: encoding.encode(text, allowed_special="all") if SPECIAL in text else encoding.encode_ordinary(text)


class CapacityTree:
    """Which remaining capacities some open bin has; finds the least one that is large enough."""

    def __init__(self, capacity: int):
        self.leaves = 1 << capacity.bit_length()
        self.any = bytearray(2 * self.leaves)
        self.bins: list[list[int]] = [[] for _ in range(self.leaves)]

    def add(self, room: int, number: int) -> None:
        self.bins[room].append(number)
        at = room + self.leaves
        while at and not self.any[at]:
            self.any[at] = 1
            at >>= 1

    def take(self, need: int) -> tuple[int, int] | None:
        """The room and number of the tightest bin with room for ``need``, which leaves the tree."""
        at = need + self.leaves
        if not self.any[at]:
            while at > 1 and (at & 1 or not self.any[at + 1]):
                at >>= 1
            if at <= 1:
                return None
            at += 1
            while at < self.leaves:
                at = 2 * at if self.any[2 * at] else 2 * at + 1
        room = at - self.leaves
        number = self.bins[room].pop()
        if not self.bins[room]:
            self.any[at] = 0
            at >>= 1
            while at and not (self.any[2 * at] or self.any[2 * at + 1]):
                self.any[at] = 0
                at >>= 1
        return room, number


def best_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """The bin of each item, and its offset there. Every length is from 1 to ``capacity``."""
    number, offset = np.zeros(len(lengths), dtype=np.int64), np.zeros(len(lengths), dtype=np.int64)
    tree, bins = CapacityTree(capacity), 0
    for i in np.argsort(-lengths, kind="stable").tolist():
        need = int(lengths[i])
        found = tree.take(need) if need < capacity else None
        if found is None:
            room, own = capacity, bins
            bins += 1
        else:
            room, own = found
        number[i], offset[i] = own, capacity - room
        if room > need:
            tree.add(room - need, own)
    return number, offset


def pack(
    docs: DataFrame,
    ranks_path: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    *,
    capacity: int = 2048,
    end_id: int = 0,
    block_pieces: int = 400_000,
    with_ids: bool = True,
) -> DataFrame:
    """One row per piece: ``id_col``, piece, start, length, ids_crc32, sequence_id, offset, ids.

    ``ids`` (array of int) is left out if ``with_ids`` is false.
    """

    def pieces(batch: pd.DataFrame, encode) -> Iterator[tuple]:
        for key, text in zip(batch["id"], batch["text"], strict=True):
            ids = np.array([*encode(text or ""), end_id], dtype="<u4")
            first = len(ids) % capacity or min(len(ids), capacity)
            for n, end in enumerate(range(first, len(ids) + 1, capacity)):
                start = max(0, end - capacity) if n else 0
                own = ids[start:end]
                yield key, n, start, len(own), zlib.crc32(own.tobytes()), own.astype("<i4") if with_ids else None

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode, context = byte_encoder(ranks_path), TaskContext.get()
        base = (context.partitionId() if context else 0) << 40
        held: list[tuple] = []

        def packed() -> pd.DataFrame:
            nonlocal base
            out = pd.DataFrame(held, columns=["id", "piece", "start", "length", "ids_crc32", "ids"])
            number, out["offset"] = best_fit_decreasing(out["length"].to_numpy(), capacity)
            out["sequence_id"] = number + base
            base += int(number.max()) + 1
            held.clear()
            return out[columns]

        tokens = 0
        for batch in batches:
            for piece in pieces(batch, encode):
                held.append(piece)
                tokens += piece[3] if with_ids else 0
                if len(held) >= block_pieces or tokens >= 32 * block_pieces:
                    tokens = 0
                    yield packed()
        if held:
            yield packed()

    columns = ["id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset", *["ids"] * with_ids]
    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"id {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long" + ", ids array<int>" * with_ids
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return source.mapInPandas(run, schema).withColumnRenamed("id", id_col)
