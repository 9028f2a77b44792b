"""Vocabulary tables of a SentencePiece BPE model, loaded once in each Python worker.

``PieceTable`` holds pieces as ids, the rank of each piece (the order in which the library
prefers merges: higher score first, ties to the left) and, for every piece and every place to cut
it, the pair of parts that it joins. Tokenizer files are read from the path that is given; they
are not part of this repository.
"""

from __future__ import annotations

import re
from functools import lru_cache

import numpy as np

SPACE = "▁"
BIG = np.int64(1 << 40)


class PieceTable:
    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        self.n = n
        self.pieces = [sp.id_to_piece(i) for i in range(n)]
        self.byte_id = {}
        self.ids: dict[str, int] = {}
        for i, piece in enumerate(self.pieces):
            if sp.is_byte(i):
                self.byte_id[int(piece[3:-1], 16)] = i
            elif not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)):
                self.ids[piece] = i
        self.score = np.array([sp.get_score(i) for i in range(n)])
        distinct = np.unique(-self.score)
        self.rank = np.searchsorted(distinct, -self.score).astype(np.int64)
        self.longest = max(map(len, self.ids))
        # Words can be cut before a space mark only if no piece has one after another character.
        self.cuttable = not any(re.search(f"[^{SPACE}]{SPACE}", p) for p in self.ids)
        self._pairs()
        self._neighbours()

    def _neighbours(self) -> None:
        """Pairs of characters that follow one another in some piece; between others no merge can reach."""
        found = {(a, b) for piece in self.ids for a, b in zip(piece, piece[1:], strict=False)}
        self.neighbours = np.sort(np.array([(ord(a) << 21) | ord(b) for a, b in found] or [-1], dtype=np.int64))

    def joinable(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Whether some piece has these code points next to one another."""
        keys = (left << 21) | right
        return self.neighbours[np.minimum(np.searchsorted(self.neighbours, keys), len(self.neighbours) - 1)] == keys

    def symbol(self, char: str) -> int:
        """A piece's id, or a number from ``n`` on for a character that is no piece."""
        i = self.ids.get(char)
        return self.n + ord(char) if i is None else i

    def _pairs(self) -> None:
        keys, made = [], []
        for piece, i in self.ids.items():
            for cut in range(1, len(piece)):
                a, b = piece[:cut], piece[cut:]
                left = self.ids.get(a, self.symbol(a) if len(a) == 1 else None)
                right = self.ids.get(b, self.symbol(b) if len(b) == 1 else None)
                if left is not None and right is not None:
                    keys.append((left << 24) | right)
                    made.append(i)
        order = np.argsort(np.array(keys, dtype=np.int64), kind="stable")
        self.pair_keys = np.array(keys, dtype=np.int64)[order]
        self.pair_made = np.array(made, dtype=np.int64)[order]
        self.pair_rank = self.rank[self.pair_made]

    def look_up(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and id of the piece that joins each pair; BIG and -1 where there is none."""
        keys = (left << 24) | right
        at = np.searchsorted(self.pair_keys, keys)
        at[at == len(self.pair_keys)] = 0
        found = self.pair_keys[at] == keys
        return np.where(found, self.pair_rank[at], BIG), np.where(found, self.pair_made[at], -1)

    def cut(self, text: str) -> list[str]:
        """Pre-tokens of a text, still with plain spaces; together they are a space and the text."""
        return _WORDS.findall(" " + text) if self.cuttable else [" " + text]


_WORDS = re.compile(f"[ {SPACE}]+[^ {SPACE}]*|[^ {SPACE}]+")


@lru_cache(maxsize=4)
def piece_table(path: str) -> PieceTable:
    return PieceTable(path)
