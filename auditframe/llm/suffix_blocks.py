"""Sorting a set of suffixes of one byte string block by block, with a difference cover.

A difference cover D modulo v holds, for any two residues, a pair of members with their difference.
So for any two places i and j some d < v puts both i + d and j + d on covered places. The covered
places are ranked first, by their first v bytes and then by doubling; after that the wanted suffixes
are split into blocks by their first bytes and each block is sorted alone: by v bytes, and where
those tie by the ranks d bytes further on. Long ties cost no more than short ones, and what is held
besides the text and the ranks is one block.
"""

from __future__ import annotations

from functools import cmp_to_key, lru_cache

import numpy as np


@lru_cache(maxsize=4)
def cover(v: int) -> tuple[np.ndarray, np.ndarray]:
    """A difference cover of ``v`` residues, and for each pair of residues the least shift onto it.

    With s about the square root of v, the numbers below s and the multiples of s will do: any
    difference is a multiple of s less a number below s.
    """
    s = max(1, round(v**0.5))
    members = np.unique(np.r_[np.arange(s), np.arange(s, v + s, s)] % v)
    on = np.zeros(v, dtype=bool)
    on[members] = True
    shift = np.full((v, v), -1, dtype=np.int64)
    residue = np.arange(v)
    for d in range(v - 1, -1, -1):
        both = on[(residue + d) % v]
        shift[np.ix_(both, both)] = d
    assert (shift >= 0).all()
    return on, shift


def leading_words(text: np.ndarray, room: int) -> np.ndarray:
    """The eight bytes from each place on as a big-endian number; zeros after the end."""
    padded = np.concatenate([text, np.zeros(room + 8, dtype=np.uint8)])
    words = np.zeros(len(text) + room, dtype=np.uint64)
    for j in range(8):
        words |= padded[j : j + len(words)].astype(np.uint64) << np.uint64(56 - 8 * j)
    return words


def _dense(keys: list[np.ndarray]) -> np.ndarray:
    """Ranks of rows by ``keys``, the first one most significant; equal rows share a rank."""
    order = np.lexsort(keys[::-1])
    new = np.zeros(len(order), dtype=bool)
    for k in keys:
        sorted_k = k[order]
        new[1:] |= sorted_k[1:] != sorted_k[:-1]
    ranks = np.empty(len(order), dtype=np.int64)
    ranks[order] = np.cumsum(new)
    return ranks


def cover_ranks(words: np.ndarray, size: int, v: int, depth: int) -> np.ndarray:
    """Rank of the suffix at each covered place by at least ``depth`` bytes; elsewhere -1."""
    on, _ = cover(v)
    places = np.flatnonzero(on[np.arange(size) % v])
    ranks = np.full(size + 2 * depth + v, -1, dtype=np.int64)
    ranks[places] = _dense([words[places + 8 * k] for k in range(v // 8)])
    length = v
    while length < depth:
        ranks[places] = _dense([ranks[places], ranks[places + length]])  # still -1 past the end
        length *= 2
    return ranks


def sorted_blocks(text: np.ndarray, starts: np.ndarray, depth: int, v: int = 64, block: int = 65536):
    """Yields the wanted suffixes in order of their first ``depth`` bytes, a block at a time.

    Each block comes with a mark for every suffix that equals the one before it for ``depth`` bytes.
    """
    room = depth + v
    words = leading_words(text, room)
    ranks, (_, shift) = cover_ranks(words, len(text), v, depth), cover(v)
    lead = words[starts]
    by_lead = np.argsort(lead, kind="stable")
    starts, lead = starts[by_lead], lead[by_lead]
    # Blocks end where the first eight bytes change, so that equal suffixes stay together.
    ends = np.flatnonzero(np.r_[lead[1:] != lead[:-1], True]) + 1
    at = 0
    while at < len(starts):
        end = int(ends[np.searchsorted(ends, min(at + block, len(starts)))])
        yield _sorted_block(words, ranks, shift, starts[at:end], depth, v)
        at = end


def _sorted_block(words, ranks, shift, own, depth, v):
    keys = [words[own + 8 * k] for k in range(v // 8)]
    tied_to = _dense(keys)
    residue = own % v
    order = np.lexsort([ranks[own + shift[residue, residue]], tied_to])
    own, tie, residue = own[order], tied_to[order], residue[order]
    begins = np.flatnonzero(np.r_[True, tie[1:] != tie[:-1]])
    sizes = np.diff(np.r_[begins, len(own)])
    # A tie between different residues needs the shift of each pair.
    mixed = np.maximum.reduceat(residue, begins) != np.minimum.reduceat(residue, begins)
    compare = cmp_to_key(lambda i, j: int(ranks[i + shift[i % v, j % v]] - ranks[j + shift[i % v, j % v]]))
    for begin, n in zip(begins[mixed], sizes[mixed], strict=True):
        own[begin : begin + n] = sorted(own[begin : begin + n].tolist(), key=compare)
    equal = np.zeros(len(own), dtype=bool)
    near = np.flatnonzero(tie[1:] == tie[:-1]) + 1
    a, b = own[near], own[near - 1]
    same = np.ones(len(near), dtype=bool)
    for k in range(v // 8, depth // 8):
        same &= words[a + 8 * k] == words[b + 8 * k]
    if depth % 8:
        same &= (words[a + depth - 8] == words[b + depth - 8]) if depth >= 8 else same
    equal[near] = same
    return own, equal


def repeated(text: np.ndarray, starts: np.ndarray, depth: int, v: int = 64) -> np.ndarray:
    """Marks those of ``starts`` (distinct, ``depth`` bytes of text after each) whose string is also
    that of another."""
    marks = np.zeros(len(text), dtype=bool)
    for own, equal in sorted_blocks(text, starts, depth, v):
        marks[own[equal]] = True
        marks[own[np.flatnonzero(equal) - 1]] = True
    return marks[starts]
