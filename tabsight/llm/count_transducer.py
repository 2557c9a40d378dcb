"""Weighted acyclic automata that map sequences of words to counts.

A path is ``DEPTH`` symbols long; a shorter sequence is filled up with the end
symbol, which is the empty word and comes first in the order of words (the
order of their UTF-8 bytes).  A state is the list of its arcs, and an arc has a
label and a value: its target, or on the last level the count of its path.  The
states of a level are kept in flat arrays, and equal ones are one state.
"""

from __future__ import annotations

import pickle
from bisect import bisect_left
from collections.abc import Iterable

import numpy as np

DEPTH = 4
END = b""


def _ranges(first: np.ndarray, n: np.ndarray) -> np.ndarray:
    """first[0], first[0] + 1, ... (n[0] of them), first[1], ..."""
    ends = np.cumsum(n)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(first - ends + n, n)


def _offsets(degree: np.ndarray) -> np.ndarray:
    return np.cumsum(degree) - degree


def _small(x: np.ndarray) -> np.ndarray:
    return x.astype(np.min_scalar_type(int(x.max()) if len(x) else 0))


def _keys(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows of ``DEPTH`` symbols as two integers that order alike."""
    return tuple(ids[:, k].astype(np.uint64) << np.uint64(32) | ids[:, k + 1].astype(np.uint64) for k in (0, 2))


def sum_paths(ids: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct rows of ``ids`` and the sums of their counts."""
    if not len(ids):
        return ids, counts
    hi, lo = _keys(ids)
    order = np.lexsort((lo, hi))
    hi, lo = hi[order], lo[order]
    first = np.flatnonzero(np.concatenate([[True], (hi[1:] != hi[:-1]) | (lo[1:] != lo[:-1])]))
    del hi, lo
    return ids[order[first]], np.add.reduceat(counts[order], first)


def _register(degree: np.ndarray, labels: np.ndarray, values: np.ndarray) -> tuple:
    """Makes equal states one: the new number of every state, then degrees,
    labels and values of the states that are left."""
    start = _offsets(degree)
    arc = (labels.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    arc ^= (values.astype(np.uint64) + np.uint64(0x632BE59BD9B4E019)) * np.uint64(0xD6E8FEB86659FD93)
    arc = (arc ^ arc >> np.uint64(29)) * np.uint64(0xBF58476D1CE4E5B9)
    print_ = np.add.reduceat(arc ^ arc >> np.uint64(32), start)
    _, first, number = np.unique(print_, return_index=True, return_inverse=True)
    # equal prints are looked at arc by arc; a state unlike the first of its print stays itself
    like = first[number]
    same = degree == degree[like]
    at, other = _ranges(start[same], degree[same]), _ranges(start[like[same]], degree[same])
    unlike = (labels[at] != labels[other]) | (values[at] != values[other])
    same[np.repeat(np.flatnonzero(same), degree[same])[unlike]] = False
    number[~same] = len(first) + np.arange((~same).sum())
    first = np.concatenate([first, np.flatnonzero(~same)])
    arcs = _ranges(start[first], degree[first])
    return number, degree[first], labels[arcs], values[arcs]


class CountTransducer:
    """``words`` are sorted and begin with the end symbol; ``levels[d]`` has
    (arcs per state, labels, values) of the states before the d-th symbol."""

    def __init__(self, words: list[bytes], levels: list[tuple]):
        self.words, self.levels = words, levels

    @classmethod
    def build(cls, words: list[bytes], ids: np.ndarray, counts: np.ndarray) -> CountTransducer:
        """From sorted distinct rows of symbols (numbers of ``words``).  Every
        state is registered when all paths through it have been read, level by
        level from the end."""
        new, firsts = np.zeros(len(ids), dtype=bool), [np.zeros(min(1, len(ids)), dtype=np.int64)]
        new[:1] = True
        for d in range(DEPTH):
            new[1:] |= ids[1:, d] != ids[:-1, d]
            firsts.append(np.flatnonzero(new))
        levels, values = [], counts
        for d in range(DEPTH - 1, -1, -1):
            starts = np.searchsorted(firsts[d + 1], firsts[d])
            degree = np.diff(np.append(starts, len(firsts[d + 1])))
            labels = ids[firsts[d + 1], d]
            if len(ids):
                values, *level = _register(degree, labels, values)
            else:
                level = (np.zeros(1, dtype=np.int64), labels, values)
            levels.append(tuple(level))
        return cls(words, levels[::-1])

    @classmethod
    def of_phrases(cls, phrases: list[bytes], counts) -> CountTransducer:
        """Phrases of space-separated words, each once."""
        split = [p.split(b" ") for p in phrases]
        words = sorted({w for p in split for w in p} | {END})
        rank = {w: i for i, w in enumerate(words)}
        ids = np.zeros((len(split), DEPTH), dtype=np.int64)
        for i, p in enumerate(split):
            ids[i, :len(p)] = [rank[w] for w in p]
        return cls.build(words, *sum_paths(ids, np.asarray(counts, dtype=np.int64)))

    def to_bytes(self) -> bytes:
        return pickle.dumps((b" ".join(self.words), [[_small(x) for x in level] for level in self.levels]), protocol=5)

    @classmethod
    def from_bytes(cls, raw: bytes) -> CountTransducer:
        words, levels = pickle.loads(raw)
        return cls(words.split(b" "), [(d.astype(np.int64), x.astype(np.int32), v.astype(np.int64)) for d, x, v in levels])

    def paths(self) -> tuple[np.ndarray, np.ndarray]:
        """All paths, sorted, and their counts."""
        at, found = np.zeros(1, dtype=np.int64), []
        for degree, labels, values in self.levels:
            n = degree[at]
            arcs = _ranges(_offsets(degree)[at], n)
            found = [np.repeat(c, n) for c in found] + [labels[arcs]]
            at = values[arcs]
        return np.stack(found, axis=1), at

    @classmethod
    def union(cls, parts: Iterable[CountTransducer]) -> CountTransducer:
        """The paths of all, with their counts added."""
        parts = list(parts)
        words = sorted({END}.union(*(p.words for p in parts)))
        rank = {w: i for i, w in enumerate(words)}
        ids, counts = [np.zeros((0, DEPTH), dtype=np.int32)], [np.zeros(0, dtype=np.int64)]
        for p in parts:
            own, n = p.paths()
            ids.append(np.fromiter((rank[w] for w in p.words), dtype=np.int32, count=len(p.words))[own])
            counts.append(n)
        del rank, parts
        ids, counts = np.concatenate(ids), np.concatenate(counts)
        return cls.build(words, *sum_paths(ids, counts))

    def totals(self) -> list[np.ndarray]:
        """Of every state, the sum of the counts of the paths from it."""
        below, out = None, []
        for degree, labels, values in self.levels[::-1]:
            arcs = values if below is None else below[values]
            sums = np.concatenate([[0], np.cumsum(arcs)])
            ends = np.cumsum(degree)
            below = sums[ends] - sums[ends - degree]
            out.append(below)
        return out[::-1]

    def prefixes(self, least: int) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each length from 0 to ``DEPTH``: the prefixes (rows of symbols,
        none the end symbol) with a total of ``least`` or more, and those that
        other automata may continue: the ones of the first and the last path."""
        totals = self.totals()
        at, found = np.zeros(1, dtype=np.int64), np.zeros((1, 0), dtype=np.int64)
        left, right = np.ones(1, dtype=bool), np.ones(1, dtype=bool)
        out = [(found, totals[0])]
        for d, (degree, labels, values) in enumerate(self.levels):
            n = degree[at]
            arcs = _ranges(_offsets(degree)[at], n)
            owner = np.repeat(np.arange(len(at)), n)
            place = np.arange(len(arcs)) - np.repeat(_offsets(n), n)
            left, right = left[owner] & (place == 0), right[owner] & (place == n[owner] - 1)
            weight = values[arcs] if d == DEPTH - 1 else totals[d + 1][values[arcs]]
            stays = ((weight >= least) | left | right) & (labels[arcs] > 0)
            found = np.column_stack([found[owner[stays]], labels[arcs][stays]])
            at, left, right = values[arcs][stays], left[stays], right[stays]
            out.append((found, weight[stays]))
        return out

    def compose(self, asked: CountTransducer) -> tuple[np.ndarray, np.ndarray]:
        """Walks both automata at once: for every path that both have, its
        value in ``asked`` and its value here."""
        rank = {w: i for i, w in enumerate(self.words)}
        mine = np.fromiter((rank.get(w, -1) for w in asked.words), dtype=np.int64, count=len(asked.words))
        theirs = ours = np.zeros(1, dtype=np.int64)
        for (d1, l1, v1), (d2, l2, v2) in zip(asked.levels, self.levels):
            n = d1[theirs]
            arcs = _ranges(_offsets(d1)[theirs], n)
            label, state = mine[l1[arcs]], np.repeat(ours, n)
            base = len(self.words)
            keys = np.repeat(np.arange(len(d2)), d2) * base + l2  # arcs are sorted within a state
            want = state * base + label
            at = np.minimum(np.searchsorted(keys, want), max(len(keys) - 1, 0))
            hit = (label >= 0) & (keys[at] == want) if len(keys) else np.zeros(len(want), dtype=bool)
            theirs, ours = v1[arcs][hit], v2[at[hit]]
        return theirs, ours


def lower_bound(words: list[bytes], path: tuple) -> tuple:
    """The smallest row of numbers of ``words`` that is not below ``path``."""
    out = []
    for w in path:
        i = bisect_left(words, w)
        out.append(i)
        if i == len(words) or words[i] != w:
            break
    return tuple(out + [0] * (DEPTH - len(out)))


def first_not_below(ids: np.ndarray, row: tuple) -> int:
    """Place of the first of the sorted rows that is not below ``row``."""
    return bisect_left(range(len(ids)), row, key=lambda i: tuple(ids[i].tolist()))
