"""Runs of bytes in many texts at once, and their groups of equal bytes, in numpy.

The texts lie side by side in one UTF-8 buffer; a table of 256 entries says which bytes
belong to a run. Runs are grouped by a 64-bit hash, and every run is then compared byte by
byte with the first of its group, so groups are exact.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

from corpusloom.llm.wordhash import _BYTES as BYTES
from corpusloom.llm.wordhash import mix, sliding

#: Bytes looked at together; a run that is longer is taken whole.
BLOCK = 1 << 20


def runs(data: np.ndarray, offsets: np.ndarray, member: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(starts, ends) of the longest runs of member bytes within a text, a block at a time; no run is cut."""
    at, size = 0, len(data)
    while at < size:
        end = min(size, at + BLOCK)
        if end < size:
            # on to the next byte that is in no run, or to the text's end
            stop = int(offsets[np.searchsorted(offsets, end, "left")])
            while end < stop and member[data[end]]:
                free = np.flatnonzero(~member[data[end : min(stop, end + BLOCK)]])
                end = end + int(free[0]) if len(free) else min(stop, end + BLOCK)
        mask = member[data[at:end]]
        first, last = mask.copy(), mask.copy()
        first[1:] &= ~mask[:-1]
        last[:-1] &= ~mask[1:]
        lo, hi = np.searchsorted(offsets, [at, end])
        cuts = offsets[lo:hi] - at
        cuts = cuts[(cuts > 0) & (cuts < end - at)]
        first[cuts], last[cuts - 1] = mask[cuts], mask[cuts - 1]
        yield np.flatnonzero(first) + at, np.flatnonzero(last) + 1 + at
        at = end


def _places(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Positions of all bytes of the runs, one run after the other."""
    before = np.cumsum(lengths) - lengths
    return np.arange(int(lengths.sum())) + np.repeat(starts - before, lengths)


def grouped(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first, group): the first run of each group of equal bytes, and each run's group."""
    _, first, group = np.unique(hashes, return_index=True, return_inverse=True)
    group = group.reshape(-1)
    lengths = ends - starts
    like = first[group]
    wrong = lengths != lengths[like]
    step = 1 << 18
    for a in range(0, len(starts), step):
        own = a + np.flatnonzero(~wrong[a : a + step])
        if len(own):
            differ = data[_places(starts[own], lengths[own])] != data[_places(starts[like[own]], lengths[own])]
            wrong[own] = np.logical_or.reduceat(differ, np.cumsum(lengths[own]) - lengths[own])
    if wrong.any():  # hashes met by chance: runs that differ from their first form groups of their own
        added: dict[bytes, int] = {}
        extra = []
        for k in np.flatnonzero(wrong).tolist():
            own = data[starts[k] : ends[k]].tobytes()
            if own not in added:
                added[own] = len(first) + len(extra)
                extra.append(k)
            group[k] = added[own]
        first = np.concatenate([first, np.array(extra, first.dtype)])
    return first, group


def spans_of(counts: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Positions start, start + 1, ... of each span, one span after the other."""
    return _places(starts, counts)


def hashed(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each run: a polynomial in its bytes, mixed, all runs at once."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    at, to = int(starts[0]), int(ends[-1])
    return mix(sliding(data[at:to].astype(np.uint64) + np.uint64(1), starts - at, ends - at, BYTES))
