"""Suffix arrays in numpy: refinement by doubling and binary search.

Symbols are positive integers; 0 ends a string and matches nothing, not even another 0.
"""

from __future__ import annotations

import numpy as np

from casario.llm.arrays import mix, powers, slice_hashes


def run_lengths(codes: np.ndarray) -> np.ndarray:
    """Symbols from each place to the next 0."""
    stops = np.flatnonzero(codes == 0)
    places = np.arange(len(codes))
    if not len(stops):
        return len(codes) - places
    following = np.searchsorted(stops, places)
    return np.append(stops, len(codes))[following] - places


def packed_keys(codes: np.ndarray, places: np.ndarray, runs: np.ndarray) -> tuple[np.ndarray, int]:
    """Sort keys of as many leading symbols as fit 63 bits, and that number."""
    bits = max(int(codes.max(initial=0)).bit_length(), 1)
    depth = max(63 // bits, 1)
    keys = np.zeros(len(places), dtype=np.int64)
    for k in range(depth):
        at = np.minimum(places + k, len(codes) - 1)
        keys = (keys << bits) | np.where(k < runs[places], codes[at], 0)
    return keys, depth


def suffix_array(codes: np.ndarray, depth: int) -> np.ndarray:
    """Places of the non-zero symbols, sorted by their suffixes up to ``depth`` symbols or the next 0.

    Larsson and Sadakane's refinement: suffixes sorted by their first h symbols are ranked, and those that
    still tie are sorted by the rank of the place h further on, which doubles h. Settled groups are left alone.
    """
    runs = run_lengths(codes)
    places = np.flatnonzero(codes)
    if not len(places):
        return places
    keys, h = packed_keys(codes, places, runs)
    order = np.argsort(keys, kind="stable")
    sa, keys = places[order], keys[order]
    rank = np.zeros(len(codes) + 1, dtype=np.int64)
    new = np.ones(len(sa), dtype=bool)
    new[1:] = keys[1:] != keys[:-1]
    slots = np.arange(len(sa))
    active, group = slots, None
    while True:
        # the rank of a group is one more than its first slot
        group = active[np.maximum.accumulate(np.where(new, np.arange(len(active)), 0))] + 1
        rank[sa[active]] = group
        tied = ~new
        tied[:-1] |= ~new[1:]
        tied &= runs[sa[active]] > h  # a shorter string has been compared to its end
        active, group = active[tied], group[tied]
        if not len(active) or h >= depth:
            return sa
        # ties that ended were dropped, so what is left of a group may lie at any of its slots
        members = sa[active]
        further = rank[members + h]
        order = np.lexsort((further, group))
        sa[active] = members[order]
        group, further = group[order], further[order]
        new = np.ones(len(active), dtype=bool)
        new[1:] = (group[1:] != group[:-1]) | (further[1:] != further[:-1])
        h *= 2


def _below(codes: np.ndarray, at: np.ndarray, symbols: np.ndarray, starts: np.ndarray, lengths: np.ndarray, after: bool) -> np.ndarray:
    """Whether the suffix at each place sorts before its query; with ``after``, also if it starts with it."""
    verdict = np.full(len(at), after)
    undecided = np.arange(len(at))
    for k in range(int(lengths.max(initial=0))):
        undecided = undecided[k < lengths[undecided]]
        if not len(undecided):
            break
        place = at[undecided] + k
        have = codes[np.minimum(place, len(codes) - 1)]
        want = symbols[starts[undecided] + k]
        differ = have != want
        verdict[undecided[differ]] = have[differ] < want[differ]
        undecided = undecided[~differ]
    return verdict


def find(codes: np.ndarray, sa: np.ndarray, queries: np.ndarray, lengths: np.ndarray, starts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Range of slots of ``sa`` whose suffixes start with each query, by binary search of all queries at once.

    ``queries`` is padded with anything beyond ``lengths``, or flat with the ``starts`` of the queries in it. An empty
    range lies where the query would.
    """
    if starts is None:
        starts, queries = np.arange(len(queries)) * queries.shape[1], queries.ravel()
    bounds = []
    for after in (False, True):
        low, high = np.zeros(len(starts), dtype=np.int64), np.full(len(starts), len(sa), dtype=np.int64)
        while True:
            going = np.flatnonzero(low < high)
            if not len(going):
                break
            middle = (low[going] + high[going]) // 2
            below = _below(codes, sa[middle], queries, starts[going], lengths[going], after)
            low[going[below]] = middle[below] + 1
            high[going[~below]] = middle[~below]
        bounds.append(low)
    return bounds[0], bounds[1]


def symbol_sums(codes: np.ndarray) -> np.ndarray:
    """Running sums from which ``slice_hashes`` gives the hash of any run of symbols."""
    forward, _ = powers(len(codes) + 1)
    sums = np.zeros(len(codes) + 1, dtype=np.uint64)
    np.cumsum((mix(codes.astype(np.uint64) + np.uint64(1)) | np.uint64(1)) * forward[: len(codes)], out=sums[1:])
    return sums


def shared_length(sums: np.ndarray, at: np.ndarray, other_sums: np.ndarray, other: np.ndarray, most: np.ndarray) -> np.ndarray:
    """Symbols, up to ``most``, that places ``at`` and ``other`` of two texts have in common at their starts.

    Halving by hashes, so a long match takes few steps.
    """
    low, high = np.zeros(len(at), dtype=np.int64), most.astype(np.int64)
    while (going := np.flatnonzero(low < high)).size:
        middle = (low[going] + high[going] + 1) // 2
        same = slice_hashes(sums, at[going], at[going] + middle) == slice_hashes(other_sums, other[going], other[going] + middle)
        low[going[same]] = middle[same]
        high[going[~same]] = middle[~same] - 1
    return low
