"""Suffix arrays by linear grouping, for many short strings side by side.

The construction has two phases and renames nothing. The first keeps suffixes
in groups, ordered by their prefixes. Groups are taken from the highest down:
every suffix of the group gets a pointer to the nearest suffix before it in a
lower group, and the suffixes so pointed to move up behind the rest of their
own group, by how often they were. When all groups are done each holds the
suffixes of one Lyndon prefix and the pointers lead to the previous smaller
suffix. The second phase walks the suffixes in their final order; the suffix
before each, and those its pointers lead to, take the next places of their
groups.

Both phases are sequential in one string, so they run in step over all strings
of a batch: one array operation takes the highest group of every string.
"""

from __future__ import annotations

import numpy as np


def _ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The ranges starts[i] .. starts[i] + sizes[i] - 1, one after the other."""
    total = int(sizes.sum())
    before = np.cumsum(sizes) - sizes
    return np.repeat(starts - before, sizes) + np.arange(total)


def suffix_arrays(codes: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Suffix arrays of consecutive strings in ``codes``.

    Each string's last code has to be its smallest and occur once. The result
    has, in the places of a string, the places of its suffixes in order.
    """
    offsets = np.cumsum(sizes) - sizes
    total = len(codes)
    owner = np.repeat(np.arange(len(sizes)), sizes)
    order = np.lexsort((codes, owner))
    place = np.empty(total, np.int64)
    place[order] = np.arange(total)
    first = np.ones(total, bool)
    first[1:] = (codes[order][1:] != codes[order][:-1]) | (owner[order][1:] != owner[order][:-1])
    starts = np.flatnonzero(first)
    group = np.empty(total, np.int64)  # of a suffix: where its group begins in the order
    group[order] = np.repeat(starts, np.diff(np.append(starts, total)))
    length = np.zeros(total, np.int64)  # of the group that begins at a place
    length[starts] = np.diff(np.append(starts, total))
    begins = np.zeros(total, bool)
    begins[offsets] = True
    previous = np.arange(total) - 1
    previous[begins] = -1

    tops = offsets + sizes - 1
    low = offsets
    touched = np.zeros(total, bool)
    while len(tops):
        start = group[order[tops]]
        members = order[_ranges(start, tops - start + 1)]
        own = group[members]
        asked = members
        while len(asked):
            at = previous[asked]
            behind = at >= 0
            behind[behind] = group[at[behind]] >= own[behind]
            asked, own = asked[behind], own[behind]
            previous[asked] = previous[at[behind]]
        met = previous[members]
        met = np.sort(met[met >= 0])
        if len(met):
            new = np.ones(len(met), bool)
            new[1:] = met[1:] != met[:-1]
            cuts = np.flatnonzero(new)
            met, times = met[cuts], np.diff(np.append(cuts, len(met)))
            by = np.lexsort((times, group[met]))
            met, times = met[by], times[by]
            homes = group[met]
            change = np.ones(len(met), bool)
            change[1:] = homes[1:] != homes[:-1]
            heads = np.flatnonzero(change)
            counts = np.diff(np.append(heads, len(met)))
            home = homes[heads]
            ends = home + length[home]
            slots = _ranges(ends - counts, counts)
            touched[met] = True
            sitting = order[slots]
            moved = sitting[~touched[sitting]]
            touched[met] = False
            holes = place[met]
            holes = holes[holes < np.repeat(ends - counts, counts)]
            order[holes], place[moved] = moved, holes
            order[slots], place[met] = met, slots
            length[home] -= counts
            change[1:] |= times[1:] != times[:-1]
            heads = np.flatnonzero(change)
            counts = np.diff(np.append(heads, len(met)))
            length[slots[heads]] = counts
            group[met] = np.repeat(slots[heads], counts)
        left = start > low
        tops, low = start[left] - 1, low[left]

    free = np.arange(total)
    out = np.full(total, -1, np.int64)
    placed = np.zeros(total, bool)
    out[offsets] = offsets + sizes - 1
    placed[out[offsets]] = True
    free[offsets] += 1
    by_size = np.argsort(-sizes, kind="stable")
    lasting = np.searchsorted(-sizes[by_size], -np.arange(1, int(sizes.max(initial=0)) + 1), side="right")
    offsets_by_size = offsets[by_size]
    for step, n in enumerate(lasting.tolist()):
        at = out[offsets_by_size[:n] + step]
        at = at[~begins[at]] - 1
        at = at[~placed[at]]
        while len(at):
            home = group[at]
            out[free[home]] = at
            free[home] += 1
            placed[at] = True
            at = previous[at]
            at = at[at >= 0]
            at = at[~placed[at]]
    return out
