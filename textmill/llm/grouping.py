"""Suffix arrays by linear grouping.

Suffixes are first grouped by their first symbol.  Groups are then processed from the
highest to the lowest: each suffix of the group points to the last suffix before it
that is in a lower group (its previous smaller one), and the suffixes that are pointed
at leave their groups for new ones just above, by how many pointers they got.  In the
end a group holds the suffixes that share the longest Lyndon word they begin with.  A
second pass goes up the array and emits each suffix of a group in the order of what
follows that word, by the same pointers; no symbol is ever renamed.

Large groups are processed with numpy at once, small ones step by step.
"""

from __future__ import annotations

import numpy as np

#: Groups of at most so many suffixes are processed step by step.
_SMALL = 24


def suffix_array(symbols: np.ndarray) -> np.ndarray:
    """The starts of all suffixes in order.  The last symbol must be the smallest and unique."""
    n = len(symbols)
    if n < 2:
        return np.arange(n, dtype=np.int32)
    group, before = _lyndon_groups(np.ascontiguousarray(symbols))
    return _emitted(group, before)


def _lyndon_groups(symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For every suffix the place where its group begins, and its previous smaller suffix (-1: none)."""
    n = len(symbols)
    at = np.argsort(symbols, kind="stable").astype(np.int32)  # suffixes, group by group
    ordered = symbols[at]
    first = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]])).astype(np.int32)
    sizes = np.diff(np.append(first, n)).astype(np.int32)
    group = np.empty(n + 1, np.int32)
    group[at] = np.repeat(first, sizes)
    group[n] = -1  # what the place -1 reads: below every group
    place = np.empty(n, np.int32)
    place[at] = np.arange(n, dtype=np.int32)
    size = np.zeros(n, np.int32)
    size[first] = sizes
    before = np.arange(-1, n - 1, dtype=np.int32)
    pointed = np.zeros(n, bool)
    # The same memory, for steps on single suffixes.
    at_, group_, place_, size_, before_ = map(memoryview, (at, group, place, size, before))
    end = n
    while end:
        low = group_[at_[end - 1]]
        m = end - low
        if m == 1:
            j = at_[low] - 1
            if j < 0:
                end = low
                continue
            g = group_[j]
            if g >= low:
                while g >= low:
                    j = before_[j] if j >= 0 else -1
                    g = group_[j]
                before_[at_[low]] = j
                if j < 0:
                    end = low
                    continue
            k = size_[g] - 1
            if k:
                to, here = g + k, place_[j]
                if here != to:
                    other = at_[to]
                    at_[here], place_[other], at_[to], place_[j] = other, here, j, to
                group_[j], size_[g], size_[to] = to, k, 1
        elif m <= _SMALL:
            hits: dict[int, int] = {}
            for q in range(low, end):
                i = at_[q]
                j = i - 1
                while j >= 0 and group_[j] >= low:
                    j = before_[j]
                before_[i] = j
                if j >= 0:
                    hits[j] = hits.get(j, 0) + 1
            if hits:
                moved: dict[tuple[int, int], list[int]] = {}
                for j, k in hits.items():
                    moved.setdefault((-k, group_[j]), []).append(j)
                for (_, g), js in sorted(moved.items()) if len(moved) > 1 else moved.items():
                    to = g + size_[g]
                    for j in js:
                        to -= 1
                        here = place_[j]
                        if here != to:
                            other = at_[to]
                            at_[here], place_[other], at_[to], place_[j] = other, here, j, to
                    size_[g] = to - g
                    size_[to] = len(js)
                    for j in js:
                        group_[j] = to
        else:
            _split_lower(at, group, place, size, before, pointed, low, end)
        end = low
    return group[:n], before


def _split_lower(at: np.ndarray, group: np.ndarray, place: np.ndarray, size: np.ndarray, before: np.ndarray,
                 pointed: np.ndarray, low: int, end: int) -> None:
    """Processes one group: sets its pointers and moves what they point at."""
    own = at[low:end].copy()
    j = before[own]
    far = np.flatnonzero(group[j] >= low)
    while len(far):  # pointers of this very group are being set as well, so their steps double
        j[far] = before[j[far]]
        before[own[far]] = j[far]
        far = far[group[j[far]] >= low]
    j = np.sort(j[j >= 0])
    if not len(j):
        return
    new = np.flatnonzero(np.concatenate([[True], j[1:] != j[:-1]]))
    hit, times = j[new], np.diff(np.append(new, len(j)))
    g = group[hit]
    order = np.lexsort((times, g))
    hit, times, g = hit[order], times[order], g[order]
    of_group = np.concatenate([[True], g[1:] != g[:-1]])
    first = np.flatnonzero(of_group)
    moved = np.diff(np.append(first, len(g)))
    starts = g[first]
    rest = size[starts] - moved
    to = (np.repeat(starts + rest - first, moved) + np.arange(len(g))).astype(np.int32)
    here = place[hit]
    outside = here < np.repeat(starts + rest, moved)
    if outside.any():  # what is in their way takes the places they leave
        pointed[hit] = True
        other = at[to]
        other = other[~pointed[other]]
        pointed[hit] = False
        at[here[outside]] = other
        place[other] = here[outside]
    at[to] = hit
    place[hit] = to
    new = np.flatnonzero(of_group | np.concatenate([[True], times[1:] != times[:-1]]))
    sizes = np.diff(np.append(new, len(g)))
    group[hit] = np.repeat(to[new], sizes)
    size[starts] = rest
    size[to[new]] = sizes


def _emitted(group: np.ndarray, before: np.ndarray) -> np.ndarray:
    n = len(group)
    out, free, done = np.zeros(n, np.int32), np.arange(n, dtype=np.int32), bytearray(n)
    out[0] = n - 1
    done[n - 1] = 1
    out_, free_, group_, before_ = map(memoryview, (out, free, np.ascontiguousarray(group), before))
    for i in range(n):
        j = out_[i] - 1
        while j >= 0 and not done[j]:
            g = group_[j]
            p = free_[g]
            out_[p] = j
            free_[g] = p + 1
            done[j] = 1
            j = before_[j]
    return out
