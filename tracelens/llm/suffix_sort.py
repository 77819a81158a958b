"""Linear suffix grouping, many short texts in step.

A suffix array is built in two phases without recursion or renaming. The first groups suffixes by their Lyndon prefix:
groups are taken in descending order; each member looks up its previous smaller suffix, and these pointers move the
suffixes pointed to into new groups right after their own, by how many members point to them. The second phase walks the
array in ascending order and puts each suffix, and those on its pointer chain, at the front of what is left of its group.

Both phases take one group or one array place at a time, so one text alone would be a loop in Python. Here every step is
taken in all texts of a batch at once, as array operations.
"""

from __future__ import annotations

import numpy as np


def _ranges(start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Concatenated start..start+size-1, and which range each number is of."""
    which = np.repeat(np.arange(len(start)), size)
    return np.arange(len(which)) - np.repeat(np.cumsum(size) - size, size) + start[which], which


def suffix_arrays(texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(order, base): text b's suffixes in order are order[base[b] : base[b] + len(text)], as places in the text.

    Texts are arrays of small non-negative numbers.
    """
    size = np.array([len(t) for t in texts], np.int64) + 2  # a guard in front and the end mark
    base = np.cumsum(size) - size
    total, count = int(size.sum()), len(texts)
    char = np.zeros(total, np.int64)
    inner = np.ones(total, bool)
    inner[base] = inner[base + size - 1] = False
    char[inner] = np.concatenate(texts).astype(np.int64) + 1 if count else 0
    block = np.repeat(np.arange(count), size)

    # groups by first sign, as slices of `suf`: guard and end mark first
    suf = np.lexsort((np.arange(total), char, block)).astype(np.int64)
    place = np.empty(total, np.int64)
    place[suf] = np.arange(total)
    head = np.r_[True, (char[suf[1:]] != char[suf[:-1]]) | (block[suf[1:]] != block[suf[:-1]])] if total else np.zeros(0, bool)
    starts = np.flatnonzero(head)
    sizes = np.zeros(total, np.int64)
    sizes[starts] = np.diff(np.r_[starts, total])
    group = np.empty(total, np.int64)
    group[suf] = np.repeat(starts, sizes[starts])
    prev = np.arange(total) - 1

    live = np.flatnonzero(size > 2)
    end = base[live] + size[live] - 1  # last place of the group to take
    in_p = np.zeros(total, bool)
    while len(live):
        g = group[suf[end]]
        at, which = _ranges(g, end - g + 1)
        member, own = suf[at], g[which]
        j = member - 1
        todo = np.flatnonzero(group[j] >= own)
        while len(todo):
            x = j[todo]
            x = np.where(group[x] > own[todo], prev[x], x - 1)
            j[todo] = x
            todo = todo[group[x] >= own[todo]]
        prev[member] = j
        p = j[j != base[live][which]]  # the guard is no suffix
        if len(p):
            p, times = np.unique(p, return_counts=True)
            old = group[p]
            order = np.lexsort((times, old))
            p, times, old = p[order], times[order], old[order]
            first = np.flatnonzero(np.r_[True, old[1:] != old[:-1]])
            n = np.diff(np.r_[first, len(p)])
            g_old = old[first]
            floor = g_old + sizes[g_old] - n  # the group's last n places become the new groups
            slots, of = _ranges(floor, n)
            # what is in these places and stays goes where the moved ones were
            in_p[p] = True
            here = suf[slots]
            stay = ~in_p[here]
            if stay.any():
                was = place[p]
                away = was[was < floor[of]]
                moved = here[stay]
                suf[away] = moved
                place[moved] = away
            in_p[p] = False
            suf[slots] = p
            place[p] = slots
            run = np.flatnonzero(np.r_[True, (old[1:] != old[:-1]) | (times[1:] != times[:-1])])
            length = np.diff(np.r_[run, len(p)])
            sizes[g_old] -= n
            sizes[slots[run]] = length
            group[p] = np.repeat(slots[run], length)
        end = g - 1
        go = end > base[live] + 1
        live, end = live[go], end[go]

    # second phase: in each text a place to read, or a chain to follow
    order = np.full(total, -1, np.int64)
    order[base] = base + size - 1
    placed = np.zeros(total, bool)
    front = np.arange(total)  # next free place of the group that starts here
    live = np.flatnonzero(size > 2)
    read = base[live].copy()
    j = order[read] - 1
    while len(live):
        stop = (j == base[live]) | placed[j]
        go = np.flatnonzero(~stop)
        if len(go):
            x = j[go]
            at = front[group[x]]
            order[at] = x
            front[group[x]] = at + 1
            placed[x] = True
            j[go] = prev[x]
        halt = np.flatnonzero(stop)
        if len(halt):
            read[halt] += 1
            read[halt] += read[halt] == base[live[halt]] + 1  # the guard's place
            done = read[halt] >= base[live[halt]] + size[live[halt]]
            ok = halt[~done]
            j[ok] = order[read[ok]] - 1
            if done.any():
                keep = np.ones(len(live), bool)
                keep[halt[done]] = False
                live, read, j = live[keep], read[keep], j[keep]
    where, _ = _ranges(base + 2, size - 2)
    _, which = _ranges(base, size - 2)
    return order[where] - base[which] - 1, np.cumsum(size - 2) - (size - 2)
