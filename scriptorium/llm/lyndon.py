"""Suffix arrays by linear grouping over Lyndon prefixes."""

from __future__ import annotations

import numpy as np

UNSET = -2


def _first_groups(text: np.ndarray) -> tuple[list[int], list[int], list[int], list[int]]:
    """Suffixes by their first symbol, in counting order: order, rank, first rank of each suffix's group, and group sizes at those ranks."""
    counts = np.bincount(text)
    order = np.argsort(text, kind="stable")  # by counting, for symbols of 16 bits
    rank = np.empty_like(order)
    rank[order] = np.arange(len(text))
    begins = np.cumsum(counts) - counts
    size = np.zeros(len(text), np.int64)
    size[begins[counts > 0]] = counts[counts > 0]
    return order.tolist(), rank.tolist(), begins[text].tolist(), size.tolist()


def suffix_array(text: np.ndarray) -> list[int]:
    """Suffix array of a text of small numbers (16 bits) whose last is its only least one.

    First every suffix is put into the group of suffixes with the same longest Lyndon prefix. Groups are
    taken in descending order; for each suffix s of a group the previous-smaller pointer gives the nearest
    suffix before it that stands in a lower group, and that suffix's prefix grows by one copy of the
    group's prefix for each such s. Suffixes of one lower group that grow alike leave it together and form
    the group right above what is left. Then the suffixes are emitted in ascending order: the suffix
    emitted at rank i is preceded in the text by s = i - 1; s, and those reached from it by the pointers,
    take the next places of their groups. Nothing is renamed or sorted: the first groups come from counting,
    pointers of one group that lead through others of it are found together, and the numbers of copies that
    differ within a group, which are few, are taken from the largest down.
    """
    order, rank, start, size = _first_groups(np.asarray(text, np.uint16))
    n = len(order)
    before = [UNSET] * n
    end = n - 1
    while end >= 0:
        low = start[order[end]]
        if low == end:
            s = order[end]
            p = s - 1
            while p >= 0 and start[p] >= low:
                p = before[p]
            before[s] = p
            if p >= 0:
                g = start[p]
                m = size[g]
                if m > 1:
                    m -= 1
                    size[g] = m
                    new = g + m
                    q, at = order[new], rank[p]
                    order[at], order[new] = q, p
                    rank[q], rank[p] = at, new
                    start[p] = new
                    size[new] = 1
        else:
            grown: dict[int, int] = {}
            for s in order[low : end + 1]:
                if before[s] != UNSET:
                    continue
                through, p = [s], s - 1
                while p >= 0 and start[p] >= low:
                    q = before[p]
                    if q == UNSET:  # of this group: its pointer is the same
                        through.append(p)
                        p -= 1
                    else:
                        p = q
                for t in through:
                    before[t] = p
                if p >= 0:
                    grown[p] = grown.get(p, 0) + len(through)
            if len(grown) == 1:
                by_copies = {1: list(grown)}
            else:
                by_copies = {}
                for p, k in grown.items():
                    by_copies.setdefault(k, []).append(p)
            for k in sorted(by_copies, reverse=True) if len(by_copies) > 1 else by_copies:
                moved: dict[int, list[int]] = {}
                for p in by_copies[k]:
                    moved.setdefault(start[p], []).append(p)
                for g, members in moved.items():
                    m = size[g]
                    if len(members) == m:
                        continue
                    for p in members:
                        m -= 1
                        to = g + m
                        q, at = order[to], rank[p]
                        order[at], order[to] = q, p
                        rank[q], rank[p] = at, to
                    size[g] = m
                    new = g + m
                    size[new] = len(members)
                    for p in members:
                        start[p] = new
        end = low - 1
    out, place, done = [0] * n, list(range(n)), bytearray(n)
    out[0] = n - 1
    done[n - 1] = 1
    for i in range(n):
        s = out[i] - 1
        while s >= 0 and not done[s]:
            g = start[s]
            out[place[g]] = s
            place[g] += 1
            done[s] = 1
            s = before[s]
    return out
