"""Suffix arrays by linear grouping.

Phase 1 refines groups of suffixes that share a Lyndon prefix. Groups are taken from the greatest down; every suffix of a
group points to the nearest earlier suffix of a lower group (its previous smaller one), and each suffix pointed at moves to
a new group just above its old one: its Lyndon prefix grows by as many copies of the group's word as point at it.
Phase 2 scans the array from the left. Each suffix placed releases, along the previous-smaller pointers, those that it
follows, and each of them takes the next place of its own group. Nothing is renamed and nothing recurs.
"""
from __future__ import annotations


def suffix_array(text: list[int]) -> list[int]:
    """Starts of the suffixes of ``text`` (any integers) in ascending order; a suffix sorts before its extensions."""
    n = len(text)
    if n < 2:
        return list(range(n))
    t = [*text, min(text) - 1]  # the end is smaller than all
    n += 1
    order = sorted(range(n), key=t.__getitem__)
    place = [0] * n
    group = [0] * n  # of a suffix: the first index of its group in ``order``
    size = [0] * n  # of a group
    start = 0
    for k, i in enumerate(order):
        if k and t[i] != t[order[k - 1]]:
            start = k
        place[i], group[i] = k, start
        size[start] += 1
    before = [-1] * n  # previous smaller pointers
    end = n
    while end > 0:
        first = group[order[end - 1]]
        votes: dict[int, int] = {}
        for i in sorted(order[first:end]) if end - first > 1 else (order[first],):
            p = i - 1
            while p >= 0 and group[p] >= first:
                p = before[p]
            before[i] = p
            if p >= 0:
                votes[p] = votes.get(p, 0) + 1
        end = first
        if not votes:
            continue
        moves: dict[tuple[int, int], list[int]] = {}
        for p, n_votes in votes.items():
            key = (n_votes, group[p])
            if key in moves:
                moves[key].append(p)
            else:
                moves[key] = [p]
        for key in sorted(moves, reverse=True) if len(moves) > 1 else moves:  # many copies first: they end up higher
            old, movers = key[1], moves[key]
            left = size[old]
            for p in movers:
                left -= 1
                at, last = place[p], old + left
                other = order[last]
                order[at], order[last] = other, p
                place[other], place[p] = at, last
            if left:
                new = old + left
                for p in movers:
                    group[p] = new
                size[old], size[new] = left, len(movers)
    free = list(range(n))  # next place of a group
    out = [-1] * n
    placed = [False] * n
    out[0] = n - 1
    placed[n - 1] = True
    for k in range(n):
        p = out[k] - 1
        while p >= 0 and not placed[p]:
            placed[p] = True
            out[free[group[p]]] = p
            free[group[p]] += 1
            p = before[p]
    return out[1:]
