"""Suffix arrays by linear grouping.

Phase 1 sorts suffixes into groups by their longest Lyndon prefix. Groups are
taken from the highest down. Each member's previous smaller suffix (the nearest
position before it that belongs to no finished group) has its own Lyndon prefix
lengthened by the member's. Members of a lower group that were lengthened, and
as often as each other, form a new group right above the rest of theirs.

Phase 2 walks the suffix array upwards. The suffixes whose next smaller suffix
is the one just met lie on the chain of previous-smaller pointers before it;
each takes the next free place of its group. No names are given anew and
nothing recurs.
"""

from __future__ import annotations


def suffix_array(text: bytes) -> list[int]:
    """Start positions of all suffixes of ``text`` in lexicographic order."""
    n = len(text)
    if not n:
        return []
    by_char: dict[int, list[int]] = {}
    for i, c in enumerate(text):
        by_char.setdefault(c, []).append(i)
    members = [by_char[c] for c in sorted(by_char)]
    below = list(range(-1, len(members) - 1))
    above = [*range(1, len(members)), -1]
    group = [0] * n
    for g, m in enumerate(members):
        for i in m:
            group[i] = g
    prev, alive = [-1] * n, list(range(n))
    top = len(members) - 1
    g = top
    while g >= 0:
        own = [i for i in members[g] if group[i] == g]
        members[g] = own
        for i in own:
            alive[i] = i - 1
        grown: dict[int, int] = {}
        for i in own:
            p = i - 1
            while p >= 0 and alive[p] != p:
                p = alive[p]
            q = i - 1
            while q > p:  # shorten the way for later walks
                alive[q], q = p, alive[q]
            prev[i] = p
            if p >= 0:
                grown[p] = grown.get(p, 0) + 1
        if grown:
            split: dict[tuple[int, int], list[int]] = {}
            for p, times in grown.items():
                split.setdefault((group[p], times), []).append(p)
            for h, times in sorted(split, key=lambda k: (k[0], -k[1])):
                new, up = len(members), above[h]
                members.append(split[h, times])
                for p in members[new]:
                    group[p] = new
                below.append(h)
                above.append(up)
                above[h] = new
                if up >= 0:
                    below[up] = new
        g = below[g]
    free, at = [0] * len(members), 0
    g = 0  # nothing is ever put below the first group
    while g >= 0:
        free[g] = at
        at += sum(1 for i in members[g] if group[i] == g)
        g = above[g]
    out = [-1] * n
    r = -1
    while r < n:
        s = out[r] if r >= 0 else n
        stop = prev[s] if r >= 0 else -1
        i = s - 1
        while i > stop:
            out[free[group[i]]] = i
            free[group[i]] += 1
            i = prev[i]
        r += 1
        if r == n:
            break
    return out
