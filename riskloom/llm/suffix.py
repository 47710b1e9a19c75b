"""Linear suffix grouping: Lyndon-prefix groups in descending order, then one ordering sweep."""

from __future__ import annotations


def suffix_order(s: list[int]) -> list[int]:
    """Suffix array of positive integers, by the grouping construction.

    First part: suffixes are grouped by first symbol, and groups are taken in descending order. For
    each suffix of a group, `before` points to the nearest earlier suffix of a lower group; the group's
    common prefix follows right after what that suffix is grouped by, once or several times in a row.
    So those suffixes leave their group for a new one just above it, the more repeats the higher.
    At the end groups are in order and hold suffixes with the same longest Lyndon prefix. Second
    part: suffixes are placed in ascending order; placing p places every suffix whose Lyndon prefix
    ends where p starts, which are p - 1 and its chain of pointers, next in their groups."""
    n = len(s)
    if not n:
        return []
    starts: dict[int, list[int]] = {}
    for i, c in enumerate(s):
        starts.setdefault(c, []).append(i)
    members = [starts[c] for c in sorted(starts)]
    group = [0] * n
    for g, m in enumerate(members):
        for i in m:
            group[i] = g
    k = len(members)
    lower, higher = list(range(-1, k - 1)), [*range(1, k), -1]
    before, taken, order = [-1] * n, bytearray(n), []
    g = k - 1
    while g >= 0:
        own = [i for i in members[g] if group[i] == g]
        own.sort()
        for i in own:
            taken[i] = 1
        times: dict[int, int] = {}
        for i in own:
            p = i - 1
            while p >= 0 and taken[p]:
                p = before[p]
            before[i] = p
            if p >= 0:
                times[p] = times.get(p, 0) + 1
        if times:
            by: dict[int, list[int]] = {}
            for p, t in times.items():
                by.setdefault(t, []).append(p)
            for t in sorted(by, reverse=True):
                moved: dict[int, int] = {}
                for p in by[t]:
                    old = group[p]
                    new = moved.get(old)
                    if new is None:
                        new = moved[old] = len(members)
                        members.append([])
                        up = higher[old]
                        lower.append(old)
                        higher.append(up)
                        higher[old] = new
                        if up >= 0:
                            lower[up] = new
                    members[new].append(p)
                    group[p] = new
        if own:
            order.append((g, len(own)))
        g = lower[g]
    at = [0] * len(members)
    place = 0
    for g, size in reversed(order):
        at[g] = place
        place += size
    out, placed = [-1] * n, bytearray(n)
    i = -1  # the empty suffix comes first
    while i < n:
        p = (n if i < 0 else out[i]) - 1
        while p >= 0 and not placed[p]:
            g = group[p]
            out[at[g]] = p
            at[g] += 1
            placed[p] = 1
            p = before[p]
        i += 1
    return out
