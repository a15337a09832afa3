"""Linear suffix sorting by Lyndon grouping (Baier, "Linear-time Suffix Sorting", CPM 2016).

The Lyndon prefix of a suffix reaches up to the next smaller suffix. Suffixes are first grouped by Lyndon prefix, the groups in
lexicographic order; then each group is put in order from what follows the prefix, which is a smaller suffix and so
has its place already. Nothing is renamed and nothing recurses.
"""

from __future__ import annotations

from collections.abc import Sequence


def suffix_array(symbols: Sequence[int]) -> list[int]:
    """The starts of all suffixes in lexicographic order; a suffix sorts before those that it is a prefix of."""
    n = len(symbols)
    if not n:
        return []
    group, members, below, above = _first_groups(symbols)
    smaller = [-1] * n  # start of the previous smaller suffix
    done = bytearray(n)
    now = len(members) - 1  # the greatest
    final = []
    while now >= 0:
        own = sorted(i for i in members[now] if group[i] == now)
        children: dict[int, int] = {}
        for i in own:
            j = i - 1
            while j >= 0 and done[j]:  # pointers of greater groups, and of this one further left, lead past them
                j = smaller[j]
            smaller[i] = j
            done[i] = 1
            if j >= 0:
                children[j] = children.get(j, 0) + 1
        if own:
            final.append((now, len(own)))
        _split(children, group, members, below, above)
        now = below[now]

    # ascending: each suffix that has its place gives one to those whose Lyndon prefix ends where it starts
    free, at = {}, 0
    for g, size in reversed(final):
        free[g] = at
        at += size
    order = [0] * n

    def place(j: int, stop: int) -> None:
        while j != stop:
            g = group[j]
            order[free[g]] = j
            free[g] += 1
            j = smaller[j]

    place(n - 1, -1)
    for r in range(n):
        i = order[r]
        place(i - 1, smaller[i])
    return order


def _first_groups(symbols: Sequence[int]):
    """Groups by first symbol, numbered in ascending order: group of each suffix, members, and the neighbours of each group."""
    number = {s: k for k, s in enumerate(sorted(set(symbols)))}
    group = [number[s] for s in symbols]
    members: list[list[int]] = [[] for _ in number]
    for i, g in enumerate(group):
        members[g].append(i)
    return group, members, list(range(-1, len(number) - 1)), [*range(1, len(number)), -1]


def _split(children: dict[int, int], group, members, below, above) -> None:
    """Suffixes whose prefix grows by the prefix just finished leave their groups; more repetitions sort higher."""
    grown: dict[int, dict[int, list[int]]] = {}
    for j, count in children.items():
        grown.setdefault(group[j], {}).setdefault(count, []).append(j)
    for old, by_count in grown.items():
        under = old
        for count in sorted(by_count):
            new = len(members)
            members.append(by_count[count])
            for j in by_count[count]:
                group[j] = new
            over = above[under]
            below.append(under)
            above.append(over)
            above[under] = new
            if over >= 0:
                below[over] = new
            under = new
