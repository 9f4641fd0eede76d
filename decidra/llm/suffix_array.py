"""Suffix arrays of integer sequences by linear grouping.

Suffixes are grouped by their Lyndon prefixes. Groups are processed in descending order: every suffix of a group points
at the nearest suffix before it that is in a lower group (its previous-smaller pointer), and the suffixes pointed at are
moved, by how many point at them, into new groups right above their old ones. A second pass emits each group's order:
the suffixes in front of one just emitted, along the pointers, come next in their groups. No names are given anew and
nothing is recursive.
"""

from __future__ import annotations

from collections.abc import Sequence


def suffix_array(text: Sequence[int]) -> list[int]:
    """The starts of the suffixes of these non-negative numbers in ascending order (a suffix after its own prefixes)."""
    n = len(text) + 1  # with an end that is smaller than all
    by_symbol: dict[int, list[int]] = {}
    for i, x in enumerate(text):
        by_symbol.setdefault(x, []).append(i)
    members: list[list[int]] = [[n - 1], *(by_symbol[x] for x in sorted(by_symbol))]
    below = list(range(-1, len(members) - 1))
    above = [*range(1, len(members)), -1]
    group = [0] * n
    for g, own in enumerate(members):
        for i in own:
            group[i] = g
    final, pointer, times, emitted = [-1] * n, [-1] * n, [0] * n, []
    done = -1
    current = len(members) - 1
    while current >= 0:
        listed = members[current]
        if len(listed) == 1:
            # most groups of a varied text: one suffix, and one target that moves up alone
            i = listed[0]
            if group[i] != current:
                members[current] = ()
                current = below[current]
                continue
            p = i - 1
            while p >= 0 and group[p] == done:
                p = pointer[p]
            pointer[i] = p
            group[i] = done
            final[i] = len(emitted)
            emitted.append(listed)
            if p >= 0:
                old = group[p]
                if len(members[old]) > 1:
                    new = len(members)
                    members.append([p])
                    up = above[old]
                    below.append(old)
                    above.append(up)
                    above[old] = new
                    if up >= 0:
                        below[up] = new
                    group[p] = new
            current = below[current]
            continue
        # members may have moved on since they were listed
        own = sorted(i for i in listed if group[i] == current)
        members[current] = own
        targets = []
        for i in own:
            p = i - 1
            while p >= 0 and ((g := group[p]) == done or g == current):
                p = pointer[p]
            pointer[i] = p
            if p >= 0:
                if not times[p]:
                    targets.append(p)
                times[p] += 1
        for i in own:
            group[i] = done
            final[i] = len(emitted)
        emitted.append(own)
        if targets:
            if len(targets) > 1:
                targets.sort(key=times.__getitem__, reverse=True)
            made: dict[tuple[int, int], int] = {}
            for p in targets:
                old = group[p]
                key = (old, times[p])
                new = made.get(key)
                if new is None:
                    new = made[key] = len(members)
                    members.append([])
                    up = above[old]
                    below.append(old)
                    above.append(up)
                    above[old] = new
                    if up >= 0:
                        below[up] = new
                members[new].append(p)
                group[p] = new
                times[p] = 0
        current = below[current]
    # a group's first free place
    free, place = [0] * len(emitted), 0
    for g in range(len(emitted) - 1, -1, -1):
        free[g] = place
        place += len(emitted[g])
    out = [-1] * n
    out[0] = n - 1
    free[final[n - 1]] = 1
    final[n - 1] = -1
    for i in range(n):
        j = out[i] - 1
        while j >= 0 and (g := final[j]) >= 0:
            out[free[g]] = j
            free[g] += 1
            final[j] = -1
            j = pointer[j]
    return out[1:]
