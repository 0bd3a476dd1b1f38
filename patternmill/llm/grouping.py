"""Suffix arrays by linear grouping construction.

Phase 1 groups suffixes by their Lyndon prefixes: groups are taken in descending order; each suffix of the group
points to the nearest suffix to its left in a smaller group (its previous smaller one), and the suffixes pointed to
move behind the rest of their own group, those pointed to more often further. Phase 2 goes through the finished
positions in ascending order and follows the same pointers to emit each group's order. Nothing is renamed and no
smaller problem is solved.
"""

from __future__ import annotations

from collections.abc import Sequence


def suffix_array(text: Sequence[int]) -> list[int]:
    """The start positions of all suffixes of a sequence of whole numbers in ascending order.

    The last number must be smaller than all others (a sentinel); ValueError if not. An empty text has no suffixes.
    """
    n = len(text)
    if not n:
        return []
    slots = sorted(range(n), key=text.__getitem__)
    if n > 1 and (slots[0] != n - 1 or text[slots[1]] == text[n - 1]):
        raise ValueError("the text must end with a number smaller than all others")
    place = [0] * n
    start = [0] * n  # of a suffix: the first slot of its group
    size = [0] * n  # of a group, by its first slot
    first = 0
    for k, i in enumerate(slots):
        if text[i] != text[slots[first]]:
            first = k
        place[i], start[i] = k, first
        size[first] += 1
    before = [-1] * n
    end = n
    while end:
        low = start[slots[end - 1]]
        if end - low == 1:
            i = slots[low]
            p = i - 1
            while p >= 0 and start[p] >= low:
                p = before[p]
            before[i] = p
            if p >= 0:
                g = start[p]
                m = size[g] - 1
                if m:
                    to, at = g + m, place[p]
                    other = slots[to]
                    slots[at], place[other] = other, at
                    slots[to], place[p] = p, to
                    size[g], size[to], start[p] = m, 1, to
            end = low
            continue
        pointed: dict[int, int] = {}
        most = 1
        for i in sorted(slots[low:end]):
            p = i - 1
            while p >= 0 and start[p] >= low:
                p = before[p]
            before[i] = p
            if p >= 0:
                if p in pointed:
                    pointed[p] += 1
                    most = max(most, pointed[p])
                else:
                    pointed[p] = 1
        for often in sorted(set(pointed.values()), reverse=True) if most > 1 else (1,):
            moved: dict[int, list[int]] = {}
            for p, times in pointed.items():
                if times == often:
                    moved.setdefault(start[p], []).append(p)
            for g, those in moved.items():
                k = len(those)
                rest = size[g] - k
                if not rest:
                    continue
                to = new = g + rest
                for p in those:
                    at, other = place[p], slots[to]
                    slots[at], place[other] = other, at
                    slots[to], place[p] = p, to
                    start[p] = new
                    to += 1
                size[g], size[new] = rest, k
        end = low
    free = list(range(n))  # the next slot of a group, by its first slot
    done = bytearray(n)
    out = [-1] * n
    out[0] = n - 1
    done[n - 1] = 1
    free[0] = 1
    for k in range(n):
        j = out[k] - 1
        while j >= 0 and not done[j]:
            g = start[j]
            out[free[g]] = j
            free[g] += 1
            done[j] = 1
            j = before[j]
    return out
