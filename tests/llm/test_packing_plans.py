"""Plans for lengths that simple rules pack badly, against plain best fit and lower bounds."""

import bisect
import collections
import random

import pytest

pytest.importorskip("decidra.llm")
from decidra.llm import packing  # noqa: E402


def plain_best_fit(counts, capacity):
    rooms = []
    for x in sorted(counts, reverse=True):
        for _ in range(counts[x]):
            k = bisect.bisect_left(rooms, x)
            bisect.insort(rooms, (rooms.pop(k) if k < len(rooms) else capacity) - x)
    return len(rooms)


def used_sound(plan, counts, capacity):
    used = collections.Counter()
    for chosen, times in plan:
        assert times > 0 and sum(chosen) <= capacity
        for x in chosen:
            used[x] += times
    return used == collections.Counter(counts)


def test_best_fit_of_counts_is_best_fit_of_pieces():
    rng = random.Random(1)
    for _ in range(150):
        capacity = rng.randrange(5, 60)
        counts = collections.Counter(rng.randrange(1, capacity + 1) for _ in range(rng.randrange(1, 80)))
        plan = packing.best_fit(counts, capacity)
        assert used_sound(plan, counts, capacity) and sum(t for _, t in plan) == plain_best_fit(counts, capacity)
    assert packing.best_fit({}, 9) == []
    assert sum(t for _, t in packing.best_fit({1: 10**9, 2000: 3}, 2048)) == -(-(10**9 - 3 * 48) // 2048) + 3  # by lengths, not by pieces


@pytest.mark.parametrize("low, high, n, gap", [(600, 900, 3000, 0.025), (400, 1100, 2000, 0.01), (300, 700, 2000, 0.015)])
def test_never_above_best_fit_and_near_the_bound(low, high, n, gap):
    rng = random.Random(low)
    counts = collections.Counter(rng.randint(low, high) for _ in range(n))
    plan = packing.pack_counts(counts, 2048)
    assert used_sound(plan, counts, 2048)
    bound = max(packing.lower_bound(counts, 2048), packing.relaxed(*packing.coarse(counts, 2048, up=False)[:2])[0])
    assert bound <= sum(t for _, t in plan) <= min(plain_best_fit(counts, 2048), bound * (1 + gap))


def test_relaxation_bounds_every_packing():
    rng = random.Random(2)
    for _ in range(25):
        capacity = rng.randrange(6, 14)
        counts = collections.Counter(rng.randrange(1, capacity + 1) for _ in range(rng.randrange(1, 8)))
        pieces = sorted(counts.elements(), reverse=True)

        def fewest(k, rooms):
            if k == len(pieces):
                return len(rooms)
            x = pieces[k]
            return min([fewest(k + 1, rooms + [capacity - x])] + [fewest(k + 1, rooms[:i] + [r - x] + rooms[i + 1 :]) for i, r in enumerate(rooms) if r >= x])

        best = fewest(0, [])
        assert packing.relaxed(counts, capacity)[0] <= best == sum(t for _, t in packing.pack_counts(counts, capacity))
