"""Bin completion against the fewest sequences by brute force."""

import random
from collections import Counter

from girthkit.llm.packing import best_fit, complete_bins, fillings, least_sequences


def fewest(items, capacity):
    """Every piece into every open sequence or a new one, by iterated depth."""
    items = sorted(items, reverse=True)

    def fits(at, rooms):
        if at == len(items):
            return True
        return any(fits(at + 1, rooms[:i] + (r - items[at],) + rooms[i + 1 :]) for i, r in enumerate(rooms) if r >= items[at] and r not in rooms[:i])

    number = 1
    while not fits(0, (capacity,) * number):
        number += 1
    return number


def test_optimal_where_best_fit_is_not():
    rng, better = random.Random(11), 0
    for _ in range(600):
        capacity = rng.choice([10, 20, 50])
        items = [rng.randint(1, capacity * 2 // 3) for _ in range(rng.randint(1, 11))]
        counts = Counter(items)
        plan = complete_bins(counts, capacity)
        want = fewest(items, capacity)
        assert sum(n for n, _ in plan) == want >= least_sequences(counts, capacity)
        assert sum((Counter({x: n * k for x, k in Counter(c).items()}) for n, c in plan), Counter()) == counts
        assert all(sum(c) <= capacity for _, c in plan)
        better += sum(n for n, _ in best_fit(counts, capacity)) > want
    assert better >= 3


def test_fillings_are_the_undominated_ones():
    # 7 = 4+3 = 4+2+1 = 3+3+1 ..., of which 4+3 holds pieces that cover the rest
    assert fillings(7, [4, 3, 2, 1], {4: 1, 3: 2, 2: 1, 1: 1}, [1000]) == [(4, 3)]
    assert fillings(9, [6, 5, 4], {6: 1, 5: 1, 4: 1}, [1000]) == [(5, 4), (6,)]
    assert fillings(3, [5, 4], {5: 1, 4: 1}, [1000]) == [()]


def test_fewer_uses_of_a_filling():
    # twice 6+4 leaves 5 5 5 5 3 3 3 1: what is best depends on how often it is used
    items = [6] * 3 + [4] * 3 + [5] * 3 + [3] * 4 + [1] * 3
    assert sum(n for n, _ in complete_bins(Counter(items), 10)) == fewest(items, 10)


def test_bound_of_pieces_over_half():
    assert least_sequences({6: 5}, 10) == 5
    assert least_sequences({6: 4, 5: 3}, 10) == 6
    assert least_sequences({}, 10) == 0 and complete_bins({}, 10) == []


def test_memory_of_a_deep_search():
    """A level keeps no histogram of its own: the driver holds the search."""
    import tracemalloc

    rng = random.Random(3)
    counts = {length: rng.randint(1, 4) for length in range(682, 1300)}
    tracemalloc.start()
    plan = complete_bins(counts, 2048, nodes=700, steps=20_000)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    held = Counter()
    for times, content in plan:
        assert sum(content) <= 2048
        for x in content:
            held[x] += times
    assert held == counts
    assert most < 7 << 20, most
