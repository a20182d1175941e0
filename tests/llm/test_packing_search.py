"""The packing's local search against brute force."""

import itertools
import random

import numpy as np
import pytest

from runledger.llm import packing as P


def best_gain(receiver, donor, gap):
    """The most that a move or an exchange (1:1, 1:2, 2:1) can put into the receiver."""
    gains = [0]
    for back in itertools.chain(*(itertools.combinations(receiver, k) for k in range(3))):
        for taken in itertools.chain(*(itertools.combinations(donor, k) for k in (1, 2))):
            if (len(back), len(taken)) in ((0, 1), (1, 1), (1, 2), (2, 1)):
                gains.append(sum(taken) - sum(back))
    return max(g for g in gains if g <= gap)


@pytest.mark.parametrize("seed", range(40))
def test_step_is_the_best_of_all(seed):
    rng = random.Random(seed)
    sizes = [rng.randint(1, 60) for _ in range(12)]
    cut = rng.randint(1, 11)
    receiver, donor = sorted(range(cut), key=sizes.__getitem__), sorted(range(cut, 12), key=sizes.__getitem__)
    gap = rng.randint(1, 40)
    gain, back, taken = P._step(sizes, receiver, donor, gap)
    assert gain == best_gain([sizes[i] for i in receiver], [sizes[i] for i in donor], gap)
    if gain:
        assert sum(sizes[i] for i in taken) - sum(sizes[i] for i in back) == gain
        assert set(back) <= set(receiver) and set(taken) <= set(donor) and len({*back, *taken}) == len(back) + len(taken)


@pytest.mark.parametrize("low,high,n", [(300, 1100, 300), (20, 1500, 200), (900, 1200, 120), (1, 80, 200)])
def test_search_ends_where_no_bin_can_give(low, high, n):
    rng = np.random.default_rng(n)
    lengths = rng.integers(low, high + 1, n)
    start = P.best_fit(lengths, 2048)
    bins = P.local_search(start, lengths, 2048)
    assert sorted(i for b in bins for i in b) == list(range(n))
    fills = [int(lengths[b].sum()) for b in bins]
    assert max(fills) <= 2048 and len(bins) <= len(start)
    if len(bins) > -(-int(lengths.sum()) // 2048):
        for r, d in itertools.permutations(range(len(bins)), 2):
            if fills[d] <= fills[r] < 2048 and (fills[d], d) != (fills[r], r):
                gain = best_gain([int(lengths[i]) for i in bins[r]], [int(lengths[i]) for i in bins[d]], 2048 - fills[r])
                assert gain == 0, (fills[r], fills[d])
