"""Exact McNemar p for counts of any size."""

import math
import time

from wattlore.operators import policy


def test_tail_agrees_with_whole_numbers():
    for b, c in ((700, 800), (1000, 1), (2000, 2100), (1500, 1500), (0, 1500), (3000, 2500)):
        n, k = b + c, min(b, c)
        want = min(1.0, 2 * sum(math.comb(n, i) for i in range(k + 1)) / 2**n)
        assert math.isclose(policy.binomial_two_sided(b, c), want, rel_tol=1e-9), (b, c)


def test_large_counts_take_no_time():
    began = time.time()
    assert 0 < policy.binomial_two_sided(3_000_000, 3_001_000) < 1
    assert policy.binomial_two_sided(3_000_000, 4_000_000) == 0.0
    assert time.time() - began < 5
