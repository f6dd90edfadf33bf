"""Surfaces of a large lexicon are found as the pattern finds them, without trying each at every place."""

import random
import time

from wattlore.operators.graph import surface_finder, surface_pattern


def test_lookup_agrees_with_the_pattern():
    rng = random.Random(5)
    letters = "ab1 -油箱铁"
    for _ in range(300):
        surfaces = list({"".join(rng.choices(letters, k=rng.randint(1, 4))) for _ in range(20)})
        text = "".join(rng.choices(letters, k=60))
        want = [(m[0], m.start(), m.end()) for m in surface_pattern(surfaces).finditer(text)]
        assert list(surface_finder(surfaces, small=0)(text)) == want


def test_time_does_not_grow_with_the_lexicon():
    find = surface_finder([f"supplier{i}" for i in range(200_000)])
    began = time.time()
    for i in range(2000):
        assert [s for s, _, _ in find(f"where is supplier{i * 7} now?")] == [f"supplier{i * 7}"]
    assert time.time() - began < 5
