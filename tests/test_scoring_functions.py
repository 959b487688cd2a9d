"""Barcodes and matchings against plain definitions, without Spark."""

import itertools
import random

import numpy as np
import pytest
from test_brute_force import bars_of, matched

from dendrovox.operators import scoring as L


@pytest.mark.parametrize("seed", range(12))
def test_barcode_of_random_blocks(seed):
    rnd = random.Random(seed)
    size, levels, share = (rnd.randint(1, 4), rnd.randint(1, 6), rnd.randint(1, 6)), rnd.choice((1, 2, 5, 100)), rnd.choice((0.3, 0.6, 1.0))
    field = {p: rnd.randint(0, levels) / levels for p in itertools.product(*map(range, size)) if rnd.random() < share} or {(0, 0, 0): 0.5}
    birth, death = L._barcode(np.array(list(field)) + 7, np.array(list(field.values())))
    want = [b for b in bars_of(field) if b[0] < b[1]]
    assert sorted(b for b in zip(birth.tolist(), death.tolist(), strict=True) if b[0] < b[1]) == want


@pytest.mark.parametrize("seed", range(40))
def test_bottleneck_of_random_diagrams(seed):
    rnd = random.Random(seed)

    def diagram():
        starts = [rnd.randint(0, 8) / 8 for _ in range(rnd.randint(0, 5))]
        return [(s, s + rnd.randint(1, 8) / 16) for s in starts]

    a, b = diagram(), diagram()
    table = lambda d: np.array(d, float).reshape(-1, 2)
    assert L.bottleneck_distance(table(a), table(b)) == pytest.approx(matched(a, b))


def test_bottleneck_of_large_diagrams_needs_no_square():
    """Ten thousand short intervals, shifted by a thousandth: the distance is the shift, or what is left for the diagonal."""
    n = 10_000
    births = np.arange(n) / n
    a = np.stack([births, births + 0.004], axis=1)
    assert L.bottleneck_distance(a, a) == 0.0
    assert L.bottleneck_distance(a, a + [[0.0, 0.001]]) == pytest.approx(0.001)
    assert L.bottleneck_distance(a, np.empty((0, 2))) == pytest.approx(0.002)
