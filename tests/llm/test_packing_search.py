"""A dive of the packing search ends whatever the node budget, and the plan tells how the search went."""

import random

import numpy as np
import pytest
from millrace.llm import packing


@pytest.mark.parametrize("seed", [2, 3, 7, 9, 15])
def test_dive_is_not_broken_off(seed):
    rnd = random.Random(seed)
    counts = np.bincount([rnd.randint(12, 40) for _ in range(40)], minlength=65).astype(np.int64)
    plan = packing.complete(counts, packing.PackPolicy(capacity=64, max_nodes=3))
    assert plan.sequences == plan.bound == packing.lower_bound(counts, 64) < packing.best_fit(counts, 64).sequences
    assert plan.nodes > 3 and not plan.cut
    back = np.zeros(65, np.int64)
    for filling, times in plan.fillings:
        assert sum(filling) <= 64
        for x in filling:
            back[x] += times
    assert (back == counts).all()
