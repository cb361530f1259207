"""Groups of equal size that are chained together, against one at a time."""

import numpy as np
import pytest

from seqloom.operators import chain

MODES = [chain.ChainMode(), chain.ChainMode("overlaps"), chain.ChainMode("gap_cost"), chain.ChainMode("gap_cost", weight_factor=3.0, cost="max"), chain.ChainMode("global", max_gap=12)]


@pytest.mark.parametrize("mode", MODES)
@pytest.mark.parametrize("n", [1, 2, 5, 9])
def test_same_as_one_group_at_a_time(mode, n):
    r = np.random.default_rng(n)
    groups = []
    for _ in range(60):
        size, s1, s2 = r.integers(1, 9, n), r.integers(0, 40, n), r.integers(0, 40, n)
        at = np.lexsort((s2, s1))
        groups.append((s1[at], (s1 + size - 1)[at], s2[at], (s2 + size - 1)[at], size[at].astype(float)))
    score, of, step, found = chain.equal_groups(*(np.stack(x) for x in zip(*groups, strict=True)), mode)
    for i, g in enumerate(groups):
        [(want, path)] = chain.best_chains(*g, mode)
        own = of == i
        assert set(score[own]) == {want} and found[own][np.argsort(step[own])].tolist() == path and sorted(step[own]) == list(range(len(path)))
