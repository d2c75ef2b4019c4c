"""Ranking the scores of two blocks takes room by the rows ranked at once, copies or not."""

import tracemalloc

import numpy as np
import pytest

from binloom.operators import similarity


@pytest.mark.parametrize("copies", [0, 1500])
def test_a_tile_of_scores_is_ranked_in_little_room(copies):
    rng = np.random.default_rng(copies)
    x = rng.normal(size=(6000, 8))
    x[:copies] = x[0]
    a, k = similarity.unit(x), 7
    keys = rng.permutation(len(x))
    order = np.argsort(keys)  # blocks are in order of keys
    tracemalloc.start()
    got = similarity._best(keys[order][:3000], keys[order], a[order][:3000], a[order], k)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 24e6
    for row in range(0, 3000, 97):
        score = np.round(a[order][row] @ a[order].T, 6)
        want = sorted(zip(-score, keys[order]))[:k]
        mine = slice(row * k, row * k + k)
        assert got["i"].to_numpy()[mine].tolist() == [keys[order][row]] * k and got["j"].to_numpy()[mine].tolist() == [j for _, j in want]


def test_few_rows_and_none():
    x = similarity.unit(np.arange(1.0, 13.0).reshape(3, 4))
    keys = np.arange(3)
    for k in (2, 3, 5):
        assert similarity._best(keys, keys, x, x, k).num_rows == 3 * min(k, 3)
    assert similarity._best(keys, keys[:0], x, x[:0], 2).num_rows == 0
