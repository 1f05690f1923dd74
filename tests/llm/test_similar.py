"""Candidates of the pipeline's near-dedup come from each shard's BK-tree."""

import numpy as np
import pytest

from cairn.llm import simhash


def _shard(n, seed):
    rng = np.random.default_rng(seed)
    middle = rng.integers(0, 1 << 63, 12, dtype="u8")
    flips = (rng.random((n, 64)) < 0.08) @ (np.uint64(1) << np.arange(64, dtype="u8"))
    fps = middle[rng.integers(0, 12, n)] ^ flips.astype("u8")
    fps[: n // 4] = fps[0]  # many equal ones
    sizes = np.sort(rng.integers(20, 200, n))
    sketches = np.zeros((n, simhash.BINS), "u1")
    kinds = rng.integers(1, 255, (9, simhash.BINS))
    sketches[:] = kinds[rng.integers(0, 9, n)]
    return fps, sizes, sketches


@pytest.mark.parametrize(("n", "radius"), [(0, 20), (1, 20), (60, 20), (700, 20), (700, 4)])
def test_the_tree_finds_every_near_pair(n, radius):
    fps = _shard(n, n)[0] if n else np.zeros(0, "u8")
    found = {(int(a), int(b)) for x, y in simhash.bk_near(fps, radius) for a, b in zip(x, y)}
    near = np.bitwise_count(fps[:, None] ^ fps[None, :]) <= radius
    assert found == {(int(a), int(b)) for a, b in zip(*np.nonzero(near))}


def test_near_forest_searches_the_tree(monkeypatch):
    fps, sizes, sketches = _shard(500, 3)
    forest = simhash.Forest(500)
    for b in range(500):
        for a in range(b):
            if np.bitwise_count(fps[a] ^ fps[b]) <= 20 and sizes[a] >= np.ceil(0.8 * sizes[b] - 1e-9) and simhash._alike(sketches, np.array([a]), np.array([b]), 0.8)[0]:
                forest.join(np.array([a, b]))
    assert (simhash.near_forest(fps, sizes, sketches, 20, 0.8) == forest.find(np.arange(500))).all()
    monkeypatch.setattr(simhash, "bk_near", lambda fps, radius: iter(()))
    assert (simhash.near_forest(fps, sizes, sketches, 20, 0.8) == np.arange(500)).all()
