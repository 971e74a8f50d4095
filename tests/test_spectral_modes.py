"""Modes of sparse graphs, component by component."""

import tracemalloc

import numpy as np
import pytest

from heddle.operators import spectral as S


def normal(i, j, w, n):
    d = np.bincount(np.concatenate([i, j]), np.concatenate([w, w]), n)
    return w / np.sqrt(d[i] * d[j])


def test_many_components_need_no_square_matrix():
    i = np.arange(0, 40_000, 2)
    tracemalloc.start()
    found = S.leading_modes(i, i + 1, np.ones(len(i)), 40_000)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 100e6
    assert [nodes.tolist() for _, nodes, _ in found] == [[2 * c, 2 * c + 1] for c in range(96)]


def test_components_and_iteration_agree_with_one_dense_decomposition(monkeypatch):
    rng = np.random.default_rng(1)
    parts, pairs = [400, 90, 30], []
    for at, size in zip(np.cumsum([0, *parts]), parts):
        pairs += [(at + x, at + int(rng.integers(x))) for x in range(1, size)] + [(at + max(x, y), at + min(x, y)) for x, y in rng.integers(size, size=(size, 2)) if x != y]
    a, b = rng.permutation(sum(parts))[np.array(sorted(set(pairs)))].T
    n = sum(parts)
    v = normal(a, b, rng.uniform(0.1, 1, len(a)), n)
    m = np.zeros((n, n))
    m[a, b] = m[b, a] = v
    mu, u = np.linalg.eigh(m)
    top = u[:, ::-1][:, :96]
    for limit in (S.DENSE, 200):
        monkeypatch.setattr(S, "DENSE", limit)
        found = S.leading_modes(a, b, v, n)
        assert np.allclose([x for x, _, _ in found], mu[::-1][:96], atol=1e-9)
        own = np.zeros((n, 96))
        for c, (_, nodes, x) in enumerate(found):
            own[nodes, c] = x
        assert np.allclose(own @ own.T, top @ top.T, atol=1e-6)


def test_equal_modes_rank_by_the_smallest_id(spark):
    """200 rings of three: 96 of 200 equal modes are kept, those of the smallest ids; other linked ids are outside and become zero."""
    ends = [(x, y) for c in range(200) for x, y in ((c, c + 200), (c + 200, c + 400), (c, c + 400))]
    edges = spark.createDataFrame([(x, y, "similar_to", 1.0, "n") for x, y in ends], "src long, dst long, relation string, weight double, ns string")
    modes = S.basis(S.normalized(S.adjacency(edges, "ns"), "ns"), "ns")
    signal = spark.createDataFrame([("n", x, float(x)) for x in range(601)], "ns string, id long, value double")
    got = {r["id"]: r["value"] for r in S.smooth(signal, modes, "ns", S.low_pass(10.0)).collect()}
    assert got[600] == 600.0
    for x in range(600):
        assert got[x] == pytest.approx(x % 200 + 200 if x % 200 < 96 else 0.0)
