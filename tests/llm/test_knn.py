"""Neighbours by collision counting against brute force."""

import base64
import json

import numpy as np
from heddle.llm import knn, vectors


def stored(v, as_list=False):
    return json.dumps({"vector": [float(x) for x in v] if as_list else base64.b64encode(np.asarray(v, "<f4").tobytes()).decode()})


def planted(n=1500, groups=120, seed=5):
    rng = np.random.default_rng(seed)
    base = rng.standard_normal((n, 64))
    near = np.repeat(base[:groups], 2, axis=0)
    near = near / np.linalg.norm(near, axis=1, keepdims=True)
    noise = rng.standard_normal(near.shape)
    noise /= np.linalg.norm(noise, axis=1, keepdims=True)
    return np.vstack([base, near + noise * np.linspace(0.02, 0.42, len(near))[:, None]])


def brute(x, k, floor):
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = u @ u.T
    np.fill_diagonal(s, -2)
    return {(i, int(j)) for i in range(len(s)) for j in np.lexsort((np.arange(len(s)), -s[i]))[:k] if s[i, j] >= floor}


def test_recall_with_many_cells(spark):
    x = planted()
    df = spark.createDataFrame([(i, stored(v, i % 9 == 0), "t") for i, v in enumerate(x)], "id long, json_data string, vec string")
    params = knn.Counting(cell=64)
    assert params.bits(len(x)) > 3
    got = {(r["id"], r["neighbour"]) for r in knn.neighbours(vectors.read_vectors(df, "id", "json_data"), 10, params).collect()}
    want = brute(x, 10, 0.90)
    assert len(want) > 200 and got <= want and len(got & want) >= 0.97 * len(want)


def test_equal_vectors_are_one_class(spark):
    rng = np.random.default_rng(1)
    v, w = rng.standard_normal((2, 64))
    rows = [(i, stored(v)) for i in range(40)] + [(100, stored(v + 0.01 * w)), (200, stored(-v)), (7, stored(v))]
    df = spark.createDataFrame(rows, "id long, json_data string")
    got = {}
    for r in knn.neighbours(vectors.read_vectors(df, "id", "json_data"), 3).collect():
        got.setdefault(r["id"], {})[r["rank"]] = r["neighbour"]
    assert got[0] == {1: 1, 2: 2, 3: 3} and got[39] == {1: 0, 2: 1, 3: 2} and got[100] == {1: 0, 2: 1, 3: 2} and 200 not in got


def test_dense_cell_is_split_and_still_found(spark):
    rng = np.random.default_rng(2)
    center = rng.standard_normal(64)
    x = center + 0.02 * rng.standard_normal((900, 64))
    df = spark.createDataFrame([(i, stored(v)) for i, v in enumerate(x)], "id long, json_data string")
    got = {}
    for r in knn.neighbours(vectors.read_vectors(df, "id", "json_data"), 5, knn.Counting(cell=32)).collect():
        got.setdefault(r["id"], []).append(r["neighbour"])
    assert len(got) >= 0.99 * 900 and sum(len(v) == 5 for v in got.values()) >= 0.9 * 900


def test_dense_cluster_keeps_its_true_neighbours(spark):
    rng = np.random.default_rng(4)
    x = rng.standard_normal(64) + 0.29 * rng.standard_normal((700, 64))
    df = spark.createDataFrame([(i, stored(v)) for i, v in enumerate(x)], "id long, json_data string")
    assert knn.Counting().bits(len(x)) == 0
    got = {(r["id"], r["neighbour"]) for r in knn.neighbours(vectors.read_vectors(df, "id", "json_data"), 10).collect()}
    want = brute(x, 10, 0.90)
    assert len(want) > 6000 and len(got & want) >= 0.995 * len(want) and len(got) <= len(want)


def test_hot_group_is_not_parted(spark):
    rng = np.random.default_rng(9)
    hot = rng.standard_normal(64) + 0.29 * rng.standard_normal((2500, 64))
    x = np.vstack([hot, rng.standard_normal((1000, 64))])
    df = spark.createDataFrame([(i, stored(v)) for i, v in enumerate(x)], "id long, json_data string")
    rows = vectors.read_vectors(df, "id", "json_data")
    want = brute(x, 10, 0.90)
    for more in ({}, {"part": 300}):
        params = knn.Counting(cell=128, **more)
        assert params.bits(len(x)) > 3
        got = {(r["id"], r["neighbour"]) for r in knn.neighbours(rows, 10, params).collect()}
        assert len(want) > 24000 and len(got) <= len(want) and len(got & want) >= 0.97 * len(want)


def test_nearest_ranks_copies_that_differ_in_the_last_bit():
    rng = np.random.default_rng(6)
    v = rng.standard_normal(64)
    x = np.stack([v * s for s in np.linspace(1, 3, 300)]).astype("<f4")
    a, b, cosine = knn.nearest(np.arange(300), x, np.arange(300), x, 10, 0.90, block=64)
    y = x.astype(np.float64)
    for i in (0, 77, 299):
        c = np.array([np.einsum("j,j->", y[i], y[j]) / np.sqrt(np.einsum("j,j->", y[i], y[i]) * np.einsum("j,j->", y[j], y[j])) for j in range(300)])
        c[i] = -2
        assert len(b[a == i]) == 10 and np.allclose(cosine[a == i], np.sort(c)[::-1][:10], rtol=0, atol=1e-15)


def test_unusable_vectors(spark):
    good = np.ones(64)
    bad = [None, "", "{}", "{cut", json.dumps({"vector": None}), stored(np.zeros(64)), stored(np.ones(32)), stored([float("nan")] * 64), json.dumps({"vector": [1] * 63 + ["x"]}), json.dumps({"vector": "@@@"}), '{"vector": [1, 2'] + [json.dumps({"vector": [True] * 64})]
    df = spark.createDataFrame([(i, b) for i, b in enumerate(bad)] + [(50, stored(good)), (None, stored(good))], "id long, json_data string")
    assert [r["id"] for r in vectors.read_vectors(df, "id", "json_data").collect()] == [50]
    assert knn.neighbours(vectors.read_vectors(df, "id", "json_data"), 3).count() == 0
    assert knn.neighbours(vectors.read_vectors(df.limit(0), "id", "json_data"), 3).count() == 0


def test_search_finds_far_neighbours(spark):
    rng = np.random.default_rng(8)
    centers = rng.standard_normal((40, 64))
    x = np.repeat(centers, 75, axis=0) + 1.2 * rng.standard_normal((3000, 64))
    df = spark.createDataFrame([(i, stored(v)) for i, v in enumerate(x)], "id long, json_data string")
    rows = vectors.read_vectors(df, "id", "json_data")
    got = {(r["id"], r["neighbour"]) for r in knn.search(rows.where("id % 50 = 0"), rows, 10).collect()}
    want = {p for p in brute(x, 10, -1) if p[0] % 50 == 0}
    assert len(got) == len(want) and len(got & want) >= 0.9 * len(want)
    assert knn.search(rows.limit(0), rows, 10).count() == 0 and knn.search(rows.where("id = 0"), rows.limit(0), 10).count() == 0
