"""Spectral smoothing of scores over the relationship graph."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from heddle.session import cut

#: Smallest graphs that get a basis, and the modes kept.
LEAST_EDGES, LEAST_NODES, MODES = 8, 32, 96
#: Components up to this size are decomposed as dense matrices.
DENSE = 1024


def adjacency(edges: DataFrame, group: str) -> DataFrame:
    """(group, a, b, weight), a < b: undirected positive weights, the largest of parallel edges; no contradictions."""
    rows = edges.where((F.col("relation") != "contradicts") & (F.col("weight") > 0) & (F.col("src") != F.col("dst")))
    return rows.groupBy(group, F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).agg(F.max("weight").alias("weight"))


def normalized(adjacent: DataFrame, group: str) -> DataFrame:
    """(group, a, b, value): weight over the root of both degrees."""
    ends = adjacent.select(group, F.col("a").alias("n"), "weight").unionByName(adjacent.select(group, F.col("b").alias("n"), "weight"))
    degree = ends.groupBy(group, "n").agg(F.sum("weight").alias("d"))
    rows = adjacent.join(degree.select(group, F.col("n").alias("a"), F.col("d").alias("_a")), [group, "a"]).join(degree.select(group, F.col("n").alias("b"), F.col("d").alias("_b")), [group, "b"])
    return rows.select(group, "a", "b", (F.col("weight") / F.sqrt(F.col("_a") * F.col("_b"))).alias("value"))


def _components(i: np.ndarray, j: np.ndarray, n: int) -> np.ndarray:
    """The smallest index of each node's component."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[i], label[j])
        after = label.copy()
        for at in (i, j, label[i], label[j]):
            np.minimum.at(after, at, low)
        while (after != after[after]).any():
            after = after[after]
        if (after == label).all():
            return label
        label = after


def _iterated(i: np.ndarray, j: np.ndarray, v: np.ndarray, n: int, k: int, extra: int = 32, degree: int = 24, rounds: int = 1000, least: float = 1e-9) -> tuple[np.ndarray, np.ndarray]:
    """(mu, u): the ``k`` largest eigenvalues of a connected graph and their vectors, by subspace iteration with a Chebyshev filter, until all residuals are below ``least``."""
    row, column, weight = np.concatenate([i, j]), np.concatenate([j, i]), np.concatenate([v, v])
    order = np.argsort(row, kind="stable")
    column, weight, starts = column[order], weight[order, None], np.searchsorted(row[order], np.arange(n))

    def times(x: np.ndarray) -> np.ndarray:
        out = np.empty_like(x)
        for part in range(0, x.shape[1], 16):
            out[:, part : part + 16] = np.add.reduceat(weight * x[column, part : part + 16], starts, axis=0)
        return out

    x = np.random.default_rng(3).standard_normal((n, min(n, k + extra)))
    for _ in range(rounds):
        x = np.linalg.qr(x)[0]
        y = times(x)
        mu, s = np.linalg.eigh(x.T @ y)
        mu, s = mu[::-1], s[:, ::-1]
        x, y = x @ s, y @ s
        if np.linalg.norm(y[:, :k] - x[:, :k] * mu[:k], axis=0).max() <= least:
            return mu[:k], x[:, :k]
        # All from -1 to the smallest value held is damped, what lies above grows.
        half, middle = (mu[-1] + 1) / 2, (mu[-1] - 1) / 2
        first = scale = half / (1 - middle)
        x, y = (y - middle * x) * (scale / half), x
        for _ in range(degree - 1):
            after = 1 / (2 / first - scale)
            x, y = (times(x) - middle * x) * (2 * after / half) - (scale * after) * y, x
            scale = after
    raise RuntimeError(f"the modes of a component of {n} nodes did not settle in {rounds} rounds")


def leading_modes(i: np.ndarray, j: np.ndarray, v: np.ndarray, n: int, k: int = MODES) -> list[tuple[float, np.ndarray, np.ndarray]]:
    """(mu, nodes, u) of the ``k`` largest eigenvalues of a sparse symmetric matrix without empty rows.

    A mode lies on one component, so components are decomposed one by one: in
    stacks of equal size up to ``DENSE`` nodes, larger ones by iteration.
    Equal eigenvalues (to nine digits) rank by the component's smallest node.
    """
    label = _components(i, j, n)
    order = np.argsort(label, kind="stable")
    roots, first, sizes = np.unique(label[order], return_index=True, return_counts=True)
    component = np.searchsorted(roots, label)
    place = np.empty(n, np.int64)
    place[order] = np.arange(n) - np.repeat(first, sizes)
    of = component[i]
    links = np.argsort(of, kind="stable")
    begin = np.searchsorted(of[links], np.arange(len(roots) + 1))
    best: list[tuple[float, int, int, np.ndarray, np.ndarray]] = []
    for size in np.unique(sizes):
        same = np.flatnonzero(sizes == size)
        step = max(1, DENSE * DENSE // int(size) ** 2)
        for part in range(0, len(same), step):
            own = same[part : part + step]
            inside = np.concatenate([links[begin[c] : begin[c + 1]] for c in own])
            a, b = place[i[inside]], place[j[inside]]
            if size > DENSE:
                mu, u = (x[None] for x in _iterated(a, b, v[inside], int(size), min(k, int(size))))
            else:
                at = np.searchsorted(own, of[inside])
                m = np.zeros((len(own), size, size))
                m[at, a, b] = m[at, b, a] = v[inside]
                mu, u = np.linalg.eigh(m)
                mu, u = mu[:, ::-1], u[:, :, ::-1]
            c, r = (z.ravel() for z in np.indices((len(own), min(k, int(size)))))
            for x in np.lexsort((r, roots[own[c]], -np.round(mu[c, r], 9)))[:k]:
                nodes = order[first[own[c[x]]] : first[own[c[x]]] + size]
                best.append((float(mu[c[x], r[x]]), int(roots[own[c[x]]]), int(r[x]), nodes, u[c[x], :, r[x]].copy()))
        best = sorted(best, key=lambda z: (-round(z[0], 9), z[1], z[2]))[:k]
    return [(mu, nodes, u) for mu, _, _, nodes, u in best]


def basis(values: DataFrame, group: str) -> DataFrame:
    """(group, id, mode, lambda, u): the modes of D^-1/2 W D^-1/2 with the largest eigenvalues, as lambda = max(0, 1 - mu) ascending.

    Only numbers of a mode's own component come out, the others are zero; a
    linked id outside all modes kept has one row of nulls.  Groups with under
    8 edges or 32 linked nodes give no rows.  A task holds a group's links and
    modes, and no square matrix of more than ``DENSE`` nodes.
    """

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        ids = np.unique(rows[["a", "b"]].to_numpy())
        if len(rows) < LEAST_EDGES or len(ids) < LEAST_NODES:
            return pd.DataFrame({c: pd.Series([], dtype=object) for c in (group, "id", "mode", "lambda", "u")})
        found = leading_modes(np.searchsorted(ids, rows["a"]), np.searchsorted(ids, rows["b"]), rows["value"].to_numpy(float), len(ids))
        held = np.zeros(len(ids), bool)
        for _, nodes, _ in found:
            held[nodes] = True
        rest = np.flatnonzero(~held)
        sizes = [len(nodes) for _, nodes, _ in found]
        out = {"id": ids[np.concatenate([*(nodes for _, nodes, _ in found), rest])], "mode": pd.array([*np.repeat(np.arange(len(found)), sizes), *[None] * len(rest)], "Int32")}
        out["lambda"] = pd.array([*np.repeat([max(0.0, 1 - mu) for mu, _, _ in found], sizes), *[None] * len(rest)], "Float64")
        out["u"] = pd.array([*np.concatenate([u for _, _, u in found]), *[None] * len(rest)], "Float64")
        return pd.DataFrame({group: [rows[group].iloc[0]] * len(out["id"])} | out)

    kind = values.schema[group].dataType.simpleString()
    return values.groupBy(group).applyInPandas(run, f"{group} {kind}, id long, mode int, lambda double, u double")


def heat_steps(signal: DataFrame, values: DataFrame, group: str, t: float, steps: int) -> DataFrame:
    """(group, id, value): the heat equation on the graph, ``steps`` explicit steps of t / steps, without any basis.

    ``values`` comes from ``normalized``.  A step is x + (t / steps) * (A x - x)
    for linked ids, one join and one aggregation over the links, so a graph
    of any size is smoothed by all tasks; t / steps up to one is stable.
    """
    both = cut(values.select(group, "a", "b", "value").unionByName(values.select(group, F.col("b").alias("a"), F.col("a").alias("b"), "value")))
    linked = cut(both.select(group, F.col("a").alias("id")).distinct().withColumn("_linked", F.lit(True)))
    state = signal.select(group, "id", "value").join(linked, [group, "id"], "left")
    for step in range(steps):
        flow = both.join(state.select(group, F.col("id").alias("b"), F.col("value").alias("_x")), [group, "b"]).groupBy(group, F.col("a").alias("id")).agg(F.sum(F.col("value") * F.col("_x")).alias("_in"))
        moved = F.col("value") + t / steps * (F.coalesce("_in", F.lit(0.0)) - F.col("value"))
        state = state.join(flow, [group, "id"], "left").select(group, "id", F.when(F.col("_linked"), moved).otherwise(F.col("value")).alias("value"), "_linked")
        if step % 4 == 3:
            state = cut(state)
    return state.select(group, "id", "value")


def top_modes(values: DataFrame, group: str, modes: int = 8, extra: int = 8, rounds: int = 12, seed: int = 3) -> DataFrame:
    """(group, lambda): smallest eigenvalues 1 - mu of the normalised Laplacian, by randomised subspace iteration.

    A group's links are held sparse by one task, as many numbers as it has
    links and ``modes`` + ``extra`` columns; no dense square matrix is made.
    Groups with under 8 edges or 32 linked nodes give no rows.
    """

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        ids = np.unique(rows[["a", "b"]].to_numpy())
        if len(rows) < LEAST_EDGES or len(ids) < LEAST_NODES:
            return pd.DataFrame({group: pd.Series([], dtype=object), "lambda": pd.Series([], dtype=float)})
        i, j, v = np.searchsorted(ids, rows["a"]), np.searchsorted(ids, rows["b"]), rows["value"].to_numpy(float)

        def times(x: np.ndarray) -> np.ndarray:
            # (A + I) / 2 has the same modes, all its values are positive.
            out = x.copy()
            np.add.at(out, i, v[:, None] * x[j])
            np.add.at(out, j, v[:, None] * x[i])
            return out / 2

        x = np.linalg.qr(np.random.default_rng(seed).standard_normal((len(ids), min(len(ids), modes + extra))))[0]
        for _ in range(rounds):
            x = np.linalg.qr(times(times(times(times(x)))))[0]
        mu = np.sort(np.linalg.eigvalsh(x.T @ times(x)))[::-1][:modes]
        return pd.DataFrame({group: [rows[group].iloc[0]] * len(mu), "lambda": np.maximum(0.0, 2 - 2 * mu)})

    kind = values.schema[group].dataType.simpleString()
    return values.groupBy(group).applyInPandas(run, f"{group} {kind}, lambda double")


def smooth(signal: DataFrame, modes: DataFrame, group: str, response) -> DataFrame:  # noqa: ANN001
    """(group, id, value): U f(lambda) U' x; ids outside the basis keep their value.

    ``signal``: (group, id, value); ``modes`` comes from ``basis``; ``response``
    is a Column function of lambda.
    """
    coefficient = modes.where("mode is not null").join(signal, [group, "id"]).groupBy(group, "mode").agg((F.sum(F.col("u") * F.col("value")) * response(F.max("lambda"))).alias("c"))
    part = F.when(F.col("mode").isNull(), 0.0).otherwise(F.col("u") * F.col("c"))
    back = modes.join(coefficient, [group, "mode"], "left").groupBy(group, "id").agg(F.sum(part).alias("smoothed"))
    return signal.join(back, [group, "id"], "left").select(group, "id", F.coalesce("smoothed", "value").alias("value"))


def low_pass(t: float):  # noqa: ANN201
    """Heat kernel e^(-lambda t)."""
    return lambda x: F.exp(-x * t)


def high_pass(t: float):  # noqa: ANN201
    """1 - e^(-lambda t)."""
    return lambda x: 1 - F.exp(-x * t)


def subdiffusion(alpha: float):  # noqa: ANN201
    """e^(-lambda^alpha)."""
    return lambda x: F.exp(-F.pow(x, F.lit(alpha)))


def consolidated(energy: Column, state: Column) -> Column:
    """Short-term entries whose smoothed energy is not negative become long-term."""
    return F.when((state == "stm") & (energy >= 0), "ltm").otherwise(state)
