"""Percentiles against numpy."""

import math
import random

import numpy as np
import pytest
from heddle.llm import percentiles as P


def rows_of(seed=1):
    rng = random.Random(seed)
    rows = []
    for i in range(3000):
        g = None if i % 11 == 0 else f"g{min(3, i % 17)}"
        v = None if i % 29 == 0 else float("nan") if i % 31 == 0 else -1.0 if i % 37 == 0 else round(rng.expovariate(0.1), 1)
        rows.append((i, g, v, "x"))
    return rows + rows[:200]


def frame(spark, rows):
    return spark.createDataFrame(rows, "id long, g string, v double, _pos string")


def truth(rows):
    by = {}
    for i, g, v in {(r[0], r[1], r[2]) for r in rows if r[2] is not None and not math.isnan(r[2]) and r[2] >= 0}:
        by.setdefault(g, []).append(v)
    return by


def test_exact_with_ties_repeats_nulls_and_hot_group(spark):
    rows = rows_of()
    got = {(r["g"], r["quantile"]): (r["n"], r["percentile"]) for r in P.sorted_percentiles(frame(spark, rows), ["g"], "v", [0.0, 0.5, 0.95, 1.0], "id").collect()}
    want = {(g, q): (len(v), pytest.approx(float(np.quantile(v, q)))) for g, v in truth(rows).items() for q in (0.0, 0.5, 0.95, 1.0)}
    assert got == want


def test_without_key_repeats_count(spark):
    df = frame(spark, [(1, "a", 1.0, ""), (1, "a", 1.0, ""), (2, "a", 4.0, "")])
    assert [(r["n"], r["percentile"]) for r in P.sorted_percentiles(df, ["g"], "v", [0.5]).collect()] == [(3, 1.0)]


def test_empty_and_unusable(spark):
    df = frame(spark, [(1, "a", None, ""), (2, "a", float("nan"), ""), (3, "a", -2.0, "")])
    assert P.sorted_percentiles(df, ["g"], "v", [0.5], "id").count() == 0
    assert P.sorted_percentiles(df.limit(0), ["g"], "v", [0.5], "id").count() == 0


def test_merged_shards_have_bounded_error(spark):
    rows = [r for r in rows_of(2)[:3000]]
    df = frame(spark, rows).selectExpr("*", "id % 7 AS shard")
    whole = P.merge(P.summaries(df, ["g", "shard"], "v"), ["g"])
    once = P.summaries(df, ["g"], "v")
    assert sorted(map(str, whole.collect())) == sorted(map(str, once.select(*whole.columns).collect()))
    for r in P.read_summary(whole, ["g"], [0.5, 0.95]).collect():
        v = sorted(truth(rows)[r["g"]])
        exact = v[math.floor(r["quantile"] * (len(v) - 1))]
        assert abs(r["percentile"] - exact) <= 0.01 * exact + 1e-9
