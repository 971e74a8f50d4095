"""Flattening of nested records."""

import json

from heddle.operators import nested as N


def ids(spark, tasks, **top):
    body = json.dumps({"baseline": {"condition": "b", "taskResults": tasks}} | top)
    df = spark.createDataFrame([(1, body, "x")], "k long, body string, arm_name string")
    return [tuple(r) for r in N.artifacts(df, "k", "body")["memory_ids"].orderBy("arm_ord", "task_ord", "list_name", "id_ord").collect()]


def test_all_written_forms(spark):
    forms = [["a", None, " b "], [{"id": "a", "score": 1}], [["a"], ["b"]], {"ltm": ["a"], "stm": ["b"]}, '["a", "b"]', "a;b", "a, b", "a", "", None, [], {"id": "a"}]
    got = ids(spark, [{"contextMemoryIds": f} for f in forms])
    by = {}
    for _, _, _, task, name, _, memory in got:
        assert name == "context"
        by.setdefault(task, []).append(memory)
    assert by == {0: ["a", "b"], 1: ["a"], 2: ["a", "b"], 3: ["a", "b"], 4: ["a", "b"], 5: ["a", "b"], 6: ["a", "b"], 7: ["a"], 11: ["a"]}


def test_keys_however_spelled_and_links(spark):
    tasks = [{"cited_memory_ids": ["a"], "rawResponse": '{"citedMemoryIds": ["no"]}'}, {"CitedMemoryIDs": "b"}]
    got = ids(spark, tasks, comparisons=[{"condition": "c", "result": {"taskResults": tasks[:1]}}, {"condition": "empty"}])
    assert got == [(1, 0, "b", 0, "cited", 0, "a"), (1, 0, "b", 1, "cited", 0, "b"), (1, 1, "c", 0, "cited", 0, "a")]


def test_null_bad_and_empty_bodies(spark):
    df = spark.createDataFrame([(1, None), (2, ""), (3, "{cut"), (4, "{}"), (5, "[]"), (None, '﻿{"baseline": {"condition": "b", "taskResults": []}}')], "k long, body string")
    out = N.artifacts(df, "k", "body")
    assert [tuple(r) for r in out["conditions"].collect()] == [(None, 0, "b", True)]
    assert out["tasks"].count() == 0 and out["memory_ids"].count() == 0
    assert N.artifacts(df.limit(0), "k", "body")["memory_ids"].count() == 0


def test_unnest_matches_explode(spark):
    rows = [(i, [list(range(j)) for j in range(i % 4)] if i % 5 else None) for i in range(200)]
    df = spark.createDataFrame(rows, "k int, v array<array<int>>")
    once = N.unnest(df, "v", ["k"], "w", "i")
    twice = N.unnest(once, "w", ["k", "i"], "x", "j")
    want = df.selectExpr("k", "posexplode(v) AS (i, w)").selectExpr("k", "i", "posexplode(w) AS (j, x)")
    assert sorted(map(tuple, twice.collect())) == sorted(map(tuple, want.collect()))
