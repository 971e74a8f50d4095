"""Rescue-column ingestion and the drift report."""

import json

from heddle.operators import schema_drift as D

SCHEMA = {"name": ("datasetId", "string"), "recall": ("meanRecallAtK", "double"), "tasks": ("arms[].taskId", "strings")}


def frame(spark, bodies, extra=False):
    rows = [(i, "s", "x", i, b) for i, b in enumerate(bodies)]
    df = spark.createDataFrame(rows, "id long, store string, series string, at long, body string")
    return df.selectExpr("*", "'clash' AS _rescued", "1 AS recall") if extra else df


def report(spark, bodies):
    out = D.drift_report(D.ingest(frame(spark, bodies), "body", SCHEMA), "id", ["store", "series"], "at")
    return {tuple(r) for r in out.collect()}


def test_kinds_of_change(spark):
    a = {"datasetId": "d", "meanRecallAtK": 0.5, "arms": [{"taskId": "t", "x": 1}], "o": {"k": 1}}
    b = {"datasetId": "d", "mean_recall": 0.5, "arms": [{"taskId": 7, "x": 1}, {"y": "n"}], "o": [1]}
    assert report(spark, [json.dumps(a), "{cut", None, "﻿" + json.dumps(b)]) == {
        (3, "mean_recall", "renamed"), (3, "arms[].taskId", "type_changed"), (3, "arms[].y", "added"), (3, "o", "type_changed"),
    }


def test_null_fits_every_type_and_nothing_below_a_change(spark):
    a, b, c = {"v": 1, "o": {"a": {"b": 1}}}, {"v": None, "o": {"a": 2}}, {"v": "s", "o": {"a": 2}}
    assert report(spark, [json.dumps(x) for x in (a, b, c)]) == {(1, "o.a", "type_changed")}
    assert report(spark, [json.dumps({"k": 1}), json.dumps({"K": {"deep": 1}})]) == {(1, "k", "removed"), (1, "K", "added")}


def test_groups_and_null_groups(spark):
    rows = [(1, None, "a", 1, '{"x": 1}'), (2, None, "a", 2, '{"y": 1}'), (3, "s", "a", 1, '{"z": true}'), (4, "s", "a", None, '{"z": 1}')]
    df = spark.createDataFrame(rows, "id long, store string, series string, at long, body string")
    out = D.drift_report(D.ingest(df, "body", {}), "id", ["store", "series"], "at")
    assert {tuple(r) for r in out.collect()} == {(2, "y", "renamed"), (3, "z", "type_changed")}


def test_many_files_of_one_group_span_partitions(spark):
    bodies = [json.dumps({f"f{i // 7}": 1}) for i in range(200)]
    assert {r[0] for r in report(spark, bodies)} == set(range(7, 200, 7))


def test_ingest_rescues_and_promotes(spark):
    bodies = [
        json.dumps({"datasetId": "d", "meanRecallAtK": "0.5", "arms": [{"taskId": "a"}, {"taskId": "b"}]}),
        json.dumps({"datasetId": 5, "mean_recall": 0.25, "extra": {"k": [1, 2]}}),
        '{"meanRecallAtK": NaN}', "", None, "[]",
    ]
    rows = D.ingest(frame(spark, bodies, extra=True), "body", SCHEMA)
    got = {r["id"]: r for r in rows.collect()}
    assert got[0]["recall"] == 0.5 and got[0]["tasks"] == ["a", "b"] and got[0]["_rescued"] is None
    assert got[1]["name"] is None and json.loads(got[1]["_rescued"]) == {"datasetId": [5], "mean_recall": [0.25], "extra.k": [[1, 2]]}
    assert [got[i]["_parsed"] for i in range(6)] == [True, True, False, False, False, False]
    after = {r["id"]: r for r in D.promote(rows, "recall", ["mean_recall"], "double").collect()}
    assert after[1]["recall"] == 0.25 and "mean_recall" not in json.loads(after[1]["_rescued"])
    assert after[0]["recall"] == 0.5


def test_empty_table(spark):
    rows = D.ingest(frame(spark, []), "body", SCHEMA)
    assert rows.count() == 0
    assert D.drift_report(rows, "id", ["store", "series"], "at").count() == 0
