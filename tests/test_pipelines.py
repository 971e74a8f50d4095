"""Operators behind the search pipelines, stores and governance queries, on small fixtures."""

import json
import math
import os
import random
from collections import Counter

import numpy as np
import pytest
from heddle.functions.text import lexical_terms
from heddle.operators import governance as V
from heddle.operators import graph as G
from heddle.operators import journal as J
from heddle.operators import retrieval as R
from heddle.operators import schema_drift as D
from heddle.operators import spectral as S
from heddle.operators.ordered import exact_percentiles
from heddle.operators.temporal import asof_join
from heddle.plans.recalls import expanded
from heddle.plans.stores import hash_vectors, point_read
from heddle.streaming import jobs
from pyspark.sql import functions as F


def test_asof_join(spark):
    left = spark.createDataFrame([(1, "a", 5), (2, "a", 10), (3, "a", 1), (4, "b", 5), (5, None, 5), (6, "a", None)], "id int, k string, at int")
    right = spark.createDataFrame([("a", 2, "x"), ("a", 10, "y"), ("a", 10, "z"), ("b", 6, "late"), (None, 1, "lost"), ("a", None, "lost")], "k string, since int, v string")
    got = {r["id"]: r["v"] for r in asof_join(left, right, ["k"], "at", "since", ["v"]).collect()}
    assert got == {1: "x", 2: "z", 3: None, 4: None, 5: None, 6: None}
    assert asof_join(left, right.limit(0), ["k"], "at", "since", ["v"]).where("v is not null").count() == 0
    assert asof_join(left.limit(0), right, ["k"], "at", "since", ["v"]).count() == 0


def test_journal_replay(spark):
    rows = spark.createDataFrame([(1, "a", "put", 1.0), (2, "a", "put", 2.0), (3, "b", "put", 3.0), (4, "b", "delete", None), (5, "c", "put", 5.0), (6, None, "put", 6.0)], "seq long, key string, op string, value double")
    sealed = J.sealed(rows)
    torn = sealed.withColumn("checksum", F.when(F.col("seq") == 5, "torn").otherwise(F.col("checksum")))
    once = J.replay(rows.limit(0), torn, "key", "seq", "op")
    assert {(r["key"], r["value"]) for r in once.collect()} == {("a", 2.0)}
    # A journal may be replayed over the state that it gave.
    assert {(r["key"], r["value"]) for r in J.replay(once.select(rows.columns), sealed, "key", "seq", "op").collect()} == {("a", 2.0), ("c", 5.0)}


def test_json_lines(spark):
    df = spark.createDataFrame([(1, '{"a": 1}\n\n  {"b"\n[1]\n{"c": 2} '), (2, None), (3, "")], "id int, body string")
    assert [(r["id"], r["line_no"], r["outcome"]) for r in J.json_lines(df, "id", "body").orderBy("id", "line_no").collect()] == [(1, 1, "ok"), (1, 3, "error"), (1, 4, "error"), (1, 5, "ok")]


def test_commits_and_context(spark):
    rows = spark.createDataFrame([("k", 1, "h1", None), ("k", 2, "h1", None), ("k", 3, "h2", "h1"), ("k", 4, "h3", "h1"), ("k", 5, None, "h2")], "g string, at int, own string, before string")
    got = [r["outcome"] for r in V.commits(rows, "g", "at", "own", "before").collect()]
    assert Counter(got) == {"accepted": 2, "repeated": 1, "conflict": 1, "invalid": 1}
    items = spark.createDataFrame([("q", i, t, b) for i, (t, b) in enumerate([(5, 10), (90, 10), (5, None), (5, 10), (1, 1), (1, 1)])], "q string, place int, tokens int, bytes int")
    out = {r["place"]: r["taken"] for r in V.compile_context(items, "q", "place", {"tokens": 20, "bytes": 21}, 3).collect()}
    assert out == {0: True, 1: False, 2: False, 3: True, 4: True, 5: False}


def test_rules_deny_what_is_missing(spark):
    rules = spark.createDataFrame([("high", 1, "x", "above", 10.0, 2), ("low", 2, "y", "below", 0.0, 1)], "rule string, place int, field string, op string, bar double, severity int")
    rows = spark.createDataFrame([(1, 11.0, -1.0), (2, 1.0, 1.0), (3, None, 1.0), (4, float("nan"), -1.0)], "id int, x double, y double")
    assert {r["id"]: (r["severity"], r["decided_by"]) for r in V.evaluate_rules(rows, "id", ["x", "y"], rules).collect()} == {1: (2, "high"), 2: (0, "high"), 3: (3, "high"), 4: (3, "high")}


def test_prefilter_loses_no_pair(spark):
    rng = np.random.default_rng(5)
    x = np.concatenate([rng.standard_normal((150, 24)), np.repeat(rng.standard_normal((5, 24)), 8, axis=0) + 0.1 * rng.standard_normal((40, 24))])
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(900, None), (901, []), (902, [0.0] * 24), (903, x[0].tolist())]
    df = spark.createDataFrame(rows, "id long, vector array<double>")
    whole = {tuple(r)[:2] for r in R.pairs_above(df, 0.5).collect()}
    assert whole == {tuple(r)[:2] for r in R.pairs_above_prefiltered(df, 0.5, axes=6).collect()} and (0, 903) in whole
    # Vectors of several dimensions fall back to the plain way.
    mixed = df.unionByName(spark.createDataFrame([(904, [1.0, 0.0]), (905, [1.0, 0.1])], "id long, vector array<double>"))
    assert {tuple(r)[:2] for r in R.pairs_above_prefiltered(mixed, 0.5).collect()} == whole | {(904, 905)}
    assert R.pairs_above_prefiltered(df.limit(0), 0.5).count() == 0


def test_lexical_search_equals_the_joined_form(spark):
    rng = random.Random(3)
    text = lambda n: " ".join(f"w{min(rng.randrange(40), rng.randrange(40))}" for _ in range(n))
    docs = spark.createDataFrame([(i, text(rng.randrange(0, 60)), "x") for i in range(200)] + [(300, None, "x"), (301, "", "x"), (None, "w1", "x"), (302, "w1 " * 20000, "x"), (303, "re-use of The", "x")], "id long, text string, term string")
    asked = spark.createDataFrame([(1, "w1 w2 w39"), (2, "zzz"), (3, None), (4, "w0 W0 w5"), (5, "reuse"), (None, "w1")], "query_id long, text string")
    fast = sorted((r["query_id"], r["rank"], r["id"], round(r["score"], 9)) for r in R.lexical_search(asked, "query_id", "text", docs, "id", "text", 7).collect())
    slow = R.bm25(asked.where("query_id is not null"), "query_id", "text", R.postings(docs.where("id is not null"), "id", "text"), "id", 7)
    assert fast == sorted((r["query_id"], r["rank"], r["id"], round(r["score"], 9)) for r in slow.collect()) and (5, 1, 303) in {x[:3] for x in fast}
    assert lexical_terms("re-use The a") == ["re", "use", "reuse"]
    assert R.lexical_search(asked.limit(0), "query_id", "text", docs, "id", "text", 7).count() == 0
    assert R.lexical_search(asked, "query_id", "text", docs.limit(0), "id", "text", 7).count() == 0


def test_exact_percentiles_of_a_hot_group(spark):
    rng = np.random.default_rng(2)
    values = {"hot": rng.exponential(1, 3000), "one": np.array([4.0]), "ties": np.repeat([1.0, 2.0], 50)}
    rows = [(k, float(v)) for k, vs in values.items() for v in vs] + [("hot", None), ("hot", float("nan")), (None, 7.0), ("void", None)]
    df = spark.createDataFrame(rows, "k string, v double")
    got = {(r["k"], r["quantile"]): (r["n"], r["percentile"]) for r in exact_percentiles(df, ["k"], "v", [0.0, 0.5, 0.95, 1.0]).collect()}
    for k, vs in values.items():
        for q in (0.0, 0.5, 0.95, 1.0):
            assert got[k, q][0] == len(vs) and math.isclose(got[k, q][1], np.quantile(vs, q), rel_tol=1e-12)
    assert got[None, 0.5] == (1, 7.0) and ("void", 0.5) not in got
    assert exact_percentiles(df.limit(0), ["k"], "v", [0.5]).count() == 0


def test_levels_deeper_than_any_cap_and_loops(spark):
    chain = [(i, i + 1) for i in range(70)] + [(100, 101), (101, 100), (101, 102), (5, 90), (None, 3)]
    df = spark.createDataFrame(chain, "before long, after long")
    got = {r["node"]: r["level"] for r in G.kahn_levels(df).collect()}
    assert got == {**{i: i for i in range(71)}, 90: 6}


def test_heat_steps_match_the_matrix(spark):
    rng = random.Random(1)
    links = {(min(a, b), max(a, b)) for a, b in ((rng.randrange(30), rng.randrange(30)) for _ in range(60)) if a != b}
    edges = spark.createDataFrame([(0, a, b, "similar_to", 0.5) for a, b in links] + [(0, 40, 40, "similar_to", 1.0), (0, 1, 2, "contradicts", 1.0)], "part int, src long, dst long, relation string, weight double")
    values = S.normalized(S.adjacency(edges, "part"), "part")
    x = {i: rng.random() for i in range(42)}
    got = {r["id"]: r["value"] for r in S.heat_steps(spark.createDataFrame([(0, i, v) for i, v in x.items()], "part int, id long, value double"), values, "part", 1.5, 6).collect()}
    a = np.zeros((42, 42))
    for r in values.collect():
        a[r["a"], r["b"]] = a[r["b"], r["a"]] = r["value"]
    linked, y = a.any(axis=1), np.array([x[i] for i in range(42)])
    for _ in range(6):
        y = np.where(linked, y + 0.25 * (a @ y - y), y)
    assert np.allclose([got[i] for i in range(42)], y)


def test_randomised_modes(spark):
    rng = np.random.default_rng(0)
    pairs = {(int(min(a, b)), int(max(a, b))) for a, b in rng.integers(0, 60, (240, 2)) if a != b}
    edges = spark.createDataFrame([(0, a, b, "similar_to", 1.0) for a, b in pairs], "part int, src long, dst long, relation string, weight double")
    values = S.normalized(S.adjacency(edges, "part"), "part")
    m = np.zeros((60, 60))
    for r in values.collect():
        m[r["a"], r["b"]] = m[r["b"], r["a"]] = r["value"]
    want = np.sort(np.maximum(0, 1 - np.linalg.eigvalsh(m)))[:4]
    got = sorted(r["lambda"] for r in S.top_modes(values, "part", 4).collect())
    assert np.allclose(got, want, atol=2e-3)
    assert S.top_modes(values.limit(3), "part").count() == 0


def test_graph_expansion_keeps_direct_hits(spark):
    direct = spark.createDataFrame([(1, 10, 0.8), (1, 11, 0.4)], "query_id long, id long, score double")
    links = spark.createDataFrame([(10, 12, "depends_on"), (13, 10, "similar_to"), (10, 11, "depends_on"), (11, 12, "contradicts"), (10, 1, "depends_on"), (10, 99, "depends_on")], "src long, dst long, relation string")
    known = spark.createDataFrame([(i,) for i in (1, 10, 11, 12, 13)], "id long")
    got = {r["id"]: (round(r["score"], 3), r["via"]) for r in expanded(direct, links, known, 0.2).collect()}
    assert got == {10: (0.8, "direct"), 11: (0.4, "direct"), 12: (0.72, "graph"), 13: (0.4, "graph")}


def test_point_reads_refuse_ambiguous_ids(spark):
    rows = spark.createDataFrame([("t", "a", 1), ("t", "b", 1), ("t", "a", 2), ("u", "a", 3)], "tenant_id string, ns string, id int")
    keys = spark.createDataFrame([(1,), (2,), (3,), (4,), (None,)], "id int")
    assert [r["id"] for r in point_read(rows, "t", keys).collect()] == [2]


def test_hash_vectors(spark):
    df = spark.createDataFrame([(1, "one"), (2, "one"), (3, " "), (4, None), (5, "x" * 100000)], "id int, text string")
    got = {r["id"]: r["vector"] for r in hash_vectors(df, "text", 16).collect()}
    assert got[1] == got[2] != got[5] and got[3] is None and got[4] is None and math.isclose(sum(v * v for v in got[1]), 1)


def test_late_rows_are_dropped_in_append_mode(spark, tmp_path):
    minute = lambda m: f"2024-01-01 {m // 60:02d}:{m % 60:02d}:00"
    seen = set()
    for i, rows in enumerate(([(1, 5), (1, 20), (2, 400)], [(1, 410)], [(1, 30), (1, 390), (2, 900)])):
        df = spark.createDataFrame([(u, minute(m), "view", 1.0) for u, m in rows], "user_id long, ts string, event_type string, value double")
        df.select("user_id", F.col("ts").cast("timestamp_ntz").alias("ts"), "event_type", "value").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        for p in set((tmp_path / "in").glob("*.parquet")) - seen:
            os.utime(p, (1 + i, 1 + i))
            seen.add(p)
    stream = spark.readStream.schema(spark.read.parquet(str(tmp_path / "in")).schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    got = sorted((r["start"].hour, r["n"]) for r in jobs.run_to_table(jobs.event_windows(stream), "append").collect())
    # Rows are late by the watermark of the batch before: that of minute 30 is dropped, that of minute 390 is in time.
    assert got == [(0, 2), (6, 3)]


def test_change_feed(spark, tmp_path):
    for i, rows in enumerate(([(1, 1, "upsert", "a"), (2, 2, "upsert", "b")], [(1, 3, "upsert", "c"), (2, 4, "delete", None), (3, 5, "upsert", "d"), (3, 6, "upsert", "e")])):
        spark.createDataFrame(rows, "id int, seq int, op string, v string").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        feed = spark.readStream.schema("id int, seq int, op string, v string").parquet(str(tmp_path / "in"))
        jobs.change_feed(spark, feed, "id", "seq", str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
        got = {(r["id"], r["v"]) for r in jobs.current(spark, str(tmp_path / "out")).collect()}
        assert got == ({(1, "a"), (2, "b")} if i == 0 else {(1, "c"), (3, "e")})


TARGET = {"recall": ("meanRecall", "double"), "ids": ("runs[].id", "strings")}


def changes(spark, bodies):
    df = spark.createDataFrame([(i, "s", i, json.dumps(b)) for i, b in enumerate(bodies)], "id long, store string, at long, body string")
    return D.drift_changes(D.ingest(df, "body", TARGET), "id", ["store"], "at")


def test_drift_is_told_from_typed_and_rescued_columns(spark):
    bodies = [
        {"meanRecall": 1.0, "runs": [{"id": "a"}, 7], "e": {}, "a.b": 1},
        {"meanRecall": "1.5", "runs": [{"id": None}], "e": {}, "a": {"b": 1}},
        {"meanRecall": None, "runs": [{}], "e": {"k": 1}, "a": {"b": 1}},
        {"mean_recall": 2, "runs": [{"key": "a"}], "e": {"k": 1}, "a": {"b": 1}},
    ]
    got = {tuple(r) for r in changes(spark, bodies).collect()}
    assert got == {
        (1, "meanRecall", "type_changed", None), (1, "a.b", "removed", None), (1, "a", "added", None), (2, "runs[].id", "removed", None), (2, "e.k", "added", None),
        (3, "mean_recall", "renamed", "meanRecall"), (3, "runs[].key", "added", None),
    }
    found = {tuple(r) for r in D.proposals(changes(spark, bodies), TARGET).collect()}
    assert found == {("recall", "mean_recall", 1)}


def test_a_redelivered_file_counts_once(spark):
    df = spark.createDataFrame([(1, "s", 1, '{"x": 1}'), (1, "s", 1, '{"x": 1}'), (2, "s", 2, '{"y": 1}'), (2, "s", 2, '{"y": 1}'), (None, "s", 3, '{"z": 1}')], "id long, store string, at long, body string")
    assert [tuple(r) for r in D.drift_report(D.ingest(df, "body", {}), "id", ["store"], "at").collect()] == [(2, "y", "renamed")]


@pytest.mark.parametrize("text", ["", "[]", '{"a": 1', "null", "﻿{}"])
def test_odd_files(spark, text):
    df = spark.createDataFrame([(1, "s", 1, text)], "id long, store string, at long, body string")
    row = D.ingest(df, "body", TARGET).first()
    assert row["_parsed"] == (text == "﻿{}") and row["_rescued"] is None and row["recall"] is None


def test_models_see_batches_and_no_nulls(spark):
    from heddle.operators import plug

    df = spark.createDataFrame([(1, "ab", "old"), (2, None, "old"), (3, "", "old")], "id int, text string, tokens string")
    counted = {r["id"]: r["tokens"] for r in plug.count_tokens(df, "text", lambda: lambda texts: [len(t) for t in texts]).collect()}
    assert counted == {1: 2, 2: None, 3: 0}
    assert {r["id"]: r["answer"] for r in plug.generate(df, "text", lambda: lambda prompts: [p.upper() for p in prompts]).collect()} == {1: "AB", 2: None, 3: ""}
    assert plug.embed(df.limit(0), "text", lambda: lambda texts: [[0.0] for _ in texts]).count() == 0
