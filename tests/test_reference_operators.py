"""Operators on hand-made vectors, graphs and texts, and edge cases."""

import math

import pytest
from pyspark.sql import functions as F

from heddle.functions import text as T
from heddle.functions import vector as V
from heddle.operators import evaluation as X
from heddle.operators import governance as P
from heddle.operators import graph as G
from heddle.operators import lifecycle as L
from heddle.operators import retrieval as R
from heddle.operators import spectral as S
from heddle.operators.ordered import previous_row


def vectors(spark):
    rows = [(1, [1.0, 0.0], "a"), (2, [0.9, 0.1], "a"), (3, [0.0, 1.0], "b"), (4, [0.0, 0.0], "b"), (5, None, None), (6, [1.0, 0.0, 0.0], "a"), (7, [2.0, 0.0], None)]
    return spark.createDataFrame(rows, "id long, vector array<double>, ns string")


def test_knn_ties_dimensions_and_unusable(spark):
    q = spark.createDataFrame([(10, [1.0, 0.0]), (11, None), (12, [0.0, 0.0])], "query_id long, vector array<double>")
    got = [(r["query_id"], r["rank"], r["id"]) for r in R.knn(q, vectors(spark), 2).orderBy("query_id", "rank").collect()]
    assert got == [(10, 1, 1), (10, 2, 7)]
    by = {(r["ns"], r["id"]) for r in R.knn(q, vectors(spark), 1, by="ns").collect()}
    assert by == {("a", 1), ("b", 3), (None, 7)}
    assert R.knn(q.limit(0), vectors(spark), 2).count() == 0


def test_pairs_above(spark):
    assert {(r[0], r[1]) for r in R.pairs_above(vectors(spark), 0.95).collect()} == {(1, 2), (1, 7), (2, 7)}


def test_bm25_matches_formula(spark):
    docs = spark.createDataFrame([(1, "alpha beta beta"), (2, "alpha gamma"), (3, None), (4, "")], "id long, text string")
    q = spark.createDataFrame([(1, "beta beta missing")], "query_id long, text string")
    row = R.bm25(q, "query_id", "text", R.postings(docs, "id", "text"), "id", 5).collect()
    want = math.log((2 - 1 + 0.5) / 1.5 + 1) * 2 * 2.2 / (2 + 1.2 * (0.25 + 0.75 * 3 / 2.5))
    assert len(row) == 1 and row[0]["id"] == 1 and row[0]["score"] == pytest.approx(want)


def test_tokens_stems_and_synonyms(spark):
    df = spark.createDataFrame([(1, "The time-stamped -foo data_x a I"), (2, None)], "id long, text string")
    rows = {r[0]: r[1] for r in df.select("id", T.lexical_tokens(F.col("text"))).collect()}
    assert rows == {1: ["time", "stamped", "timestamped", "foo", "foo", "data"], 2: []}
    assert [T.stem(w) for w in ("encrypting", "encryption", "hopping", "ponies", "agreed", "is", "relational")] == ["encrypt", "encrypt", "hop", "poni", "agree", "is", "relate"]
    q = spark.createDataFrame([(1, "search the search index"), (2, "nothing")], "id long, text string")
    assert {r[0]: r[1] for r in T.expand_queries(q, "id", "text").collect()} == {1: ["retrieval", "recall", "query", "lookup", "hnsw", "inverted", "bm25"], 2: []}


def test_quantize_constant_and_range(spark):
    df = spark.createDataFrame([([0.0, 1.0],), ([2.0, 2.0],)], "v array<double>")
    assert [r[0]["codes"] for r in df.select(V.quantize(F.col("v"))).collect()] == [[-128, 127], [-128, -128]]


def test_mmr_prefers_different_vectors(spark):
    rows = [(1, 1, [1.0, 0.0], 0.9), (1, 2, [1.0, 0.01], 0.89), (1, 3, [0.0, 1.0], 0.5)]
    df = spark.createDataFrame(rows, "q long, id long, v array<double>, score double")
    assert [r["id"] for r in R.mmr(df, "q", "id", "v", "score", 2).orderBy("rank").collect()] == [1, 3]


def test_components_chain_star_and_empty(spark):
    links = [(i, i + 1) for i in range(1, 40)] + [(100, 100 + i) for i in range(1, 30)] + [(200, 201), (201, 200), (7, 7)]
    got = {r[0]: r[1] for r in G.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert {got[i] for i in range(1, 41)} == {1} and {got[i] for i in range(100, 130)} == {100} and got[201] == 200
    assert G.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_traverse_spread_and_levels(spark):
    e = spark.createDataFrame([(1, 2, "depends_on", 1.0), (2, 3, "depends_on", 1.0), (3, 1, "depends_on", 1.0), (3, 4, "similar_to", 0.1)], "src long, dst long, relation string, weight double")
    start = spark.createDataFrame([(1,)], "start long")
    assert {(r["node"], r["depth"]) for r in G.traverse(e, start, 9).collect()} == {(1, 0), (2, 1), (3, 2), (4, 3)}
    boosts = {r["node"]: r["boost"] for r in G.spread(e, start.withColumn("energy", F.lit(1.0)), depth=1).collect()}
    assert boosts == {2: pytest.approx(0.9 / math.sqrt(2)), 3: pytest.approx(0.9 / math.sqrt(2))}
    dag = spark.createDataFrame([("a", "b"), ("b", "d"), ("a", "d"), ("x", "y"), ("y", "x")], "before string, after string")
    assert {tuple(r) for r in G.kahn_levels(dag).collect()} == {("a", 0), ("b", 1), ("d", 2)}


def test_dbscan_border_and_noise(spark):
    pairs = spark.createDataFrame([(1, 2), (1, 3), (1, 4), (2, 3), (2, 4), (3, 4), (4, 5), (8, 9)], "id_a long, id_b long")
    points = spark.createDataFrame([(i,) for i in range(1, 10)], "id long")
    got = {r["id"]: (r["cluster"], r["core"]) for r in G.dbscan(pairs, points).collect()}
    assert got[5] == (1, False) and got[4] == (1, True) and got[8] == (None, False)


def test_previous_row_is_lag(spark):
    rows = [(i % 3 if i % 7 else None, i * 37 % 101, i) for i in range(300)]
    df = spark.createDataFrame(rows, "g int, o int, v int")
    df.createOrReplaceTempView("prev_test")
    want = spark.sql("SELECT g, o, v, lag(v) OVER (PARTITION BY g ORDER BY o, v) AS prev_v FROM prev_test")
    key = lambda r: tuple((x is not None, x) for x in r)
    got = previous_row(df, ["g"], ["o", "v"], ["v"])
    assert sorted(map(tuple, got.collect()), key=key) == sorted(map(tuple, want.collect()), key=key)


def test_statistics(spark):
    assert X.student_tail(2.228139, 10) == pytest.approx(0.025, abs=1e-6)
    assert X.student_tail(0.0, 3) == pytest.approx(0.5)
    assert X.student_tail(-6.3138, 1) == pytest.approx(0.95, abs=1e-5)
    df = spark.createDataFrame([("a", 1.0, 2.0), ("a", 2.0, 3.0), ("b", 1.0, None), ("c", 1.0, 0.0)], "g string, x double, y double")
    got = {r["g"]: (r["n"], r["t"]) for r in X.paired_t(df, ["g"], "x", "y").collect()}
    assert got == {"a": (2, None), "c": (1, None)}


def test_ir_metrics(spark):
    ranked = spark.createDataFrame([(1, 1, 5), (1, 2, 6)], "q long, rank int, d long")
    qrels = spark.createDataFrame([(1, 6, 3), (1, 7, 1), (1, 5, 0), (2, 1, 1)], "q long, d long, grade int")
    got = {r["q"]: r for r in X.ir_metrics(ranked, qrels, "q", "d", 2).collect()}
    assert got[1]["recall"] == 0.5 and got[1]["mrr"] == 0.5 and got[2]["ndcg"] == 0
    assert got[1]["ndcg"] == pytest.approx((7 / math.log2(3)) / (7 + 1 / math.log2(3)))


def test_lifecycle(spark):
    rows = [(1, "stm", 1, 0.0, {"a": "1"}), (2, "ltm", 2, 0.0, {"a": "2", "b": "3"}), (3, "archived", 1, 0.0, None)]
    df = spark.createDataFrame(rows, "id long, lifecycle_state string, access_count int, activation_energy double, metadata map<string,string>")
    deltas = spark.createDataFrame([(1, 50.0), (2, -3.0), (3, 5.0)], "id long, delta double")
    assert {r["id"]: (r["new_energy"], r["new_state"], r["accesses"]) for r in L.feedback(df, deltas).collect()} == {1: (10.0, "ltm", 2), 2: (-3.0, "stm", 2), 3: (5.0, "stm", 2)}
    merged = {r["id"]: r for r in L.merge(df, spark.createDataFrame([(1, 2)], "kept long, gone long")).collect()}
    assert merged[1]["accesses"] == 3 and merged[1]["metadata"] == {"a": "1", "b": "3"} and merged[2]["archived"]


def test_spectral_invariants(spark):
    rows = [(c * 10 + i, c * 10 + j, "similar_to", 0.9, "n") for c in range(4) for i in range(8) for j in range(i + 1, 8)]
    rows += [(0, 10, "similar_to", 0.05, "n"), (10, 20, "similar_to", 0.05, "n"), (20, 30, "similar_to", 0.05, "n"), (0, 30, "contradicts", 1.0, "n")]
    e = spark.createDataFrame(rows, "src long, dst long, relation string, weight double, ns string")
    modes = S.basis(S.normalized(S.adjacency(e, "ns"), "ns"), "ns")
    signal = spark.createDataFrame([("n", c * 10 + i, 1.0 if c == 0 else 0.0) for c in range(4) for i in range(8)] + [("n", 99, 5.0)], "ns string, id long, value double")
    same = {r["id"]: r["value"] for r in S.smooth(signal, modes, "ns", S.low_pass(0.0)).collect()}
    assert same[99] == 5.0 and same[3] == pytest.approx(1.0) and same[15] == pytest.approx(0.0, abs=1e-9)
    heat = {r["id"]: r["value"] for r in S.smooth(signal, modes, "ns", S.low_pass(1.0)).collect()}
    assert heat[3] > heat[13] > 0 and sum(v * v for k, v in heat.items() if k != 99) <= 8.0


def test_governance(spark):
    sources = spark.createDataFrame([("t", "a"), ("t", "b")], "target string, artifact string")
    grants = spark.createDataFrame([("a", "read", "x"), ("b", "read", "x"), ("a", "write", "x")], "artifact string, capability string, subject string")
    assert [tuple(r) for r in P.intersect_grants(grants, sources).collect()] == [("t", "read", "x")]
    items = spark.createDataFrame([(1, 1, 60), (1, 2, 50), (1, 3, 40)], "g long, o long, c long")
    assert [r["taken"] for r in P.greedy_budget(items, "g", "o", "c", 100, 5).orderBy("o").collect()] == [True, False, True]
    chain = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "d")], "target string, artifact string")
    got = {(r["artifact"], r["depth"], r["complete"]) for r in P.lineage(chain, spark.createDataFrame([("a",)], "start string"), 2).collect()}
    assert got == {("b", 1, False), ("c", 2, False)}
