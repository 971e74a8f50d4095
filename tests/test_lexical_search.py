"""Lexical search over long runs and over more than one block of queries and documents."""

import tracemalloc

from pyspark.sql import functions as F

from heddle.operators import retrieval as R
from heddle.plans import ranking, recalls


def rows(df):
    return sorted((r["query_id"], r["rank"], r["id"], round(r["score"], 9)) for r in df.collect())


def test_one_long_run_costs_the_driver_nothing(spark):
    """300 pairs of query and term, one of 400 000 characters: as an array of equal width they took 1.6 GB."""
    run = "x" * 400_000
    docs = spark.createDataFrame([(i, f"alpha beta{i % 7} gamma{i}" + (f" {run}" if i in (3, 8) else "") + (f" {run}y" if i == 9 else "")) for i in range(100)], "id long, text string")
    asked = docs.withColumnRenamed("id", "query_id")
    R.lexical_search(asked.limit(1), "query_id", "text", docs.limit(1), "id", "text", 5).count()
    tracemalloc.start()
    found = rows(R.lexical_search(asked, "query_id", "text", docs, "id", "text", 5))
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 100e6
    assert found == rows(R.bm25(asked, "query_id", "text", R.postings(docs, "id", "text"), "id", 5))
    assert [i for q, _, i, _ in found if q == 3][:2] == [3, 8] and [i for q, _, i, _ in found if q == 9][:1] == [9]


def test_blocks_of_queries_and_documents_equal_the_joined_form(spark):
    many = max(R.TOGETHER, R.WIDTH) + 60
    word = lambda c, n: F.concat(F.lit(c), F.pmod(F.xxhash64("id", F.lit(c)), F.lit(n)).cast("string"))
    docs = spark.range(many).repartition(1).select("id", F.concat_ws(" ", F.lit("every"), word("a", 3), word("b", 40), word("b", 40), word("c", 700)).alias("text"))
    asked = docs.withColumnRenamed("id", "query_id")
    assert rows(R.lexical_search(asked, "query_id", "text", docs, "id", "text", 6)) == rows(R.bm25(asked, "query_id", "text", R.postings(docs, "id", "text"), "id", 6))


def _store(spark, folder):
    """300 documents of which two share a run of 400 000 characters, and vectors for half of them."""
    run = "x" * 400_000
    rows = [(i, f"alpha beta{i % 7} gamma{i % 11}" + (f" {run}" if i in (50, 57) else ""), "web", "alpha" if i % 2 else "note") for i in range(300)]
    spark.createDataFrame(rows, "doc_id long, text string, source string, doc_kind string").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(i, [float(i % 13 + 1), float(i % 5), 1.0], i % 3) for i in range(150)], "vec_id long, embedding array<float>, label int").write.parquet(f"{folder}/embeddings.parquet")
    return str(folder)


def _driver_mb(query, spark, folder):
    spark.range(3).count()
    tracemalloc.start()
    found = query(spark, folder).collect()
    most = tracemalloc.get_traced_memory()[1] / 1e6
    tracemalloc.stop()
    return found, most


def test_rrf_hybrid_with_a_long_run(spark, tmp_path):
    found, most = _driver_mb(ranking.rrf_hybrid, spark, _store(spark, tmp_path))
    assert most < 20
    # Of the lexical list, the other text with the run ranks right behind the query's own.
    scores = {r["id"]: r["bm25"] for r in found if r["query_id"] == 50}
    assert scores[50] == max(x for x in scores.values() if x is not None)


def test_unified_search_with_a_long_run(spark, tmp_path):
    found, most = _driver_mb(recalls.unified_search, spark, _store(spark, tmp_path))
    assert most < 20
    assert {r["query_id"] for r in found} == set(range(0, 300, 50)) and all(r["id"] % 4 != 3 for r in found)


def test_hybrid_adaptive_k_with_a_long_run(spark, tmp_path):
    found, most = _driver_mb(ranking.hybrid_adaptive_k, spark, _store(spark, tmp_path))
    assert most < 20
    # Queries with a vector have a cosine of one, so their constant is 120; those without have 60.
    best = {r["query_id"]: r["rrf"] for r in found if r["rank"] == 1}
    assert set(best) == set(range(0, 300, 50)) and all(v <= 2 / 121 + 1e-8 for q, v in best.items() if q < 150) and all(v == round(1 / 61, 8) for q, v in best.items() if q >= 150)


def test_semantic_gate_with_a_long_run(spark, tmp_path):
    found, most = _driver_mb(ranking.semantic_gate, spark, _store(spark, tmp_path))
    assert most < 20
    # Only lexical hits with a vector count, and only for queries that have one.
    assert {r["query_id"] for r in found} <= {0, 50, 100} and all(r["id"] < 150 and r["cosine"] >= 0.1 for r in found)


def _no_join(*_, **__):
    raise AssertionError("queries were joined to full postings")


def test_queries_beyond_the_bound_are_answered_in_groups(spark, monkeypatch):
    """800 pairs of query and term; beyond the bound all were joined to full postings."""
    docs = spark.createDataFrame([(i, f"alpha beta{i % 7} gamma{i % 40} delta{i}") for i in range(200)] + [(200, None)], "id long, text string")
    asked = docs.withColumnRenamed("id", "query_id")
    joined = rows(R.bm25(asked, "query_id", "text", R.postings(docs, "id", "text"), "id", 6))
    held, frame, collect = [], type(docs), type(docs).toArrow
    monkeypatch.setattr(frame, "toArrow", lambda df: held.append((df.columns, (table := collect(df)).num_rows)) or table)
    monkeypatch.setattr(R, "bm25", _no_join)
    # The 248 different terms are numbered together where the bound holds them, else group by group.
    for bound, groups in ((150, 6), (300, 3)):
        held.clear()
        monkeypatch.setattr(R, "QUERY_TERMS", bound)
        assert rows(R.lexical_search(asked, "query_id", "text", docs, "id", "text", 6)) == joined
        pairs = [n for columns, n in held if "q" in columns]
        assert sum(pairs) == 800 and len(pairs) == groups and max(pairs) < 2 * bound
        assert sum("df" in columns for columns, _ in held) == (1 if bound == 300 else groups)


def _in_groups(query, spark, folder, monkeypatch):
    """Rows of ``query``, and those with its queries in several groups."""
    whole = query(spark, folder).collect()
    monkeypatch.setattr(R, "QUERY_TERMS", 6)
    monkeypatch.setattr(R, "bm25", _no_join)
    return sorted(whole, key=str), sorted(query(spark, folder).collect(), key=str)


def test_rrf_hybrid_in_groups(spark, tmp_path, monkeypatch):
    whole, parts = _in_groups(ranking.rrf_hybrid, spark, _store(spark, tmp_path), monkeypatch)
    assert parts == whole and len(whole) == 60


def test_unified_search_in_groups(spark, tmp_path, monkeypatch):
    whole, parts = _in_groups(recalls.unified_search, spark, _store(spark, tmp_path), monkeypatch)
    assert parts == whole and len(whole) == 60


def test_hybrid_adaptive_k_in_groups(spark, tmp_path, monkeypatch):
    whole, parts = _in_groups(ranking.hybrid_adaptive_k, spark, _store(spark, tmp_path), monkeypatch)
    assert parts == whole and len(whole) == 60


def test_semantic_gate_in_groups(spark, tmp_path, monkeypatch):
    whole, parts = _in_groups(ranking.semantic_gate, spark, _store(spark, tmp_path), monkeypatch)
    assert parts == whole
