"""Queries over the operators of this subpackage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from heddle.llm import contamination, knn, near_duplicates, packing, pairs, percentiles, splitting, vectors
from heddle.registry import Registry
from heddle.session import table

REGISTRY = Registry()


def registries() -> list[Registry]:
    """The registries of this subpackage."""
    return [REGISTRY]


@REGISTRY.query("p2_found")
def p2_found(spark: SparkSession, d: str) -> DataFrame:
    rows = vectors.read_vectors(table(spark, d, "entries"), "id", "json_data")
    near = knn.neighbours(rows, k=10, params=knn.Counting(floor=0.90))
    return near.select(F.least("id", "neighbour").alias("id_a"), F.greatest("id", "neighbour").alias("id_b")).distinct()


@REGISTRY.query("p2_search")
def p2_search(spark: SparkSession, d: str) -> DataFrame:
    """The ten most similar entries of every 50th entry among all, however far they are."""
    rows = vectors.read_vectors(table(spark, d, "entries"), "id", "json_data")
    return knn.search(rows.where("id % 50 = 0"), rows, 10)


_P6_SQL = """
WITH s AS (
  SELECT DISTINCT score_id, run_id, search_mode, latency_ms FROM query_scores
  WHERE latency_ms IS NOT NULL AND NOT isnan(latency_ms) AND latency_ms >= 0)
SELECT run_id, search_mode, CAST(count(*) AS BIGINT) AS n, q.quantile AS quantile,
       round(quantile_cont(latency_ms, q.quantile), 6) AS percentile
FROM s, (VALUES {values}) q(quantile) GROUP BY run_id, search_mode, q.quantile
"""


@REGISTRY.query("p6_percentiles", _P6_SQL.format(values="(CAST(0.5 AS DOUBLE)), (CAST(0.95 AS DOUBLE)), (CAST(0.99 AS DOUBLE))").replace("quantile_cont(latency_ms, q.quantile)", """CASE q.quantile WHEN 0.5 THEN quantile_cont(latency_ms, 0.5) WHEN 0.95 THEN quantile_cont(latency_ms, 0.95) ELSE quantile_cont(latency_ms, 0.99) END"""))
def p6_percentiles(spark: SparkSession, d: str) -> DataFrame:
    rows = percentiles.sorted_percentiles(table(spark, d, "query_scores"), ["run_id", "search_mode"], "latency_ms", [0.5, 0.95, 0.99], "score_id")
    return rows.withColumn("percentile", F.round("percentile", 6))


_P6_FOUND_SQL = """
WITH s AS (
  SELECT DISTINCT score_id, run_id, search_mode, latency_ms FROM query_scores
  WHERE latency_ms IS NOT NULL AND NOT isnan(latency_ms) AND latency_ms >= 0),
t AS (SELECT run_id, search_mode, quantile_cont(latency_ms, 0.95) AS p95 FROM s GROUP BY ALL)
SELECT DISTINCT m.summary_id FROM metric_summaries m JOIN t ON t.run_id = m.run_id AND t.search_mode = m.operation_type
WHERE m.p95_ms IS NOT NULL AND (isnan(m.p95_ms) OR abs(m.p95_ms - t.p95) > 0.2 * t.p95)
"""


@REGISTRY.query("p6_found", _P6_FOUND_SQL)
def p6_found(spark: SparkSession, d: str) -> DataFrame:
    true = percentiles.sorted_percentiles(table(spark, d, "query_scores"), ["run_id", "search_mode"], "latency_ms", [0.95], "score_id")
    said = table(spark, d, "metric_summaries").where("p95_ms is not null").select("summary_id", "run_id", F.col("operation_type").alias("search_mode"), "p95_ms")
    off = F.isnan("p95_ms") | (F.abs(F.col("p95_ms") - F.col("percentile")) > 0.2 * F.col("percentile"))
    return said.join(true, ["run_id", "search_mode"]).where(off).select("summary_id").distinct()


@REGISTRY.query("p6_shards_merged")
def p6_shards_merged(spark: SparkSession, d: str) -> DataFrame:
    """Percentiles with at most 1 % relative error, from summaries of each shard and day added up."""
    scores = table(spark, d, "query_scores").dropDuplicates(["score_id"]).withColumn("day", F.to_date("recorded_at"))
    parts = percentiles.summaries(scores, ["run_id", "search_mode", "shard_no", "day"], "latency_ms")
    whole = percentiles.merge(parts, ["run_id", "search_mode"])
    return percentiles.read_summary(whole, ["run_id", "search_mode"], [0.5, 0.95, 0.99])


def _entry_texts(spark: SparkSession, d: str) -> DataFrame:
    pairs = table(spark, d, "duplicate_pairs")
    rows = table(spark, d, "entries").select("id", "text")
    for side in ("entry_a", "entry_b"):
        rows = rows.unionByName(pairs.select(F.col(f"{side}.id").alias("id"), F.col(f"{side}.text").alias("text")))
    return rows


_P3_SQL = """
WITH RECURSIVE t AS (
  SELECT id, min(text) AS text FROM (SELECT id, text FROM entries UNION ALL SELECT entry_a.id, entry_a.text FROM duplicate_pairs UNION ALL SELECT entry_b.id, entry_b.text FROM duplicate_pairs)
  WHERE id IS NOT NULL AND text IS NOT NULL GROUP BY id),
s AS (SELECT id, list_distinct(regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+')) AS ws FROM t),
w AS (SELECT id, len(ws) AS n, unnest(ws) AS word FROM s WHERE len(ws) >= 8),
p AS (SELECT a.id AS a, b.id AS b FROM w a JOIN w b ON a.word = b.word AND a.id < b.id GROUP BY a.id, b.id, a.n, b.n HAVING count(*) >= 0.60 * (a.n + b.n - count(*)) - 1e-9),
u AS (SELECT a, b FROM p UNION ALL SELECT b, a FROM p),
r(a, b) AS (SELECT a, b FROM u UNION SELECT r.a, u.b FROM r JOIN u ON u.a = r.b)
SELECT DISTINCT a AS id_a, b AS id_b FROM r WHERE a < b
"""


@REGISTRY.query("p3_found", _P3_SQL)
def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return near_duplicates.pairs_of_groups(near_duplicates.groups(_entry_texts(spark, d)))


@REGISTRY.query("p3_groups")
def p3_groups(spark: SparkSession, d: str) -> DataFrame:
    """Every text with its class of equal word sets, its group and the size of the group."""
    rows = near_duplicates.groups(_entry_texts(spark, d))
    sizes = rows.groupBy("group").agg(F.count("*").alias("members"))
    return rows.join(sizes, "group").select("id", "class", "group", "members")


@REGISTRY.query("p8_containers")
def p8_containers(spark: SparkSession, d: str) -> DataFrame:
    """All texts in containers of 2048 tokens."""
    items = packing.measure(table(spark, d, "documents"), "doc_id", "text", 2048)
    return packing.pack(items, "doc_id", 2048)


_P9_SQL = """
WITH d AS (SELECT doc_id AS id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+') AS w FROM documents WHERE text IS NOT NULL),
i AS (SELECT item_id AS id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+') AS w FROM eval_items WHERE text IS NOT NULL),
dg AS (SELECT id, array_to_string(w[k:k + 11], ' ') AS g FROM (SELECT id, w, unnest(range(1, len(w) - 10)) AS k FROM d WHERE len(w) >= 12)),
ig AS (SELECT id, array_to_string(w[k:k + 11], ' ') AS g FROM (SELECT id, w, unnest(range(1, len(w) - 10)) AS k FROM i WHERE len(w) >= 12))
SELECT DISTINCT dg.id AS doc_id, ig.id AS item_id FROM dg JOIN ig USING (g)
"""


@REGISTRY.query("p9_found", _P9_SQL)
def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return _leaks(spark, d).select("doc_id", "item_id")


@REGISTRY.query("p9_spans")
def p9_spans(spark: SparkSession, d: str) -> DataFrame:
    """Where the longest leaked passage of each pair is and how long it is."""
    return _leaks(spark, d)


def _leaks(spark: SparkSession, d: str) -> DataFrame:
    return contamination.leaks(table(spark, d, "documents").select("doc_id", "text"), table(spark, d, "eval_items").select("item_id", "text"))


@REGISTRY.query("p10_pieces")
def p10_pieces(spark: SparkSession, d: str) -> DataFrame:
    """All texts above 512 tokens as pieces with an overlap of 64 tokens."""
    return splitting.split(table(spark, d, "documents"), "doc_id", "text")


@REGISTRY.query("p4_found")
def p4_found(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "task_results").dropDuplicates(["result_id"])
    return pairs.defects(rows, "result_id", "probe", ["answer", "gold_answer"], ("insufficient_context", "answer"))
