"""Ageing, access, merging, context and evaluation queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from heddle.operators import evaluation as X
from heddle.operators import lifecycle as L
from heddle.operators import retrieval as R
from heddle.operators.ordered import exact_percentiles
from heddle.plans.texts import POSTINGS_SQL, bm25_sql
from heddle.registry import Registry
from heddle.session import table
from heddle.sources.tables import ENTRIES_SQL, entries, latest

REGISTRY = Registry()
query = REGISTRY.query

NOW = "2026-07-01 00:00:00"


@query("decay_cycle", f"""WITH {ENTRIES_SQL}, x AS (SELECT id, lifecycle_state AS s, access_count * 1.0::DOUBLE - coalesce((epoch_us(TIMESTAMP '{NOW}') - epoch_us(last_accessed_at)) / 3.6e9::DOUBLE, 0) * 0.1::DOUBLE * CASE lifecycle_state WHEN 'stm' THEN 3.0::DOUBLE WHEN 'ltm' THEN 1.0::DOUBLE WHEN 'archived' THEN 0.1::DOUBLE ELSE 1.0::DOUBLE END AS energy FROM e WHERE NOT coalesce(is_summary_node, false))
SELECT id, round(energy, 4) AS new_energy, CASE WHEN s = 'stm' AND energy < 2.0 THEN 'ltm' WHEN s = 'ltm' AND energy < -5.0 THEN 'archived' ELSE s END AS new_state FROM x""")
def decay_cycle(spark: SparkSession, d: str) -> DataFrame:
    rows = L.decay(entries(spark, d), F.lit(NOW).cast("timestamp"))
    return rows.select("id", F.round("new_energy", 4).alias("new_energy"), "new_state")


@query("feedback_transition", f"""WITH {ENTRIES_SQL}, f AS (SELECT user_id AS id, sum(greatest(-10.0::DOUBLE, least(10.0::DOUBLE, value / 10 - 5))) AS d, count(*) FILTER (value / 10 - 5 > 0) AS n FROM events GROUP BY user_id),
x AS (SELECT e.id, activation_energy + d AS energy, d, lifecycle_state AS s, access_count + n AS accesses FROM e JOIN f USING (id))
SELECT id, round(energy, 4) AS new_energy, CASE WHEN d > 0 AND energy >= 2 AND s = 'stm' THEN 'ltm' WHEN d > 0 AND energy >= 2 AND s = 'archived' THEN 'stm' WHEN d < 0 AND energy <= -2 AND s = 'ltm' THEN 'stm' WHEN d < 0 AND energy <= -2 AND s = 'stm' THEN 'archived' ELSE s END AS new_state, accesses FROM x""")
def feedback_transition(spark: SparkSession, d: str) -> DataFrame:
    """Events as feedback on the entry of the user's number."""
    deltas = table(spark, d, "events").select(F.col("user_id").alias("id"), (F.col("value") / 10 - 5).alias("delta"))
    return L.feedback(entries(spark, d), deltas).withColumn("new_energy", F.round("new_energy", 4))


@query("access_rollup", "SELECT user_id AS id, event_type, count(*) AS accesses, max(ts) AS last_access FROM events GROUP BY ALL")
def access_rollup(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").groupBy(F.col("user_id").alias("id"), "event_type").agg(F.count("*").alias("accesses"), F.max("ts").alias("last_access"))


@query("record_access", f"WITH {ENTRIES_SQL}, a AS (SELECT user_id AS id, count(*) AS n, max(ts) AS t FROM events GROUP BY 1) SELECT e.id, e.access_count + coalesce(a.n, 0) AS access_count, greatest(e.last_accessed_at, a.t::TIMESTAMPTZ) AS last_accessed_at FROM e LEFT JOIN a USING (id)")
def record_access(spark: SparkSession, d: str) -> DataFrame:
    """The access log applied to the entries."""
    log = table(spark, d, "events").groupBy(F.col("user_id").alias("id")).agg(F.count("*").alias("n"), F.max("ts").cast("timestamp").alias("t"))
    rows = entries(spark, d).join(log, "id", "left")
    return rows.select("id", (F.col("access_count") + F.coalesce("n", F.lit(0))).alias("access_count"), F.greatest("last_accessed_at", "t").alias("last_accessed_at"))


@query("decay_configuration", "SELECT arm, coalesce(max(CASE WHEN passed THEN latency_ms END), 0.1) AS decay_rate FROM task_results GROUP BY arm")
def decay_configuration(spark: SparkSession, d: str) -> DataFrame:
    """Partial settings over defaults."""
    return table(spark, d, "task_results").groupBy("arm").agg(F.coalesce(F.max(F.when(F.col("passed"), F.col("latency_ms"))), F.lit(0.1)).alias("decay_rate"))


@query("merge_memories", f"""WITH p AS (SELECT entry_a.id AS gone, min(entry_b.id) AS kept FROM duplicate_pairs WHERE entry_a.id > entry_b.id GROUP BY 1), {ENTRIES_SQL}
SELECT e.id, e.access_count + coalesce((SELECT sum(x.access_count) FROM p JOIN e x ON x.id = p.gone WHERE p.kept = e.id), 0)::BIGINT AS accesses, EXISTS (SELECT 1 FROM p WHERE p.gone = e.id) AS archived FROM e""")
def merge_memories(spark: SparkSession, d: str) -> DataFrame:
    """Reported pairs merged into the older entry."""
    rows = latest(table(spark, d, "entries").select("id", "access_count", "metadata", "ingested_at"), ["id"], [F.desc("ingested_at")])
    pairs = table(spark, d, "duplicate_pairs").select(F.col("entry_a.id").alias("gone"), F.col("entry_b.id").alias("kept")).where("gone > kept")
    return L.merge(rows, pairs.groupBy("gone").agg(F.min("kept").alias("kept"))).select("id", "accesses", "archived")


@query("remember_dedup", "WITH s AS (SELECT a.vec_id AS id, max(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[])) AS best FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0 GROUP BY 1) SELECT id, round(best, 6) AS best, CASE WHEN best >= 0.45 THEN 'blocked' WHEN best >= 0.40 THEN 'warned' WHEN best >= 0.35 THEN 'similar_to' WHEN best >= 0.30 THEN 'cross_reference' ELSE 'stored' END AS outcome FROM s")
def remember_dedup(spark: SparkSession, d: str) -> DataFrame:
    """A batch of new entries against the store; thresholds are lower here to suit these vectors."""
    rows = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    best = R.knn(rows.where("id % 50 = 0").withColumnRenamed("id", "query_id"), rows, 1, exclude_self=True)
    return best.select(F.col("query_id").alias("id"), F.round("score", 6).alias("best"), L.admission(F.col("score"), 0.45, 0.40, 0.35, 0.30).alias("outcome"))


@query("purge_stale", f"WITH {ENTRIES_SQL}, n AS (SELECT tenant_id, ns, max(created_at) AS newest, count(*) AS entries FROM e GROUP BY ALL) SELECT tenant_id, ns, entries FROM n WHERE newest < TIMESTAMPTZ '2026-04-01 00:00:00+00'")
def purge_stale(spark: SparkSession, d: str) -> DataFrame:
    """Namespaces whose newest entry is older than a cutoff."""
    rows = entries(spark, d).groupBy("tenant_id", "ns").agg(F.max("created_at").alias("newest"), F.count("*").alias("entries"))
    return rows.where(F.col("newest") < F.lit("2026-04-01 00:00:00").cast("timestamp")).select("tenant_id", "ns", "entries")


@query("context_block", f"WITH {ENTRIES_SQL} SELECT tenant_id, ns, id, row_number() OVER (PARTITION BY tenant_id, ns ORDER BY id)::INTEGER AS place FROM e WHERE lifecycle_state = 'ltm' AND access_count >= 3 AND NOT coalesce(is_summary_node, false) QUALIFY place <= 10")
def context_block(spark: SparkSession, d: str) -> DataFrame:
    """Ten stable, used entries of each namespace, in order of id."""
    rows = entries(spark, d).where("lifecycle_state = 'ltm' and access_count >= 3 and not coalesce(is_summary_node, false)")
    place = F.row_number().over(Window.partitionBy("tenant_id", "ns").orderBy("id"))
    return rows.withColumn("place", place).where("place <= 10").select("tenant_id", "ns", "id", "place")


@query("collapse_execute", f"WITH {ENTRIES_SQL} SELECT tenant_id, ns, category, count(*) AS members, min(id) AS first_member, substr(sha256(string_agg(id::VARCHAR, chr(10) ORDER BY id::VARCHAR)), 1, 32) AS fingerprint FROM e WHERE NOT coalesce(is_summary_node, false) AND category IS NOT NULL AND lifecycle_state = 'ltm' GROUP BY ALL HAVING count(*) >= 3")
def collapse_execute(spark: SparkSession, d: str) -> DataFrame:
    """Groups to collapse, with the fingerprint that recognises a group seen before."""
    rows = entries(spark, d).where("not coalesce(is_summary_node, false) and category is not null and lifecycle_state = 'ltm'")
    groups = rows.groupBy("tenant_id", "ns", "category").agg(F.count("*").alias("members"), F.min("id").alias("first_member"), F.array_sort(F.collect_list(F.col("id").cast("string"))).alias("m")).where("members >= 3")
    return groups.select("tenant_id", "ns", "category", "members", "first_member", F.substring(F.sha2(F.array_join("m", "\n"), 256), 1, 32).alias("fingerprint"))


IR_SQL = f"""{POSTINGS_SQL}, q AS (SELECT item_id AS query_id, text FROM eval_items), {bm25_sql('q', 20)},
ql AS (SELECT i.item_id AS query_id, d.doc_id, CASE WHEN contains(d.text, substr(i.text, 1, 200)) THEN 2 ELSE 1 END AS grade FROM eval_items i JOIN documents d ON contains(d.text, substr(i.text, 1, 80))),
il AS (SELECT query_id, count(*) AS n, sum(CASE WHEN r <= 20 THEN (pow(2.0, grade) - 1) / log2(r + 1.0::DOUBLE) END) AS ideal FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY grade DESC, doc_id) AS r FROM ql) GROUP BY query_id),
ht AS (SELECT query_id, count(*) AS h, min(rank) AS f, sum((pow(2.0, grade) - 1) / log2(rank + 1.0::DOUBLE)) AS dcg FROM bm JOIN ql USING (query_id, doc_id) GROUP BY query_id)"""


@query("ir_metrics", f"WITH {IR_SQL} SELECT query_id, round(coalesce(h / n, 0.0), 6) AS recall, round(coalesce(h / 20.0::DOUBLE, 0.0), 6) AS precision, round(coalesce(1 / f, 0.0), 6) AS mrr, round(coalesce(dcg / ideal, 0.0), 6) AS ndcg FROM il LEFT JOIN ht USING (query_id)")
def ir_metrics(spark: SparkSession, d: str) -> DataFrame:
    """Known-item search: documents that hold the start of an item are relevant."""
    items = table(spark, d, "eval_items").select(F.col("item_id").alias("query_id"), "text")
    docs = table(spark, d, "documents").select("doc_id", F.col("text").alias("doc"))
    ranked = R.lexical_search(items, "query_id", "text", table(spark, d, "documents"), "doc_id", "text", 20)
    # The fixed set of held-out items is tested against each document where it lies; only hits come out.
    held = docs.join(F.broadcast(items), F.contains(F.col("doc"), F.substring("text", 1, 80)))
    qrels = held.select("query_id", "doc_id", F.when(F.contains(F.col("doc"), F.substring("text", 1, 200)), 2).otherwise(1).alias("grade"))
    rows = X.ir_metrics(ranked, qrels, "query_id", "doc_id", 20)
    return rows.select("query_id", *[F.round(c, 6).alias(c) for c in ("recall", "precision", "mrr", "ndcg")])


SCORES_SQL = "s AS (SELECT DISTINCT ON (score_id) score_id, run_id, dataset_id, search_mode, query_id, recall_at_k::DOUBLE AS recall, mrr::DOUBLE AS mrr, latency_ms FROM query_scores)"


def _scores(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "query_scores").dropDuplicates(["score_id"])
    return rows.select("score_id", "run_id", "dataset_id", "search_mode", "query_id", F.col("recall_at_k").cast("double").alias("recall"), F.col("mrr").cast("double").alias("mrr"), "latency_ms")


@query("latency_percentiles", f"WITH {SCORES_SQL} SELECT search_mode, count(*) AS n, round(avg(latency_ms), 4) AS mean_ms, round(quantile_cont(latency_ms, 0.5), 6) AS p50_ms, round(quantile_cont(latency_ms, 0.95), 6) AS p95_ms, round(quantile_cont(latency_ms, 0.99), 6) AS p99_ms, min(latency_ms) AS min_ms, max(latency_ms) AS max_ms FROM s WHERE latency_ms >= 0 AND NOT isnan(latency_ms) GROUP BY search_mode")
def latency_percentiles(spark: SparkSession, d: str) -> DataFrame:
    """Metrics summary of each operation; percentiles by one distributed sort."""
    c = F.col("latency_ms")
    rows = _scores(spark, d).where(c.isNotNull() & ~F.isnan(c) & (c >= 0)).select("search_mode", "latency_ms")
    ranks = exact_percentiles(rows, ["search_mode"], "latency_ms", [0.5, 0.95, 0.99])
    at = lambda q, n: F.round(F.max(F.when(F.col("quantile") == q, F.col("percentile"))), 6).alias(n)
    wide = ranks.groupBy("search_mode").agg(at(0.5, "p50_ms"), at(0.95, "p95_ms"), at(0.99, "p99_ms"))
    sums = rows.groupBy("search_mode").agg(F.count("*").alias("n"), F.round(F.avg("latency_ms"), 4).alias("mean_ms"), F.min("latency_ms").alias("min_ms"), F.max("latency_ms").alias("max_ms"))
    return sums.join(wide, "search_mode").select("search_mode", "n", "mean_ms", "p50_ms", "p95_ms", "p99_ms", "min_ms", "max_ms")


@query("ablation_delta", f"WITH {SCORES_SQL}, m AS (SELECT dataset_id, search_mode, avg(recall) AS recall, avg(mrr) AS mrr FROM s GROUP BY ALL) SELECT a.dataset_id, a.search_mode, round(a.recall - b.recall, 6) AS recall_delta, round(a.mrr - b.mrr, 6) AS mrr_delta FROM m a JOIN m b ON a.dataset_id = b.dataset_id AND b.search_mode = 'vector' WHERE a.search_mode <> 'vector'")
def ablation_delta(spark: SparkSession, d: str) -> DataFrame:
    """Each mode against plain vector search."""
    means = _scores(spark, d).groupBy("dataset_id", "search_mode").agg(F.avg("recall").alias("recall"), F.avg("mrr").alias("mrr"))
    base = means.where("search_mode = 'vector'").select("dataset_id", F.col("recall").alias("r"), F.col("mrr").alias("m"))
    rows = means.where("search_mode <> 'vector'").join(base, "dataset_id")
    return rows.select("dataset_id", "search_mode", F.round(F.col("recall") - F.col("r"), 6).alias("recall_delta"), F.round(F.col("mrr") - F.col("m"), 6).alias("mrr_delta"))


PAIRED_SQL = f"""{SCORES_SQL}, a AS (SELECT dataset_id, search_mode, query_id, avg(recall) AS recall FROM s WHERE query_id IS NOT NULL GROUP BY ALL),
pr AS (SELECT c.dataset_id, c.search_mode, b.recall AS base, c.recall AS cand FROM a c JOIN a b ON b.dataset_id = c.dataset_id AND b.query_id = c.query_id AND b.search_mode = 'vector' WHERE c.search_mode <> 'vector'),
t AS (SELECT dataset_id, search_mode, count(*) AS n, avg(cand - base) AS mean_delta, stddev_samp(cand - base) AS sd, avg(base) AS base, avg(cand) AS cand FROM pr GROUP BY ALL)"""


def _pairs(spark: SparkSession, d: str) -> DataFrame:
    means = _scores(spark, d).where("query_id is not null").groupBy("dataset_id", "search_mode", "query_id").agg(F.avg("recall").alias("recall"))
    base = means.where("search_mode = 'vector'").select("dataset_id", "query_id", F.col("recall").alias("base"))
    return means.where("search_mode <> 'vector'").join(base, ["dataset_id", "query_id"]).withColumnRenamed("recall", "cand")


@query("paired_t", f"WITH {PAIRED_SQL} SELECT dataset_id, search_mode, n, round(mean_delta, 8) AS mean_delta, round(CASE WHEN n > 1 AND sd > 1e-12 THEN mean_delta / (sd / sqrt(n)) END, 5) AS t, n - 1 AS df FROM t")
def paired_t(spark: SparkSession, d: str) -> DataFrame:
    """Modes against plain vector search, query by query."""
    rows = X.paired_t(_pairs(spark, d), ["dataset_id", "search_mode"], "base", "cand")
    return rows.withColumns({"mean_delta": F.round("mean_delta", 8), "t": F.round("t", 5)})


@query("regression_gate")
def regression_gate(spark: SparkSession, d: str) -> DataFrame:
    """Floor, significance and verdict of every mode of every dataset."""
    pairs = _pairs(spark, d)
    tests = X.paired_t(pairs, ["dataset_id", "search_mode"], "base", "cand")
    tests = tests.withColumn("p", X.one_sided_p(F.col("t"), F.col("df"), F.col("mean_delta")))
    means = pairs.groupBy("dataset_id", "search_mode").agg(F.avg("base").alias("base"), F.avg("cand").alias("cand"))
    rows = X.holm(tests, ["dataset_id"], "p", "search_mode").join(means, ["dataset_id", "search_mode"])
    return rows.select("dataset_id", "search_mode", "n", F.round("p", 6).alias("p"), F.round("adjusted", 6).alias("adjusted"), X.gate(F.col("cand"), F.col("base"), F.col("adjusted"), 0.20).alias("verdict"))


@query("outcome_score", "WITH r AS (SELECT DISTINCT ON (result_id) * FROM task_results) SELECT arm, count(*) AS tasks, round(avg(CASE WHEN passed THEN 1.0 ELSE 0.0 END), 6) AS pass_rate, round(avg(similarity::DOUBLE), 6) AS mean_similarity, round(stddev_samp(similarity::DOUBLE), 6) AS sigma, round(sum(context_tokens)::DOUBLE / sum(prompt_tokens), 6) AS token_share FROM r GROUP BY arm")
def outcome_score(spark: SparkSession, d: str) -> DataFrame:
    """Pass rate, mean and sample deviation of each arm."""
    rows = table(spark, d, "task_results").dropDuplicates(["result_id"])
    s = F.col("similarity").cast("double")
    return rows.groupBy("arm").agg(F.count("*").alias("tasks"), F.round(F.avg(F.when(F.col("passed"), 1.0).otherwise(0.0)), 6).alias("pass_rate"), F.round(F.avg(s), 6).alias("mean_similarity"), F.round(F.stddev_samp(s), 6).alias("sigma"), F.round(F.sum("context_tokens") / F.sum("prompt_tokens"), 6).alias("token_share"))


@query("artifact_diff", "WITH b AS (SELECT DISTINCT run_id, task_id, 1 AS b1 FROM task_results WHERE arm = 'full_context'), c AS (SELECT DISTINCT run_id, task_id, 1 AS c1 FROM task_results WHERE arm <> 'full_context') SELECT run_id, task_id, CASE WHEN b1 IS NULL THEN 'candidate_only' WHEN c1 IS NULL THEN 'baseline_only' ELSE 'shared' END AS class FROM b FULL JOIN c USING (run_id, task_id)")
def artifact_diff(spark: SparkSession, d: str) -> DataFrame:
    """Tasks of two arms: shared or in one only."""
    keys = table(spark, d, "task_results").select("run_id", "task_id", "arm").distinct()
    base = keys.where("arm = 'full_context'").select("run_id", "task_id", F.lit(1).alias("b"))
    other = keys.where("arm <> 'full_context'").select("run_id", "task_id", F.lit(1).alias("c")).distinct()
    both = base.join(other, ["run_id", "task_id"], "full_outer")
    return both.select("run_id", "task_id", F.when(F.col("b").isNull(), "candidate_only").when(F.col("c").isNull(), "baseline_only").otherwise("shared").alias("class"))
