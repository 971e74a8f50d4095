"""Routing, sharing, governance, spectral and streaming queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from heddle.operators import governance as G
from heddle.operators import retrieval as R
from heddle.operators import spectral as S
from heddle.plans.training import hash_key
from heddle.registry import Registry
from heddle.session import cut, table
from heddle.sources.tables import EDGES_SQL, ENTRIES_SQL, edges, entries
from heddle.streaming import jobs

REGISTRY = Registry()
query = REGISTRY.query

EXPERTS_SQL = """x AS (SELECT label AS expert, i, avg(x) AS x FROM (SELECT label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS i FROM embeddings) GROUP BY label, i),
ex AS (SELECT expert, list(x ORDER BY i) AS vector FROM x GROUP BY expert),
ro AS (SELECT q.vec_id AS query_id, ex.expert, list_cosine_similarity(q.embedding::DOUBLE[], ex.vector) AS score FROM embeddings q, ex WHERE q.vec_id % 50 = 0)"""


def _experts(spark: SparkSession, d: str) -> DataFrame:
    """Experts are the centroids of the labels."""
    parts = table(spark, d, "embeddings").select(F.col("label").alias("expert"), F.posexplode("embedding").alias("i", "x"))
    means = parts.groupBy("expert", "i").agg(F.avg(F.col("x").cast("double")).alias("x"))
    return means.groupBy("expert").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda e: e["x"]).alias("vector"))


def _routes(spark: SparkSession, d: str) -> DataFrame:
    asked = table(spark, d, "embeddings").where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))
    return R.knn(asked, _experts(spark, d), 1000, key="expert").select("query_id", F.col("expert").cast("int").alias("expert"), "score")


@query("expert_route", f"WITH {EXPERTS_SQL}, r AS (SELECT *, max(score) OVER (PARTITION BY query_id) AS top FROM ro) SELECT query_id, expert, round(score, 6) AS score FROM r WHERE top >= 0.15 AND score >= top * 0.95 QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, expert) <= 3")
def expert_route(spark: SparkSession, d: str) -> DataFrame:
    """Experts within 5 % of the best one, where that is good enough (0.15 on these vectors)."""
    of = Window.partitionBy("query_id")
    rows = _routes(spark, d).withColumn("top", F.max("score").over(of)).where((F.col("top") >= 0.15) & (F.col("score") >= F.col("top") * 0.95))
    return rows.withColumn("r", F.row_number().over(of.orderBy(F.desc("score"), "expert"))).where("r <= 3").select("query_id", "expert", F.round("score", 6).alias("score"))


@query("expert_placement", f"WITH {EXPERTS_SQL}, m AS (SELECT query_id, max(score) AS s FROM ro GROUP BY query_id) SELECT query_id, CASE WHEN s >= 0.3 THEN 'auto' WHEN s >= 0.2 THEN 'suggested' ELSE 'none' END AS placement FROM m")
def expert_placement(spark: SparkSession, d: str) -> DataFrame:
    best = _routes(spark, d).groupBy("query_id").agg(F.max("score").alias("s"))
    return best.select("query_id", F.when(F.col("s") >= 0.3, "auto").when(F.col("s") >= 0.2, "suggested").otherwise("none").alias("placement"))


OWN_SQL = f"{ENTRIES_SQL}, ow AS (SELECT ns, arg_min(tenant_id, (created_at, id)) AS owner FROM e GROUP BY ns), gr AS (SELECT DISTINCT entry_a.ns AS ns, 'acorn' AS agent_id FROM duplicate_pairs WHERE entry_a.category = 'lesson')"


def _rights(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Entries, owners (the first writer of a namespace) and grants."""
    rows = entries(spark, d)
    owners = rows.groupBy("ns").agg(F.min_by("tenant_id", F.struct("created_at", "id")).alias("owner"))
    grants = table(spark, d, "duplicate_pairs").where("entry_a.category = 'lesson'").select(F.col("entry_a.ns").alias("ns"), F.lit("acorn").alias("agent_id")).distinct()
    return rows, owners, grants


@query("acl_visible", f"WITH {OWN_SQL} SELECT ns, count(*) AS entries FROM e WHERE NOT starts_with(ns, '_') AND (ns IN (SELECT ns FROM ow WHERE owner = 'acorn') OR ns IN (SELECT ns FROM gr)) GROUP BY ns")
def acl_visible(spark: SparkSession, d: str) -> DataFrame:
    rows, owners, grants = _rights(spark, d)
    return G.visible(rows, owners, grants, "acorn").groupBy("ns").agg(F.count("*").alias("entries"))


@query("whoami", f"WITH {OWN_SQL} SELECT owner AS agent_id, count(*) AS owned FROM ow GROUP BY owner")
def whoami(spark: SparkSession, d: str) -> DataFrame:
    _, owners, _ = _rights(spark, d)
    return owners.groupBy(F.col("owner").alias("agent_id")).agg(F.count("*").alias("owned"))


@query("debate_aliases", "WITH k AS (SELECT DISTINCT run_id, task_id FROM task_results) SELECT run_id, task_id, row_number() OVER (PARTITION BY run_id ORDER BY task_id)::INTEGER AS alias FROM k")
def debate_aliases(spark: SparkSession, d: str) -> DataFrame:
    """Short numbers for the members of a session."""
    rows = table(spark, d, "task_results").select("run_id", "task_id").distinct()
    return rows.withColumn("alias", F.row_number().over(Window.partitionBy("run_id").orderBy("task_id")))


@query("synthesis_chunks", f"WITH {ENTRIES_SQL}, r AS (SELECT tenant_id, ns, id, row_number() OVER (PARTITION BY tenant_id, ns ORDER BY access_count DESC, activation_energy DESC, id) AS n FROM e QUALIFY n <= 200) SELECT tenant_id, ns, ((n - 1) // 20)::INTEGER AS chunk, count(*) AS members, min(id) AS first_id FROM r GROUP BY ALL")
def synthesis_chunks(spark: SparkSession, d: str) -> DataFrame:
    """The 200 most used entries of a namespace in chunks of 20 for a generator."""
    order = Window.partitionBy("tenant_id", "ns").orderBy(F.desc("access_count"), F.desc("activation_energy"), "id")
    rows = entries(spark, d).withColumn("n", F.row_number().over(order)).where("n <= 200")
    return rows.groupBy("tenant_id", "ns", F.floor((F.col("n") - 1) / 20).cast("int").alias("chunk")).agg(F.count("*").alias("members"), F.min("id").alias("first_id"))


SOURCES_SQL = f"{EDGES_SQL}, so AS (SELECT src AS target, dst AS artifact FROM g WHERE relation = 'depends_on'), gt AS (SELECT DISTINCT id AS artifact, category AS capability, coalesce(tenant_id, '') AS subject FROM entries WHERE category IS NOT NULL)"


def _sources(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    sources = edges(spark, d).where("relation = 'depends_on'").select(F.col("src").alias("target"), F.col("dst").alias("artifact"))
    grants = table(spark, d, "entries").where("category is not null").select(F.col("id").alias("artifact"), F.col("category").alias("capability"), F.coalesce("tenant_id", F.lit("")).alias("subject")).distinct()
    return sources, grants


@query("permission_intersection", f"WITH {SOURCES_SQL}, n AS (SELECT target, count(*) AS n FROM so GROUP BY target) SELECT target, capability, subject FROM so JOIN gt USING (artifact) JOIN n USING (target) GROUP BY target, capability, subject, n HAVING count(DISTINCT artifact) = n")
def permission_intersection(spark: SparkSession, d: str) -> DataFrame:
    sources, grants = _sources(spark, d)
    return G.intersect_grants(grants, sources)


@query("narrower_check", f"WITH {SOURCES_SQL}, ch AS (SELECT DISTINCT so.target AS id, capability, subject FROM so JOIN gt USING (artifact)), pa AS (SELECT artifact AS id, capability, subject FROM gt) SELECT id, bool_and((id, capability, subject) IN (SELECT (id, capability, subject) FROM pa)) AS narrower FROM ch GROUP BY id")
def narrower_check(spark: SparkSession, d: str) -> DataFrame:
    """Whether what sources grant stays within what the target itself grants."""
    sources, grants = _sources(spark, d)
    child = sources.join(grants, "artifact").select(F.col("target").alias("id"), "capability", "subject")
    return G.narrower(child, grants.withColumnRenamed("artifact", "id"), "id")


@query("lineage_bfs", f"WITH RECURSIVE {SOURCES_SQL}, r(start, artifact, depth) AS (SELECT DISTINCT target, target, 0 FROM so UNION SELECT r.start, so.artifact, r.depth + 1 FROM r JOIN so ON so.target = r.artifact WHERE r.depth < 4), m AS (SELECT start, artifact, min(depth) AS depth FROM r GROUP BY ALL) SELECT start, artifact, depth::INTEGER AS depth, NOT EXISTS (SELECT 1 FROM m z WHERE z.start = m.start AND z.depth = 4) AS complete FROM m WHERE depth BETWEEN 1 AND 3")
def lineage_bfs(spark: SparkSession, d: str) -> DataFrame:
    """Everything a target depends on, three steps deep, and whether that is all."""
    sources, _ = _sources(spark, d)
    return G.lineage(sources, sources.select(F.col("target").alias("start")).distinct(), 3)


HASH_SQL = "nullif(regexp_extract(lower(trim({0})), '^(?:sha-?256[:=])?\\s*([0-9a-f]{{64}})$', 1), '')"


@query("constitution_compose", f"WITH v AS (SELECT DISTINCT constitution_id, published_at, {HASH_SQL.format('content_hash')} AS own, {HASH_SQL.format('supersedes_version_hash')} AS before FROM constitution_versions) SELECT constitution_id, own, before IS NOT DISTINCT FROM lag(own) OVER (PARTITION BY constitution_id ORDER BY published_at NULLS FIRST, own) AS linked FROM v")
def constitution_compose(spark: SparkSession, d: str) -> DataFrame:
    """Whether each version chains to the one published before it."""
    rows = table(spark, d, "constitution_versions").select("constitution_id", "published_at", hash_key("content_hash").alias("own"), hash_key("supersedes_version_hash").alias("before")).distinct()
    return G.chained(rows, "constitution_id", "published_at", "own", "before")


@query("verifier_plan", "WITH k AS (SELECT DISTINCT run_id, result_id, NOT passed AS vetoed, coalesce(insufficient_context, false) AS det FROM task_results) SELECT run_id, result_id AS step, coalesce(max(vetoed::INTEGER) OVER (PARTITION BY run_id ORDER BY det DESC, result_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) = 0 AS ran FROM k")
def verifier_plan(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "task_results").select("run_id", F.col("result_id").alias("step"), (~F.col("passed")).alias("vetoed"), F.coalesce("insufficient_context", F.lit(False)).alias("deterministic")).distinct()
    return G.veto(rows, "run_id")


@query("context_budget")
def context_budget(spark: SparkSession, d: str) -> DataFrame:
    """Results of a run taken in order into 100000 tokens, 20 at most."""
    rows = table(spark, d, "task_results").dropDuplicates(["result_id"]).select("run_id", "result_id", "prompt_tokens")
    return G.greedy_budget(rows, "run_id", "result_id", "prompt_tokens", 100_000, 20)


@query("degree_normalised_adjacency", f"WITH {EDGES_SQL}, w AS (SELECT least(src, dst) AS a, greatest(src, dst) AS b, max(weight) AS w FROM g WHERE relation <> 'contradicts' AND weight > 0 AND src <> dst GROUP BY ALL), dg AS (SELECT n, sum(w) AS d FROM (SELECT a AS n, w FROM w UNION ALL SELECT b, w FROM w) GROUP BY n) SELECT 0 AS part, a, b, round(w / sqrt(x.d * y.d), 6) AS value FROM w JOIN dg x ON x.n = a JOIN dg y ON y.n = b")
def degree_normalised_adjacency(spark: SparkSession, d: str) -> DataFrame:
    rows = S.adjacency(edges(spark, d).withColumn("part", F.lit(0)), "part")
    return S.normalized(rows, "part").withColumn("value", F.round("value", 6))


def _namespaced(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Edges inside a namespace, and entries, with the namespace's family as group."""
    rows = entries(spark, d).withColumn("part", F.regexp_replace("ns", "_[0-9]+$", ""))
    part = rows.select("id", "part")
    inside = edges(spark, d).join(part.withColumnRenamed("id", "src"), "src").join(part.select(F.col("id").alias("dst"), F.col("part").alias("p2")), "dst").where("part = p2")
    return rows, inside


@query("heat_filter")
def heat_filter(spark: SparkSession, d: str) -> DataFrame:
    """Activation smoothed over the graph for t = 10, and the states it leads to."""
    rows, inside = _namespaced(spark, d)
    # Both are read several times, and are made once.
    rows, adjacent = cut(rows.select("part", "id", "activation_energy", "lifecycle_state")), cut(S.adjacency(inside, "part"))
    modes = cut(S.basis(S.normalized(adjacent, "part"), "part"))
    out = S.smooth(rows.select("part", "id", F.col("activation_energy").alias("value")), modes, "part", S.low_pass(10.0))
    return out.join(rows.select("id", "lifecycle_state"), "id").select("id", F.round("value", 6).alias("value"), S.consolidated(F.col("value"), F.col("lifecycle_state")).alias("new_state"))


def _heat_sql(t: float, steps: int) -> str:
    """``heat_steps`` unrolled."""
    parts = ["x0 AS (SELECT id, activation_energy AS value FROM e)"]
    for i in range(steps):
        parts.append(f"x{i + 1} AS (SELECT x.id, CASE WHEN x.id IN (SELECT a FROM bo) THEN x.value + {t / steps}::DOUBLE * (coalesce(f.s, 0) - x.value) ELSE x.value END AS value FROM x{i} x LEFT JOIN (SELECT bo.a AS id, sum(bo.value * y.value) AS s FROM bo JOIN x{i} y ON y.id = bo.b GROUP BY bo.a) f USING (id))")
    return ", ".join(parts)


@query("heat_steps", f"WITH {EDGES_SQL}, {ENTRIES_SQL}, w AS (SELECT least(src, dst) AS a, greatest(src, dst) AS b, max(weight) AS w FROM g WHERE relation <> 'contradicts' AND weight > 0 AND src <> dst GROUP BY ALL), dg AS (SELECT n, sum(w) AS d FROM (SELECT a AS n, w FROM w UNION ALL SELECT b, w FROM w) GROUP BY n), nv AS (SELECT a, b, w / sqrt(x.d * y.d) AS value FROM w JOIN dg x ON x.n = a JOIN dg y ON y.n = b), bo AS (SELECT a, b, value FROM nv UNION ALL SELECT b, a, value FROM nv), {_heat_sql(2.0, 4)} SELECT id, round(value, 6) AS value FROM x4")
def heat_steps(spark: SparkSession, d: str) -> DataFrame:
    """Activation smoothed over the whole graph by steps along its links."""
    values = S.normalized(S.adjacency(edges(spark, d).withColumn("part", F.lit(0)), "part"), "part")
    signal = entries(spark, d).select(F.lit(0).alias("part"), "id", F.col("activation_energy").alias("value"))
    return S.heat_steps(signal, values, "part", 2.0, 4).select("id", F.round("value", 6).alias("value"))


@query("spectral_modes")
def spectral_modes(spark: SparkSession, d: str) -> DataFrame:
    """Smallest Laplacian eigenvalues of each family of namespaces, by a randomised solver."""
    _, inside = _namespaced(spark, d)
    return S.top_modes(S.normalized(S.adjacency(inside, "part"), "part"), "part").withColumn("lambda", F.round("lambda", 4))


@query("stream_access_counts", "SELECT user_id AS id, count(*) AS accesses, max(ts) AS last_access FROM events GROUP BY user_id")
def stream_access_counts(spark: SparkSession, d: str) -> DataFrame:
    return jobs.run_to_table(jobs.access_counts(jobs.source(spark, f"{d}/events.parquet")), "complete")


@query("stream_event_windows", "SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL HAVING date_trunc('hour', min(ts)) + INTERVAL 1 HOUR <= (SELECT max(ts) FROM events) - INTERVAL 1 HOUR")
def stream_event_windows(spark: SparkSession, d: str) -> DataFrame:
    """Hours that the watermark has closed, each written once."""
    return jobs.run_to_table(jobs.event_windows(jobs.source(spark, f"{d}/events.parquet")), "append").withColumn("total", F.round("total", 4))


@query("stream_sessions", "WITH o AS (SELECT user_id, ts, CASE WHEN ts < lag(ts) OVER w + INTERVAL 1 HOUR THEN 0 ELSE 1 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM o) SELECT user_id, min(ts) AS start, count(*) AS n FROM s GROUP BY user_id, k HAVING max(ts) + INTERVAL 1 HOUR <= (SELECT max(ts) FROM events) - INTERVAL 1 HOUR")
def stream_sessions(spark: SparkSession, d: str) -> DataFrame:
    """Sessions that the watermark has closed."""
    return jobs.run_to_table(jobs.sessions(jobs.source(spark, f"{d}/events.parquet")), "append")
