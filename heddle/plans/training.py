"""Queries p1, p5 and p7: drifting files, hierarchies, nested records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from heddle.operators import hierarchy, nested, schema_drift
from heddle.registry import Registry
from heddle.session import table

REGISTRY = Registry()

#: Columns of the consistent result table: retrieval series, then agent-outcome series.
RESULT_SCHEMA = {
    "dataset_id": ("datasetId", "string"),
    "mode": ("mode", "string"),
    "reported_run_at": ("runAt", "string"),
    "mean_recall_at_k": ("meanRecallAtK", "double"),
    "p95_latency_ms": ("p95LatencyMs", "double"),
    "mean_latency_ms": ("meanLatencyMs", "double"),
    "baseline_condition": ("baselineCondition", "string"),
    "baseline_task_ids": ("baseline.taskScores[].taskId", "strings"),
    "arm_task_ids": ("comparisons[].result.taskScores[].taskId", "strings"),
}
#: Most names that are approved unseen.
MOST_NAMES = 1000


def _artifacts(spark: SparkSession, d: str) -> DataFrame:
    """All files ingested; redelivered ones are still there."""
    return schema_drift.ingest(table(spark, d, "result_artifacts").drop("loaded_at"), "body", RESULT_SCHEMA)


@REGISTRY.query("p1_found")
def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return schema_drift.drift_report(_artifacts(spark, d), "artifact_id", ["store_id", "series"], "run_at").distinct()


@REGISTRY.query("p1_proposals")
def p1_proposals(spark: SparkSession, d: str) -> DataFrame:
    """Names under which target fields were seen, by the files that renamed them."""
    return schema_drift.proposals(schema_drift.drift_changes(_artifacts(spark, d), "artifact_id", ["store_id", "series"], "run_at"), RESULT_SCHEMA)


@REGISTRY.query("p1_table")
def p1_table(spark: SparkSession, d: str) -> DataFrame:
    """All files as one table; every name the report proposes is approved and promoted, the rest kept as JSON."""
    approved: dict[str, list[str]] = {}
    found = p1_proposals(spark, d).orderBy("column", F.desc("files"), "path").take(MOST_NAMES + 1)
    if len(found) > MOST_NAMES:
        raise ValueError("too many proposed names to approve unseen")
    for r in found:
        approved.setdefault(r["column"], []).append(r["path"])
    rows = _artifacts(spark, d)
    for column, paths in approved.items():
        rows = schema_drift.promote(rows, column, paths, RESULT_SCHEMA[column][1])
    return rows.select("artifact_id", "store_id", "series", "run_at", *RESULT_SCHEMA, "_parsed", "_rescued").dropDuplicates(["artifact_id"])


def relation_name(c: str) -> F.Column:
    """A relation's name without case and separators."""
    return F.regexp_replace(F.lower(F.col(c)), "[^a-z0-9]", "")


def hash_key(c: str) -> F.Column:
    """The 64 lower-case hex digits of a hash however it is written, else null."""
    return F.nullif(F.regexp_extract(F.lower(F.trim(F.col(c))), r"^(?:sha-?256[:=])?\s*([0-9a-f]{64})$", 1), F.lit(""))


def _edge_ends(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "edges").where(relation_name("relation") == "parentchild").where("source_id is not null and target_id is not null")
    key = lambda c: F.concat(F.lit("e:"), F.col(c).cast("string"))
    return rows.select(key("source_id").alias("source"), key("target_id").alias("target"), "recorded_at", "source_id")


def _pointers(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Pointers and nodes of both trees; a key's prefix tells the tree."""
    edges = _edge_ends(spark, d)
    # Among parents recorded at the same time the greatest id holds.
    best = edges.groupBy("target").agg(F.max_by("source", F.struct("recorded_at", "source_id")).alias("parent"))
    versions = table(spark, d, "constitution_versions").select(hash_key("content_hash").alias("own"), hash_key("supersedes_version_hash").alias("before"), "published_at")
    key = lambda c: F.concat(F.lit("c:"), F.col(c))
    chain = versions.where("own is not null and before is not null").groupBy("own").agg(F.max_by("before", F.struct("published_at", "before")).alias("before"))
    pointers = best.select(F.col("target").alias("node"), "parent").union(chain.select(key("own"), key("before")))
    nodes = edges.select(F.col("source").alias("node")).union(edges.select("target")).union(versions.where("own is not null").select(key("own")))
    return pointers, nodes


def _split(c: str) -> F.Column:
    return F.substring(F.col(c), 3, 1 << 30)


def _tree(c: str) -> F.Column:
    return F.when(F.col(c).startswith("e:"), "edges").otherwise("constitution")


_P5_SQL = """
WITH RECURSIVE e AS (
  SELECT source_id AS s, target_id AS t, recorded_at FROM edges
  WHERE regexp_replace(lower(relation), '[^a-z0-9]', '', 'g') = 'parentchild' AND source_id IS NOT NULL AND target_id IS NOT NULL),
v AS (
  SELECT nullif(regexp_extract(lower(trim(content_hash)), '^(?:sha-?256[:=])?\\s*([0-9a-f]{64})$', 1), '') AS own,
    nullif(regexp_extract(lower(trim(supersedes_version_hash)), '^(?:sha-?256[:=])?\\s*([0-9a-f]{64})$', 1), '') AS before, published_at
  FROM constitution_versions),
up AS (
  SELECT 'edges' AS tree, t::VARCHAR AS node, s::VARCHAR AS parent FROM e QUALIFY row_number() OVER (PARTITION BY t ORDER BY recorded_at DESC NULLS LAST, s DESC) = 1
  UNION ALL
  SELECT * FROM (SELECT 'constitution', own, before FROM v WHERE own IS NOT NULL AND before IS NOT NULL QUALIFY row_number() OVER (PARTITION BY own ORDER BY published_at DESC NULLS LAST, before DESC) = 1)),
nodes AS (
  SELECT 'edges' AS tree, s::VARCHAR AS node FROM e UNION SELECT 'edges', t::VARCHAR FROM e
  UNION SELECT 'constitution', own FROM v WHERE own IS NOT NULL UNION SELECT 'constitution', before FROM v WHERE own IS NOT NULL AND before IS NOT NULL),
r(tree, node, root, depth) AS (
  SELECT tree, node, node, 0 FROM nodes ANTI JOIN up USING (tree, node)
  UNION ALL SELECT r.tree, up.node, r.root, r.depth + 1 FROM r JOIN up ON up.tree = r.tree AND up.parent = r.node)
SELECT n.tree, n.node AS node_key, coalesce(r.root, 'cycle') AS root_key, coalesce(r.depth, -1)::INTEGER AS level_no FROM nodes n LEFT JOIN r USING (tree, node)
"""


@REGISTRY.query("p5_found", _P5_SQL)
def p5_found(spark: SparkSession, d: str) -> DataFrame:
    out = hierarchy.resolve(*_pointers(spark, d))
    return out.select(_tree("node").alias("tree"), _split("node").alias("node_key"), F.when(F.col("is_cycle"), "cycle").otherwise(_split("root")).alias("root_key"), F.col("depth").cast("int").alias("level_no"))


@REGISTRY.query("p5_paths")
def p5_paths(spark: SparkSession, d: str) -> DataFrame:
    """Full path of every node that is not on or below a loop."""
    out = hierarchy.resolve(*_pointers(spark, d), with_paths=True).where(~F.col("is_cycle"))
    return out.select(_tree("node").alias("tree"), _split("node").alias("node_key"), F.array_join(F.transform("path", lambda x: F.substring(x, 3, 1 << 30)), "/").alias("path"), F.col("depth").cast("int").alias("level_no"))


def _descendants(spark: SparkSession, d: str) -> DataFrame:
    return hierarchy.descendants(hierarchy.resolve(*_pointers(spark, d), with_paths=True))


@REGISTRY.query("p5_descendants")
def p5_descendants(spark: SparkSession, d: str) -> DataFrame:
    """All descendants of every node that has any, with their distance."""
    return _descendants(spark, d).select(_tree("ancestor").alias("tree"), _split("ancestor").alias("node_key"), _split("node").alias("descendant_key"), F.col("distance").cast("int").alias("distance"))


@REGISTRY.query("p5_descendant_counts")
def p5_descendant_counts(spark: SparkSession, d: str) -> DataFrame:
    """Number of descendants and of children of every node that has any."""
    out = _descendants(spark, d).groupBy("ancestor").agg(F.count("*").alias("descendants"), F.count(F.when(F.col("distance") == 1, 1)).alias("children"), F.max("distance").alias("height"))
    return out.select(_tree("ancestor").alias("tree"), _split("ancestor").alias("node_key"), "descendants", "children", "height")


def _live(spark: SparkSession, d: str) -> dict[str, DataFrame]:
    return nested.artifacts(table(spark, d, "live_artifacts").select("artifact_id", "body").dropDuplicates(["artifact_id"]), "artifact_id", "body")


@REGISTRY.query("p7_found")
def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return _live(spark, d)["memory_ids"].select("artifact_id", "arm_name", "task_ord", "list_name", "memory_id").distinct()


@REGISTRY.query("p7_conditions")
def p7_conditions(spark: SparkSession, d: str) -> DataFrame:
    return _live(spark, d)["conditions"]


@REGISTRY.query("p7_tasks")
def p7_tasks(spark: SparkSession, d: str) -> DataFrame:
    rows = _live(spark, d)["tasks"]
    number = lambda n: F.element_at("fields", n).try_cast("double")
    flag = lambda n: F.element_at("fields", n).try_cast("boolean")
    return rows.select(
        "artifact_id", "arm_ord", "arm_name", "task_ord", "task_id", number("requiredCoverage").alias("required_coverage"), number("successScore").alias("success_score"),
        flag("passed").alias("passed"), number("latencyMs").alias("latency_ms"), flag("insufficientContext").alias("insufficient_context"), F.element_at("fields", "answer").alias("answer"),
    )
