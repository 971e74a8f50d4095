"""Reads, upserts, deletes and counts over the store's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from heddle.registry import Registry
from heddle.session import table
from heddle.sources.tables import EDGES_SQL, ENTRIES_SQL, edges, entries

REGISTRY = Registry()
query = REGISTRY.query


@query("list_namespaces", f"WITH {ENTRIES_SQL} SELECT DISTINCT tenant_id, ns FROM e WHERE NOT starts_with(ns, '_')")
def list_namespaces(spark: SparkSession, d: str) -> DataFrame:
    return entries(spark, d).where(~F.col("ns").startswith("_")).select("tenant_id", "ns").distinct()


@query("namespace_state_counts", f"WITH {ENTRIES_SQL} SELECT tenant_id, ns, count(*) FILTER (lifecycle_state = 'stm') AS stm, count(*) FILTER (lifecycle_state = 'ltm') AS ltm, count(*) FILTER (lifecycle_state = 'archived') AS archived, count(*) AS total FROM e GROUP BY ROLLUP (tenant_id, ns)")
def namespace_state_counts(spark: SparkSession, d: str) -> DataFrame:
    """Counts by namespace, by tenant and overall."""
    of = lambda s: F.count(F.when(F.col("lifecycle_state") == s, 1)).alias(s)
    return entries(spark, d).rollup("tenant_id", "ns").agg(of("stm"), of("ltm"), of("archived"), F.count("*").alias("total"))


@query("scan_point_lookup", f"WITH {ENTRIES_SQL} SELECT q.entry_id, e.tenant_id, e.ns, e.lifecycle_state FROM (SELECT DISTINCT entry_b.id AS entry_id FROM duplicate_pairs) q JOIN e ON e.id = q.entry_id")
def scan_point_lookup(spark: SparkSession, d: str) -> DataFrame:
    """Point reads of the entries that earlier scans reported."""
    wanted = table(spark, d, "duplicate_pairs").select(F.col("entry_b.id").alias("entry_id")).distinct()
    return wanted.join(entries(spark, d), F.col("entry_id") == F.col("id")).select("entry_id", "tenant_id", "ns", "lifecycle_state")


@query("upsert_latest", "SELECT score_id, run_id, CASE WHEN NOT isnan(latency_ms) THEN latency_ms END AS latency_ms, loaded_at FROM (SELECT DISTINCT score_id, run_id, latency_ms, loaded_at FROM query_scores) QUALIFY row_number() OVER (PARTITION BY score_id ORDER BY loaded_at DESC) = 1")
def upsert_latest(spark: SparkSession, d: str) -> DataFrame:
    """Latest row wins, by one aggregation that combines before the shuffle; a latency that is no number comes out null."""
    rows = table(spark, d, "query_scores").groupBy("score_id").agg(F.max_by(F.struct("run_id", "latency_ms", "loaded_at"), "loaded_at").alias("r"))
    return rows.select("score_id", "r.run_id", F.when(~F.isnan("r.latency_ms"), F.col("r.latency_ms")).alias("latency_ms"), "r.loaded_at")


@query("delete_entries", f"WITH {ENTRIES_SQL} SELECT id, ns FROM e WHERE NOT EXISTS (SELECT 1 FROM duplicate_pairs p WHERE p.entry_b.id = e.id)")
def delete_entries(spark: SparkSession, d: str) -> DataFrame:
    """What is left after deleting the second side of all reported pairs."""
    gone = table(spark, d, "duplicate_pairs").select(F.col("entry_b.id").alias("id"))
    return entries(spark, d).join(gone, "id", "left_anti").select("id", "ns")


@query("cascade_delete_edges", f"WITH {EDGES_SQL}, gone AS (SELECT DISTINCT entry_b.id AS id FROM duplicate_pairs) SELECT src, dst, relation FROM g WHERE src NOT IN (SELECT id FROM gone) AND dst NOT IN (SELECT id FROM gone)")
def cascade_delete_edges(spark: SparkSession, d: str) -> DataFrame:
    """Edges left after the entries at either end are deleted."""
    gone = table(spark, d, "duplicate_pairs").select(F.col("entry_b.id").alias("gone")).distinct()
    rows = edges(spark, d)
    for end in ("src", "dst"):
        rows = rows.join(gone, F.col(end) == F.col("gone"), "left_anti")
    return rows.select("src", "dst", "relation")


@query("entry_checksums", "SELECT id, any_value(sha256(json_data)) AS checksum FROM entries WHERE json_data IS NOT NULL GROUP BY id")
def entry_checksums(spark: SparkSession, d: str) -> DataFrame:
    """SHA-256 of each stored entry."""
    rows = table(spark, d, "entries").where("json_data is not null")
    return rows.groupBy("id").agg(F.any_value(F.sha2("json_data", 256)).alias("checksum"))


@query("checksum_mismatch", "SELECT DISTINCT artifact_id FROM result_artifacts WHERE body IS NOT NULL AND NOT json_valid(ltrim(body, chr(65279)))")
def checksum_mismatch(spark: SparkSession, d: str) -> DataFrame:
    """Files that fail their load check."""
    body = F.regexp_replace("body", "^\\ufeff", "")
    return table(spark, d, "result_artifacts").where(F.col("body").isNotNull() & F.try_parse_json(body).isNull()).select("artifact_id").distinct()


@query("migrate_state_column", "SELECT id, any_value(coalesce(json_extract_string(json_data, '$.lifecycleState'), 'stm')) AS lifecycle_state FROM entries WHERE json_data IS NOT NULL GROUP BY id")
def migrate_state_column(spark: SparkSession, d: str) -> DataFrame:
    """The state column added from the stored JSON."""
    rows = table(spark, d, "entries").where("json_data is not null")
    return rows.groupBy("id").agg(F.any_value(F.coalesce(F.get_json_object("json_data", "$.lifecycleState"), F.lit("stm"))).alias("lifecycle_state"))


@query("migrate_tenant_prefix", f"""WITH {ENTRIES_SQL}, p AS (SELECT CASE WHEN tenant_id = '' THEN ns ELSE tenant_id || '::' || ns END AS path FROM e)
SELECT path, CASE WHEN instr(path, '::') > 0 THEN substr(path, 1, instr(path, '::') - 1) ELSE '' END AS tenant, CASE WHEN instr(path, '::') > 0 THEN substr(path, instr(path, '::') + 2) ELSE path END AS ns, count(*) AS row_count FROM p GROUP BY ALL""")
def migrate_tenant_prefix(spark: SparkSession, d: str) -> DataFrame:
    """Manifest of a migration from tenant::path names to two columns, with row counts for the parity check."""
    path = F.when(F.col("tenant_id") == "", F.col("ns")).otherwise(F.concat_ws("::", "tenant_id", "ns"))
    rows = entries(spark, d).groupBy(path.alias("path")).agg(F.count("*").alias("row_count"))
    at = F.instr("path", "::")
    return rows.select("path", F.when(at > 0, F.substring("path", F.lit(1), at - 1)).otherwise("").alias("tenant"), F.when(at > 0, F.substring(F.col("path"), at + 2, F.length("path"))).otherwise(F.col("path")).alias("ns"), "row_count")


@query("artifact_loader", """WITH a AS (SELECT artifact_id, any_value(ltrim(body, chr(65279))) AS b FROM result_artifacts GROUP BY artifact_id)
SELECT artifact_id, json_extract_string(b, '$.datasetId') AS dataset_id, json_extract_string(b, '$.mode') AS mode, json_type(b, '$.comparisons') IS NOT NULL AS nested, coalesce(json_array_length(b, '$.queryScores'), json_array_length(b, '$.comparisons'), 0)::INTEGER AS parts FROM a WHERE json_valid(b)""")
def artifact_loader(spark: SparkSession, d: str) -> DataFrame:
    """Result files of either shape, flat or nested, told apart by their fields."""
    rows = table(spark, d, "result_artifacts").groupBy("artifact_id").agg(F.any_value(F.regexp_replace("body", "^\\ufeff", "")).alias("b"))
    rows = rows.where(F.try_parse_json("b").isNotNull())
    field = lambda p: F.get_json_object("b", p)
    size = lambda p: F.json_array_length(field(p))
    return rows.select("artifact_id", field("$.datasetId").alias("dataset_id"), field("$.mode").alias("mode"), field("$.comparisons").isNotNull().alias("nested"), F.coalesce(size("$.queryScores"), size("$.comparisons"), F.lit(0)).alias("parts"))


@query("visible_statistics", f"""WITH {ENTRIES_SQL}, {EDGES_SQL}, v AS (SELECT id, ns FROM e WHERE lifecycle_state IN ('stm', 'ltm') AND NOT starts_with(ns, '_'))
SELECT (SELECT count(*) FROM v) AS entries, (SELECT count(DISTINCT ns) FROM v) AS namespaces, (SELECT count(*) FROM g WHERE src IN (SELECT id FROM v) AND dst IN (SELECT id FROM v)) AS edges""")
def visible_statistics(spark: SparkSession, d: str) -> DataFrame:
    """Entries, namespaces and edges of what a caller sees; an edge counts if both ends are visible."""
    visible = entries(spark, d).where(F.col("lifecycle_state").isin("stm", "ltm") & ~F.col("ns").startswith("_")).select("id", "ns")
    linked = edges(spark, d).join(visible.select(F.col("id").alias("src")), "src", "left_semi").join(visible.select(F.col("id").alias("dst")), "dst", "left_semi")
    totals = visible.agg(F.count("*").alias("entries"), F.count_distinct("ns").alias("namespaces"))
    return totals.crossJoin(linked.agg(F.count("*").alias("edges")))  # one row each
