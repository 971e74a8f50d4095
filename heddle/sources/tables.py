"""The store's tables in normal form: one row for each key, names and states spelled alike."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from heddle.session import table


def latest(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One row for each key: the first in ``order``; the whole row is kept."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_rank", rank).where("_rank = 1").drop("_rank")


def entries(spark: SparkSession, d: str) -> DataFrame:
    """Entries without redeliveries; tenant '' where null; state and category in lower case."""
    rows = table(spark, d, "entries").drop("json_data", "metadata")
    rows = latest(rows, ["id"], [F.desc("ingested_at")])
    clean = lambda c: F.lower(F.trim(F.col(c)))
    return rows.withColumns({"tenant_id": F.coalesce("tenant_id", F.lit("")), "lifecycle_state": clean("lifecycle_state"), "category": F.nullif(clean("category"), F.lit(""))})


ENTRIES_SQL = """e AS (
  SELECT * REPLACE (coalesce(tenant_id, '') AS tenant_id, lower(trim(lifecycle_state)) AS lifecycle_state, nullif(lower(trim(category)), '') AS category)
  FROM (SELECT * EXCLUDE (json_data, metadata) FROM entries QUALIFY row_number() OVER (PARTITION BY id ORDER BY ingested_at DESC) = 1))"""


def relation(c: Column) -> Column:
    """A relation's name in snake case, whatever its case and separators."""
    snake = F.regexp_replace(F.trim(c), "([a-z])([A-Z])", "$1_$2")
    return F.lower(F.regexp_replace(snake, "[^A-Za-z0-9]+", "_"))


def edges(spark: SparkSession, d: str) -> DataFrame:
    """(src, dst, relation, weight, recorded_at): one row for each edge, recorded last; weights in [0, 1], 1 where null."""
    rows = table(spark, d, "edges").where("source_id is not null and target_id is not null and relation is not null")
    weight = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce("weight", F.lit(1.0))))
    rows = rows.select(F.col("source_id").alias("src"), F.col("target_id").alias("dst"), relation(F.col("relation")).alias("relation"), weight.alias("weight"), "recorded_at")
    return latest(rows, ["src", "dst", "relation"], [F.desc("recorded_at"), F.desc("weight")])


EDGES_SQL = """g AS (
  SELECT * FROM (
    SELECT source_id AS src, target_id AS dst, lower(regexp_replace(regexp_replace(trim(relation), '([a-z])([A-Z])', '\\1_\\2', 'g'), '[^A-Za-z0-9]+', '_', 'g')) AS relation,
      greatest(0.0::DOUBLE, least(1.0::DOUBLE, coalesce(weight, 1.0::DOUBLE))) AS weight, recorded_at
    FROM edges WHERE source_id IS NOT NULL AND target_id IS NOT NULL AND relation IS NOT NULL)
  QUALIFY row_number() OVER (PARTITION BY src, dst, relation ORDER BY recorded_at DESC, weight DESC) = 1)"""


def corpus(spark: SparkSession, d: str) -> DataFrame:
    """Documents as entries, with their vector where there is one: (id, text, vector, ns, category, lifecycle_state, access_count, is_summary_node)."""
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text", F.col("source").alias("ns"), F.col("doc_kind").alias("category"))
    vectors = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("vector"))
    state = F.element_at(F.array(*map(F.lit, ["stm", "ltm", "ltm", "archived"])), (F.col("id") % 4 + 1).cast("int"))
    return docs.join(vectors, "id", "left").withColumns({"lifecycle_state": state, "access_count": (F.col("id") % 7 + 1).cast("int"), "is_summary_node": F.col("id") % 11 == 0})


CORPUS_SQL = """c AS (
  SELECT d.doc_id AS id, d.text, d.source AS ns, d.doc_kind AS category, v.embedding::DOUBLE[] AS vector, (['stm','ltm','ltm','archived'])[d.doc_id % 4 + 1] AS lifecycle_state,
    (d.doc_id % 7 + 1)::INTEGER AS access_count, d.doc_id % 11 = 0 AS is_summary_node
  FROM documents d LEFT JOIN embeddings v ON v.vec_id = d.doc_id)"""
