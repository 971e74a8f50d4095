"""Loading, upserting and migrating the store: row operators over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from heddle.functions import text as T
from heddle.functions.synonyms import COLLOQUIAL
from heddle.operators import journal as J
from heddle.plans.texts import loose_sql, table_sql, tokens_sql
from heddle.registry import Registry
from heddle.session import table
from heddle.sources.tables import EDGES_SQL, ENTRIES_SQL, edges, entries, latest
from heddle.sources.vectors import VECTOR_SQL, read_vector

REGISTRY = Registry()
query = REGISTRY.query

_RAW_SQL = "ra AS (SELECT * FROM entries QUALIFY row_number() OVER (PARTITION BY id ORDER BY ingested_at DESC) = 1)"


def _raw(spark: SparkSession, d: str) -> DataFrame:
    return latest(table(spark, d, "entries"), ["id"], [F.desc("ingested_at")])


@query("load_verified", f"WITH {_RAW_SQL} SELECT id, json_extract_string(json_data, '$.ns') AS ns, json_extract_string(json_data, '$.lifecycleState') AS lifecycle_state, sha256(json_data) AS checksum FROM ra WHERE json_valid(json_data) AND json_extract_string(json_data, '$.id') = id::VARCHAR")
def load_verified(spark: SparkSession, d: str) -> DataFrame:
    """Stored entries whose JSON is whole and names the row it is stored under; others are skipped, as a failed checksum is."""
    field = lambda p: F.get_json_object("json_data", p)
    rows = _raw(spark, d).where(F.try_parse_json("json_data").isNotNull() & (field("$.id") == F.col("id").cast("string")))
    return rows.select("id", field("$.ns").alias("ns"), field("$.lifecycleState").alias("lifecycle_state"), F.sha2("json_data", 256).alias("checksum"))


def point_read(rows: DataFrame, tenant: str, key: DataFrame) -> DataFrame:
    """Entries of ``tenant`` with an id in ``key`` (id); an id that several namespaces hold is ambiguous and gives nothing."""
    mine = rows.where(F.col("tenant_id") == tenant).join(key, "id", "left_semi")
    return mine.withColumn("_n", F.count("*").over(Window.partitionBy("id"))).where("_n = 1").drop("_n")


@query("point_read_unambiguous", "WITH t AS (SELECT id, coalesce(tenant_id, '') AS tenant_id, ns, any_value(text) AS text FROM entries GROUP BY 1, 2, 3), k AS (SELECT DISTINCT entry_a.id AS id FROM duplicate_pairs) SELECT id, ns, md5(text) AS digest FROM t WHERE tenant_id = 'acorn' AND id IN (SELECT id FROM k) QUALIFY count(*) OVER (PARTITION BY id) = 1")
def point_read_unambiguous(spark: SparkSession, d: str) -> DataFrame:
    """Reported entries of one tenant, read by id alone."""
    rows = table(spark, d, "entries").groupBy("id", F.coalesce("tenant_id", F.lit("")).alias("tenant_id"), "ns").agg(F.any_value("text").alias("text"))
    wanted = table(spark, d, "duplicate_pairs").select(F.col("entry_a.id").alias("id")).distinct()
    return point_read(rows, "acorn", wanted).select("id", "ns", F.md5(F.col("text").cast("binary")).alias("digest"))


@query("scan_tenant", f"WITH {ENTRIES_SQL} SELECT ns, id, lifecycle_state, access_count FROM e WHERE tenant_id = 'acorn'")
def scan_tenant(spark: SparkSession, d: str) -> DataFrame:
    """All entries of one tenant."""
    return entries(spark, d).where("tenant_id = 'acorn'").select("ns", "id", "lifecycle_state", "access_count")


@query("scan_namespace", f"WITH {ENTRIES_SQL}, n AS (SELECT ns FROM e GROUP BY ns ORDER BY count(*) DESC, ns LIMIT 1) SELECT id, tenant_id, lifecycle_state FROM e WHERE ns = (SELECT ns FROM n)")
def scan_namespace(spark: SparkSession, d: str) -> DataFrame:
    """All entries of the largest namespace."""
    rows = entries(spark, d)
    first = rows.where("ns is not null").groupBy("ns").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "ns").limit(1)
    return rows.join(F.broadcast(first), "ns", "left_semi").select("id", "tenant_id", "lifecycle_state")


_KEPT = 100
_TOTAL = 50_000


@query("upsert_rows", f"""WITH {ENTRIES_SQL}, {_RAW_SQL}, vv AS (SELECT id, {VECTOR_SQL} AS vector FROM ra),
nw AS (SELECT id, tenant_id, ns, lifecycle_state, text, row_number() OVER (PARTITION BY tenant_id, ns ORDER BY created_at NULLS FIRST, id) AS in_ns FROM e),
cp AS (SELECT *, row_number() OVER (ORDER BY id) AS overall FROM nw WHERE in_ns <= {_KEPT}),
kw AS (SELECT id, list_sort(list_distinct(list(m.other)))[1:20] AS k FROM (SELECT id, list_distinct({loose_sql('text')}) AS tk, unnest(list_distinct({loose_sql('text')})) AS term FROM e) x JOIN {table_sql(COLLOQUIAL)} ON m.term = x.term WHERE NOT list_contains(tk, m.other) GROUP BY id)
SELECT cp.id, cp.tenant_id, cp.ns, coalesce(array_to_string(kw.k, ' '), '') AS keywords, round(sqrt(list_sum(list_transform(vv.vector, lambda x: x * x))), 4) AS norm, cp.lifecycle_state IN ('ltm', 'archived') AND vv.vector IS NOT NULL AS quantized
FROM cp LEFT JOIN kw USING (id) LEFT JOIN vv USING (id) WHERE overall <= {_TOTAL}""")
def upsert_rows(spark: SparkSession, d: str) -> DataFrame:
    """A batch of new entries: keywords added, norm taken, long-term vectors quantised, up to 100 entries of a namespace.

    The total cap of the store is a feature of it; places in the whole are
    counted over what each namespace takes.
    """
    rows = entries(spark, d)
    capped = rows.withColumn("_in", F.row_number().over(Window.partitionBy("tenant_id", "ns").orderBy("created_at", "id"))).where(F.col("_in") <= _KEPT)
    if capped.count() > _TOTAL:
        capped = capped.orderBy("id").limit(_TOTAL)
    words = T.enrich(rows.select("id", "text"), "id", "text").select("id", F.array_join("keywords", " ").alias("keywords"))
    vectors = read_vector(_raw(spark, d), "id", "json_data")
    out = capped.drop("keywords").join(words, "id", "left").join(vectors, "id", "left")
    norm = F.sqrt(F.aggregate("vector", F.lit(0.0), lambda s, x: s + x * x))
    return out.select("id", "tenant_id", "ns", F.coalesce("keywords", F.lit("")).alias("keywords"), F.round(norm, 4).alias("norm"), (F.coalesce(F.col("lifecycle_state").isin("ltm", "archived"), F.lit(False)) & F.col("vector").isNotNull()).alias("quantized"))


@query("compression_stats", f"WITH {_RAW_SQL}, vv AS (SELECT ns, lower(trim(lifecycle_state)) AS s, {VECTOR_SQL} AS v FROM ra) SELECT ns, count(*) AS entries, count(v) AS vectors, coalesce(sum(len(v)) * 4, 0)::BIGINT AS fp32_bytes, coalesce(sum(len(v) + 12) FILTER (s IN ('ltm', 'archived')), 0)::BIGINT AS int8_bytes FROM vv GROUP BY ns")
def compression_stats(spark: SparkSession, d: str) -> DataFrame:
    """Bytes of the stored vectors that can be read, in float32 and in int8 with scale, minimum and self product."""
    raw = _raw(spark, d)
    rows = raw.select("id", "ns", F.lower(F.trim("lifecycle_state")).alias("s")).join(read_vector(raw, "id", "json_data"), "id", "left")
    return rows.groupBy("ns").agg(
        F.count("*").alias("entries"), F.count("vector").alias("vectors"), F.coalesce(F.sum(F.size("vector")) * 4, F.lit(0)).cast("long").alias("fp32_bytes"),
        F.coalesce(F.sum(F.when(F.col("s").isin("ltm", "archived"), F.size("vector") + 12)), F.lit(0)).cast("long").alias("int8_bytes"),
    )


@query("delete_cascade", f"WITH {ENTRIES_SQL}, {EDGES_SQL}, gone AS (SELECT DISTINCT entry_b.id AS id FROM duplicate_pairs), l AS (SELECT * FROM e WHERE id NOT IN (SELECT id FROM gone)), lg AS (SELECT * FROM g WHERE src NOT IN (SELECT id FROM gone) AND dst NOT IN (SELECT id FROM gone)) SELECT ns, count(*) AS entries, (SELECT count(*) FROM lg WHERE lg.src IN (SELECT id FROM l x WHERE x.ns = l.ns)) AS edges, count(DISTINCT category) AS clusters FROM l WHERE ns IS NOT NULL GROUP BY ns")
def delete_cascade(spark: SparkSession, d: str) -> DataFrame:
    """Entries, outgoing edges and clusters left in each namespace after a delete that takes edges and memberships along."""
    gone = table(spark, d, "duplicate_pairs").select(F.col("entry_b.id").alias("id")).distinct()
    left = entries(spark, d).join(gone, "id", "left_anti").where("ns is not null")
    rows = edges(spark, d)
    for end in ("src", "dst"):
        rows = rows.join(gone.withColumnRenamed("id", end), end, "left_anti")
    links = rows.join(left.select(F.col("id").alias("src"), "ns"), "src").groupBy("ns").agg(F.count("*").alias("edges"))
    counts = left.groupBy("ns").agg(F.count("*").alias("entries"), F.count_distinct("category").alias("clusters"))
    return counts.join(links, "ns", "left").select("ns", "entries", F.coalesce("edges", F.lit(0)).alias("edges"), "clusters")


@query("drop_namespaces", f"WITH {ENTRIES_SQL} SELECT tenant_id, ns, count(*) AS entries FROM e WHERE ns IS NOT NULL AND ns NOT IN (SELECT DISTINCT entry_a.ns FROM duplicate_pairs WHERE entry_a.ns IS NOT NULL) GROUP BY ALL")
def drop_namespaces(spark: SparkSession, d: str) -> DataFrame:
    """What is left after all namespaces with a reported first entry are dropped."""
    gone = table(spark, d, "duplicate_pairs").select(F.col("entry_a.ns").alias("ns")).distinct()
    return entries(spark, d).where("ns is not null").join(gone, "ns", "left_anti").groupBy("tenant_id", "ns").agg(F.count("*").alias("entries"))


@query("global_documents", f"WITH {EDGES_SQL}, {ENTRIES_SQL}, k AS (SELECT 'edges' AS key, src::VARCHAR || '>' || dst || ':' || relation AS item FROM g UNION ALL SELECT 'summaries', id::VARCHAR FROM e WHERE is_summary_node UNION ALL SELECT 'decay', DISTINCT_arm FROM (SELECT DISTINCT arm AS DISTINCT_arm FROM task_results)) SELECT key, count(*) AS items, sha256(string_agg(item, chr(10) ORDER BY item)) AS digest FROM k GROUP BY key")
def global_documents(spark: SparkSession, d: str) -> DataFrame:
    """The store's global documents by key, each with the digest of its ordered items."""
    links = edges(spark, d).select(F.lit("edges").alias("key"), F.concat(F.col("src").cast("string"), F.lit(">"), F.col("dst").cast("string"), F.lit(":"), "relation").alias("item"))
    sums = entries(spark, d).where("is_summary_node").select(F.lit("summaries").alias("key"), F.col("id").cast("string").alias("item"))
    arms = table(spark, d, "task_results").select(F.lit("decay").alias("key"), F.col("arm").alias("item")).distinct()
    return J.digests(links.unionByName(sums).unionByName(arms), "key", "item")


@query("jsonl_lines", "WITH l AS (SELECT artifact_id, unnest(string_split(b, chr(10))) AS line, generate_subscripts(string_split(b, chr(10)), 1) AS n FROM (SELECT artifact_id, any_value(ltrim(body, chr(65279))) AS b FROM live_artifacts GROUP BY artifact_id)) SELECT artifact_id, n::INTEGER AS line_no, CASE WHEN json_valid(line) AND starts_with(trim(line, chr(32) || chr(9) || chr(13)), '{') THEN 'ok' ELSE 'error' END AS outcome FROM l WHERE trim(line, chr(32) || chr(9) || chr(13)) <> ''")
def jsonl_lines(spark: SparkSession, d: str) -> DataFrame:
    """Bodies read as JSON lines: each line is an object or an error that names its line; blank lines are skipped."""
    rows = table(spark, d, "live_artifacts").groupBy("artifact_id").agg(F.any_value(F.regexp_replace("body", "^\\ufeff", "")).alias("b"))
    return J.json_lines(rows, "artifact_id", "b").select("artifact_id", "line_no", "outcome")


@query("migrate_schema", f"WITH {_RAW_SQL} SELECT coalesce(tenant_id, '') || '/' || coalesce(ns, '') || '/' || id AS key, coalesce(lower(trim(json_extract_string(json_data, '$.lifecycleState'))), 'stm') AS lifecycle_state, 3 AS version FROM ra WHERE json_valid(json_data)")
def migrate_schema(spark: SparkSession, d: str) -> DataFrame:
    """Rows of the first version with the state column of the second and the tenant in the key of the third."""
    rows = _raw(spark, d).where(F.try_parse_json("json_data").isNotNull())
    none = F.lit("")
    return rows.select(F.concat(F.coalesce("tenant_id", none), F.lit("/"), F.coalesce("ns", none), F.lit("/"), F.col("id").cast("string")).alias("key"), F.coalesce(F.lower(F.trim(F.get_json_object("json_data", "$.lifecycleState"))), F.lit("stm")).alias("lifecycle_state"), F.lit(3).alias("version"))


def hash_vectors(df: DataFrame, text: str, dim: int = 64) -> DataFrame:
    """``df`` with ``vector``, a unit vector made of hashes of the text, one for each component; null for null and blank texts."""
    filled = F.when(F.trim(F.col(text)) != "", F.col(text))
    raw = df.withColumn("_raw", F.when(filled.isNotNull(), F.array(*[F.xxhash64(F.lit(i), filled) / F.lit(2.0**63) for i in range(dim)])))
    long = raw.withColumn("_length", F.sqrt(F.aggregate("_raw", F.lit(0.0), lambda s, x: s + x * x)))
    return long.withColumn("vector", F.transform("_raw", lambda x: x / F.col("_length"))).drop("_raw", "_length")


@query("hash_embedding")
def hash_embedding(spark: SparkSession, d: str) -> DataFrame:
    """Entries with vectors made by hashing; equal texts get equal vectors."""
    return hash_vectors(entries(spark, d), "text").select("id", "vector").where("vector is not null")


@query("reembed_counts", f"WITH {ENTRIES_SQL} SELECT ns, count(*) FILTER (trim(text) <> '') AS rebuilt, count(*) FILTER (text IS NULL OR trim(text) = '') AS skipped FROM e GROUP BY ns")
def reembed_counts(spark: SparkSession, d: str) -> DataFrame:
    """Vectors rebuilt from the texts of each namespace; blank texts are skipped."""
    rows = hash_vectors(entries(spark, d), "text")
    return rows.groupBy("ns").agg(F.count("vector").alias("rebuilt"), F.count(F.when(F.col("vector").isNull(), 1)).alias("skipped"))


_JOURNAL_SQL = "jn AS (SELECT event_id AS seq, user_id AS key, CASE WHEN event_type = 'error' THEN 'delete' ELSE 'put' END AS op, value FROM events)"


@query("journal_replay", f"WITH {_JOURNAL_SQL}, l AS (SELECT * FROM jn QUALIFY row_number() OVER (PARTITION BY key ORDER BY seq DESC) = 1) SELECT key, seq, value FROM l WHERE op = 'put'")
def journal_replay(spark: SparkSession, d: str) -> DataFrame:
    """State after an append-only journal was replayed over an empty snapshot; rows whose checksum fails are torn and count for nothing."""
    rows = table(spark, d, "events").select(F.col("event_id").alias("seq"), F.col("user_id").alias("key"), F.when(F.col("event_type") == "error", "delete").otherwise("put").alias("op"), "value")
    return J.replay(rows.limit(0), J.sealed(rows), "key", "seq", "op").select("key", "seq", "value")


@query("tenant_paths", f"WITH {ENTRIES_SQL}, p AS (SELECT DISTINCT json_extract_string(json_data, '$.tenantId') AS t, json_extract_string(json_data, '$.ns') AS n FROM entries WHERE json_valid(json_data)), m AS (SELECT coalesce(tenant_id, '') AS t, coalesce(ns, '') AS n, count(*) AS have FROM e GROUP BY ALL), w AS (SELECT coalesce(json_extract_string(json_data, '$.tenantId'), '') AS t, coalesce(json_extract_string(json_data, '$.ns'), '') AS n, count(DISTINCT id) AS want FROM entries WHERE json_valid(json_data) GROUP BY ALL) SELECT t AS tenant_id, n AS ns, coalesce(want, 0) AS stored, coalesce(have, 0) AS migrated, coalesce(want, 0) = coalesce(have, 0) AS parity FROM w FULL JOIN m USING (t, n)")
def tenant_paths(spark: SparkSession, d: str) -> DataFrame:
    """Dry run of a migration: rows of each tenant and namespace as stored in JSON and in columns, and whether they agree."""
    have = entries(spark, d).groupBy(F.coalesce("tenant_id", F.lit("")).alias("tenant_id"), F.coalesce("ns", F.lit("")).alias("ns")).agg(F.count("*").alias("_have"))
    field = lambda p: F.coalesce(F.get_json_object("json_data", p), F.lit(""))
    want = table(spark, d, "entries").where(F.try_parse_json("json_data").isNotNull()).groupBy(field("$.tenantId").alias("tenant_id"), field("$.ns").alias("ns")).agg(F.count_distinct("id").alias("_want"))
    both = want.join(have, ["tenant_id", "ns"], "full_outer").select("tenant_id", "ns", F.coalesce("_want", F.lit(0)).alias("stored"), F.coalesce("_have", F.lit(0)).alias("migrated"))
    return both.withColumn("parity", F.col("stored") == F.col("migrated"))


@query("argument_hash", "SELECT DISTINCT id, sha256('{' || array_to_string(list_sort(list_transform(map_entries(metadata), lambda x: to_json(x.key) || ':' || coalesce(to_json(x.value), 'null'))), ',') || '}') AS digest FROM entries WHERE metadata IS NOT NULL")
def argument_hash(spark: SparkSession, d: str) -> DataFrame:
    """Digest of a map's JSON with sorted keys; quoted, so that no two maps share one."""
    parts = F.transform(F.map_entries("metadata"), lambda e: F.concat(J.quoted(e["key"]), F.lit(":"), F.coalesce(J.quoted(e["value"]), F.lit("null"))))
    return table(spark, d, "entries").where("metadata is not null").select("id", F.sha2(F.concat(F.lit("{"), F.array_join(F.array_sort(parts), ","), F.lit("}")), 256).alias("digest")).distinct()


@query("keyword_lists", "SELECT DISTINCT id, list_filter(list_transform(string_split_regex(trim(keywords, '[] '), '[,;|]'), lambda x: trim(x, ' \"')), lambda x: x <> '') AS keywords FROM entries WHERE keywords IS NOT NULL")
def keyword_lists(spark: SparkSession, d: str) -> DataFrame:
    """Lists that are written as arrays, separated values or one word, as lists."""
    parts = F.transform(F.split(F.regexp_replace("keywords", r"^[\[\] ]+|[\[\] ]+$", ""), "[,;|]"), lambda x: F.regexp_replace(x, '^[ "]+|[ "]+$', ""))
    return table(spark, d, "entries").where("keywords is not null").select("id", F.filter(parts, lambda x: x != "").alias("keywords")).distinct()


_RUBRIC = r"(--[a-z]+(?:-[a-z]+)*=\d+|[a-z]+(?:/[a-z]+)+-\d+|[a-z]+(?:_[a-z]+)+_\d+|[a-z]+(?:[A-Z][a-z]+)+\d+\(\)|\b\d+ (?:ms|rows|kB|hours|days|seconds|tokens|links|percent)\b)"


@query("rubric_patterns", f"WITH t AS (SELECT result_id, any_value(gold_answer) AS g, any_value(answer) AS a FROM task_results GROUP BY result_id), x AS (SELECT result_id, a, list_distinct(list_transform(regexp_extract_all(g, '{_RUBRIC}', 1), lambda p: lower(p))) AS patterns FROM t WHERE g IS NOT NULL) SELECT result_id, len(patterns)::INTEGER AS patterns, len(list_filter(patterns, lambda p: contains(lower(coalesce(a, '')), p))) = len(patterns) AS passed FROM x WHERE len(patterns) > 0")
def rubric_patterns(spark: SparkSession, d: str) -> DataFrame:
    """Options, paths, names, calls and quantities of a gold answer; an answer passes if it holds them all, whatever the case."""
    rows = table(spark, d, "task_results").groupBy("result_id").agg(F.any_value("gold_answer").alias("g"), F.any_value("answer").alias("a")).where("g is not null")
    rows = rows.select("result_id", F.lower(F.coalesce("a", F.lit(""))).alias("a"), F.array_distinct(F.transform(F.regexp_extract_all("g", F.lit(_RUBRIC), F.lit(1)), F.lower)).alias("p")).where(F.size("p") > 0)
    return rows.select("result_id", F.size("p").alias("patterns"), F.forall("p", lambda p: F.contains(F.col("a"), p)).alias("passed"))
