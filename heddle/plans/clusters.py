"""Clusters and their summaries, collapse and undo, states, merging in full, keywords and summary texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from heddle.functions import text as T
from heddle.operators import retrieval as R
from heddle.plans.texts import tokens_sql
from heddle.registry import Registry
from heddle.session import table
from heddle.sources.tables import EDGES_SQL, ENTRIES_SQL, edges, entries

REGISTRY = Registry()
query = REGISTRY.query

#: A cluster holds the entries of a namespace and category that are no summaries, if there are three or more.
CLUSTERS_SQL = f"""{ENTRIES_SQL}, mb0 AS (SELECT id, ns || '/' || category AS cluster, lifecycle_state, access_count, activation_energy, created_at FROM e WHERE NOT coalesce(is_summary_node, false) AND category IS NOT NULL),
mb AS (SELECT * FROM mb0 QUALIFY count(*) OVER (PARTITION BY cluster) >= 3)"""

VECS_SQL = "vc AS (SELECT vec_id AS id, embedding::DOUBLE[] AS vector FROM embeddings)"


def _members(spark: SparkSession, d: str) -> DataFrame:
    rows = entries(spark, d).where("not coalesce(is_summary_node, false) and category is not null and ns is not null")
    rows = rows.select("id", F.concat_ws("/", "ns", "category").alias("cluster"), "lifecycle_state", "access_count", "activation_energy", "created_at")
    sizes = rows.groupBy("cluster").agg(F.count("*").alias("_n")).where("_n >= 3")
    return rows.join(sizes.select("cluster"), "cluster", "left_semi")


def centroids(members: DataFrame, vectors: DataFrame) -> DataFrame:
    """(cluster, members, with_vector, length): sizes and the length of each centroid, by sums per component.

    ``members``: (cluster, id); ``vectors``: (id, vector).  Members without a
    vector count, but do not move the centroid, whose length is then null.
    """
    rows = members.select("cluster", "id").join(vectors, "id", "left")
    sizes = rows.groupBy("cluster").agg(F.count("*").alias("members"), F.count("vector").alias("with_vector"))
    parts = rows.select("cluster", F.posexplode("vector").alias("i", "x")).groupBy("cluster", "i").agg(F.avg(F.col("x").cast("double")).alias("x"))
    lengths = parts.groupBy("cluster").agg(F.round(F.sqrt(F.sum(F.col("x") * F.col("x"))), 6).alias("length"))
    return sizes.join(lengths, "cluster", "left")


def _vectors(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))


def _centroid_sql(members: str) -> str:
    return f"""sz AS (SELECT cluster, count(*) AS members, count(vector) AS with_vector FROM {members} LEFT JOIN vc USING (id) GROUP BY cluster),
cx AS (SELECT cluster, i, avg(x) AS x FROM (SELECT cluster, unnest(vector) AS x, generate_subscripts(vector, 1) AS i FROM {members} JOIN vc USING (id)) GROUP BY ALL),
cl AS (SELECT cluster, round(sqrt(sum(x * x)), 6) AS length FROM cx GROUP BY cluster)
SELECT cluster, members, with_vector, length FROM sz LEFT JOIN cl USING (cluster)"""


@query("cluster_create", f"WITH {CLUSTERS_SQL}, {VECS_SQL}, {_centroid_sql('mb')}")
def cluster_create(spark: SparkSession, d: str) -> DataFrame:
    """All clusters with their centroids."""
    return centroids(_members(spark, d), _vectors(spark, d))


GONE_SQL = "gn AS (SELECT entry_b.id AS gone, min(entry_a.id) AS kept FROM duplicate_pairs WHERE entry_a.id < entry_b.id GROUP BY 1)"


def _gone(spark: SparkSession, d: str) -> DataFrame:
    pairs = table(spark, d, "duplicate_pairs").select(F.col("entry_b.id").alias("gone"), F.col("entry_a.id").alias("kept")).where("kept < gone")
    return pairs.groupBy("gone").agg(F.min("kept").alias("kept"))


@query("cluster_remove_members", f"WITH {CLUSTERS_SQL}, {VECS_SQL}, {GONE_SQL}, rm AS (SELECT cluster, id FROM mb WHERE id NOT IN (SELECT gone FROM gn)), {_centroid_sql('rm')}")
def cluster_remove_members(spark: SparkSession, d: str) -> DataFrame:
    """Centroids renewed after the later entry of each reported pair left its cluster; clusters left empty are gone."""
    left = _members(spark, d).join(_gone(spark, d).select(F.col("gone").alias("id")), "id", "left_anti")
    return centroids(left, _vectors(spark, d))


@query("cluster_transfer", f"WITH {CLUSTERS_SQL}, {VECS_SQL}, {GONE_SQL}, rm AS (SELECT DISTINCT cluster, coalesce(kept, id) AS id FROM mb LEFT JOIN gn ON gone = id), {_centroid_sql('rm')}")
def cluster_transfer(spark: SparkSession, d: str) -> DataFrame:
    """Memberships of merged entries go to the entry that stays; one that is there already stays single."""
    moved = _members(spark, d).join(_gone(spark, d), F.col("id") == F.col("gone"), "left").select("cluster", F.coalesce("kept", "id").alias("id")).distinct()
    return centroids(moved, _vectors(spark, d))


@query("clusters_of_entry", f"WITH {CLUSTERS_SQL}, k AS (SELECT cluster, count(*) AS members, max(created_at) AS newest FROM mb GROUP BY cluster) SELECT mb.id, cluster, members, newest FROM mb JOIN k USING (cluster) WHERE mb.id % 50 = 0")
def clusters_of_entry(spark: SparkSession, d: str) -> DataFrame:
    """The cluster of every 50th entry."""
    rows = _members(spark, d)
    sizes = rows.groupBy("cluster").agg(F.count("*").alias("members"), F.max("created_at").alias("newest"))
    return rows.where("id % 50 = 0").select("id", "cluster").join(sizes, "cluster")


@query("cluster_staleness", f"WITH {CLUSTERS_SQL}, sm AS (SELECT ns || '/' || category AS cluster, max(created_at) AS at FROM e WHERE is_summary_node AND category IS NOT NULL GROUP BY 1) SELECT cluster, count(*) AS members, count(*) FILTER (mb.created_at > sm.at) AS newer, any_value(sm.at) IS NULL OR count(*) FILTER (mb.created_at > sm.at) > 0 AS stale FROM mb LEFT JOIN sm USING (cluster) GROUP BY cluster")
def cluster_staleness(spark: SparkSession, d: str) -> DataFrame:
    """A cluster is stale if it has no summary or a member newer than that."""
    said = entries(spark, d).where("is_summary_node and category is not null and ns is not null").groupBy(F.concat_ws("/", "ns", "category").alias("cluster")).agg(F.max("created_at").alias("at"))
    newer = F.count(F.when(F.col("created_at") > F.col("at"), 1))
    rows = _members(spark, d).join(said, "cluster", "left").groupBy("cluster").agg(F.count("*").alias("members"), newer.alias("newer"), F.max("at").alias("at"))
    return rows.select("cluster", "members", "newer", (F.col("at").isNull() | (F.col("newer") > 0)).alias("stale"))


@query("store_cluster_summary", f"WITH {CLUSTERS_SQL} SELECT 'summary:' || cluster AS id, 'ltm' AS lifecycle_state, true AS is_summary_node, cluster AS source_cluster_id, sum(access_count)::BIGINT AS access_count, max(created_at) AS created_at FROM mb GROUP BY cluster")
def store_cluster_summary(spark: SparkSession, d: str) -> DataFrame:
    """The summary entry of each cluster."""
    rows = _members(spark, d).groupBy("cluster").agg(F.sum("access_count").alias("access_count"), F.max("created_at").alias("created_at"))
    return rows.select(F.concat(F.lit("summary:"), "cluster").alias("id"), F.lit("ltm").alias("lifecycle_state"), F.lit(True).alias("is_summary_node"), F.col("cluster").alias("source_cluster_id"), "access_count", "created_at")


@query("promote_states", f"WITH {ENTRIES_SQL} SELECT id, lifecycle_state AS old_state, CASE WHEN access_count >= 5 AND lifecycle_state = 'stm' THEN 'ltm' WHEN access_count = 0 AND lifecycle_state = 'ltm' THEN 'archived' ELSE lifecycle_state END AS new_state, access_count >= 5 AND lifecycle_state = 'stm' AS quantized FROM e WHERE lifecycle_state IN ('stm', 'ltm', 'archived')")
def promote_states(spark: SparkSession, d: str) -> DataFrame:
    """Much used short-term entries become long-term, unused long-term ones are archived; what enters ltm is quantised anew. Unknown states are refused."""
    rows = entries(spark, d).where(F.col("lifecycle_state").isin("stm", "ltm", "archived"))
    up, down = (F.col("access_count") >= 5) & (F.col("lifecycle_state") == "stm"), (F.col("access_count") == 0) & (F.col("lifecycle_state") == "ltm")
    return rows.select("id", F.col("lifecycle_state").alias("old_state"), F.when(up, "ltm").when(down, "archived").otherwise(F.col("lifecycle_state")).alias("new_state"), up.alias("quantized"))


_COLLAPSE = f"""{CLUSTERS_SQL}, lt AS (SELECT *, count(*) OVER (PARTITION BY cluster) AS n FROM mb WHERE lifecycle_state = 'ltm' QUALIFY count(*) OVER (PARTITION BY cluster) >= 3)"""


def collapsed(spark: SparkSession, d: str) -> DataFrame:
    """(cluster, id, before): members of clusters with three long-term entries or more, and the state they had."""
    rows = _members(spark, d).where("lifecycle_state = 'ltm'")
    big = rows.groupBy("cluster").agg(F.count("*").alias("_n")).where("_n >= 3").select("cluster")
    return rows.join(big, "cluster", "left_semi").select("cluster", "id", F.col("lifecycle_state").alias("before"))


@query("collapse_states", f"WITH {_COLLAPSE} SELECT id::VARCHAR AS id, 'archived' AS new_state, lifecycle_state AS before, cluster FROM lt UNION ALL SELECT 'summary:' || cluster, 'ltm', NULL, cluster FROM lt GROUP BY cluster")
def collapse_states(spark: SparkSession, d: str) -> DataFrame:
    """Members are archived and remember their state, a summary entry takes their place."""
    rows = collapsed(spark, d)
    members = rows.select(F.col("id").cast("string").alias("id"), F.lit("archived").alias("new_state"), "before", "cluster")
    return members.unionByName(rows.select("cluster").distinct().select(F.concat(F.lit("summary:"), "cluster").alias("id"), F.lit("ltm").alias("new_state"), F.lit(None).cast("string").alias("before"), "cluster"))


@query("collapse_undo", f"WITH {_COLLAPSE}, ud AS (SELECT cluster FROM lt GROUP BY cluster HAVING min(created_at) < TIMESTAMPTZ '2026-03-01 00:00:00+00') SELECT e.id, CASE WHEN lt.id IS NOT NULL AND lt.cluster NOT IN (SELECT cluster FROM ud) THEN 'archived' ELSE e.lifecycle_state END AS lifecycle_state FROM e LEFT JOIN lt USING (id)")
def collapse_undo(spark: SparkSession, d: str) -> DataFrame:
    """All states after the collapse was undone for clusters with a member from before March: members get their old state back."""
    rows = _members(spark, d).where("lifecycle_state = 'ltm'").groupBy("cluster").agg(F.min("created_at").alias("oldest"))
    undone = rows.where(F.col("oldest") < F.lit("2026-03-01 00:00:00").cast("timestamp")).select("cluster", F.lit(True).alias("_undone"))
    history = collapsed(spark, d).join(undone, "cluster", "left").select("id", F.when(F.col("_undone"), F.col("before")).otherwise("archived").alias("after"))
    return entries(spark, d).join(history, "id", "left").select("id", F.coalesce("after", "lifecycle_state").alias("lifecycle_state"))


@query("accretion_pending", f"""WITH {CLUSTERS_SQL}, fp AS (SELECT cluster, count(*) AS members, substr(sha256(string_agg(id::VARCHAR, chr(10) ORDER BY id::VARCHAR)), 1, 32) AS fingerprint, bool_or(id IN (SELECT entry_b.id FROM duplicate_pairs)) AS dismissed FROM mb GROUP BY cluster),
kn AS (SELECT substr(sha256(string_agg(id::VARCHAR, chr(10) ORDER BY id::VARCHAR)), 1, 32) AS fingerprint FROM mb WHERE created_at < TIMESTAMPTZ '2026-05-01 00:00:00+00' GROUP BY cluster)
SELECT cluster, members, fingerprint FROM fp WHERE NOT dismissed AND fingerprint NOT IN (SELECT fingerprint FROM kn)""")
def accretion_pending(spark: SparkSession, d: str) -> DataFrame:
    """Groups that are new since May: not equal to a group that was pending then, and without a dismissed member."""
    mark = lambda rows: rows.groupBy("cluster").agg(F.count("*").alias("members"), F.substring(F.sha2(F.array_join(F.array_sort(F.collect_list(F.col("id").cast("string"))), "\n"), 256), 1, 32).alias("fingerprint"))
    rows = _members(spark, d)
    known = mark(rows.where(F.col("created_at") < F.lit("2026-05-01 00:00:00").cast("timestamp"))).select("fingerprint")
    dismissed = rows.join(table(spark, d, "duplicate_pairs").select(F.col("entry_b.id").alias("id")), "id", "left_semi").select("cluster").distinct()
    return mark(rows).join(dismissed, "cluster", "left_anti").join(known, "fingerprint", "left_anti").select("cluster", "members", "fingerprint")


@query("merge_traces", f"WITH {EDGES_SQL}, {GONE_SQL}, {ENTRIES_SQL}, ok AS (SELECT gone, kept FROM gn WHERE gone IN (SELECT id FROM e) AND kept IN (SELECT id FROM e)), mv AS (SELECT DISTINCT coalesce(a.kept, src) AS src, coalesce(b.kept, dst) AS dst, relation FROM g LEFT JOIN ok a ON a.gone = src LEFT JOIN ok b ON b.gone = dst) SELECT src, dst, relation FROM mv WHERE src <> dst UNION SELECT kept, gone, 'elaborates' FROM ok")
def merge_traces(spark: SparkSession, d: str) -> DataFrame:
    """The graph after merging: edges moved to the entry that stays, and one trace edge to each merged entry."""
    there = entries(spark, d).select("id")
    gone = _gone(spark, d).join(there.withColumnRenamed("id", "gone"), "gone", "left_semi").join(there.withColumnRenamed("id", "kept"), "kept", "left_semi")
    rows = edges(spark, d).select("src", "dst", "relation")
    for end in ("src", "dst"):
        rows = rows.join(gone.withColumnRenamed("gone", end), end, "left").withColumn(end, F.coalesce("kept", end)).drop("kept")
    traces = gone.select(F.col("kept").alias("src"), F.col("gone").alias("dst"), F.lit("elaborates").alias("relation"))
    return rows.where("src <> dst").select("src", "dst", "relation").unionByName(traces).distinct()


_NEAR = "s AS (SELECT a.vec_id AS id, b.vec_id AS other, list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS score FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0), top AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY id ORDER BY round(score, 9) DESC, other) <= 5)"


def _nearest(spark: SparkSession, d: str) -> DataFrame:
    rows = _vectors(spark, d)
    return R.knn(rows.where("id % 50 = 0").withColumnRenamed("id", "query_id"), rows.withColumnRenamed("id", "other"), 6, key="other").where("query_id <> other")


@query("remember_links", f"WITH {_NEAR}, bl AS (SELECT id, max(score) AS best FROM top GROUP BY id) SELECT id, other, CASE WHEN score >= 0.35 THEN 'similar_to' ELSE 'cross_reference' END AS relation, round(score, 6) AS weight FROM top JOIN bl USING (id) WHERE best < 0.45 AND score >= 0.30")
def remember_links(spark: SparkSession, d: str) -> DataFrame:
    """Links of new entries that are stored, to their five nearest; one that is too near an old entry is blocked.

    Bars suit the test vectors; the defaults are 0.95 to block, 0.85 and 0.65 to link.
    """
    order = Window.partitionBy("query_id")
    near = _nearest(spark, d).withColumn("r", F.row_number().over(order.orderBy(F.desc(F.round("score", 9)), "other"))).where("r <= 5")
    near = near.withColumn("best", F.max("score").over(order)).where("best < 0.45 and score >= 0.30")
    return near.select(F.col("query_id").alias("id"), "other", F.when(F.col("score") >= 0.35, "similar_to").otherwise("cross_reference").alias("relation"), F.round("score", 6).alias("weight"))


@query("reflect", f"WITH {_NEAR}, {ENTRIES_SQL}, j AS (SELECT top.*, e.category FROM top LEFT JOIN e ON e.id = top.other) SELECT id, CASE WHEN coalesce(max(CASE WHEN category = 'lesson' THEN score END), 0) >= 0.40 THEN 'blocked' ELSE 'stored' END AS outcome, count(*) FILTER (score >= 0.33) AS links, count(*) FILTER (score >= 0.30 AND category = 'lesson') AS surfaced FROM j GROUP BY id")
def reflect(spark: SparkSession, d: str) -> DataFrame:
    """A lesson is refused if an old one says nearly the same, else stored and linked; near old lessons are shown.

    The defaults are 0.92 to block, 0.70 to link and 0.60 to show.
    """
    order = Window.partitionBy("query_id").orderBy(F.desc(F.round("score", 9)), "other")
    near = _nearest(spark, d).withColumn("r", F.row_number().over(order)).where("r <= 5")
    near = near.join(entries(spark, d).select(F.col("id").alias("other"), "category"), "other", "left")
    lesson = F.col("category") == "lesson"
    rows = near.groupBy(F.col("query_id").alias("id")).agg(F.max(F.when(lesson, F.col("score"))).alias("b"), F.count(F.when(F.col("score") >= 0.33, 1)).alias("links"), F.count(F.when(lesson & (F.col("score") >= 0.30), 1)).alias("surfaced"))
    return rows.select("id", F.when(F.coalesce("b", F.lit(0.0)) >= 0.40, "blocked").otherwise("stored").alias("outcome"), "links", "surfaced")


_KEYWORDS = f"""{ENTRIES_SQL}, tk AS (SELECT tenant_id, ns, id, unnest({tokens_sql('text')}) AS term FROM e WHERE ns IS NOT NULL),
nn AS (SELECT tenant_id, ns, count(*) AS n FROM e WHERE ns IS NOT NULL GROUP BY ALL),
kw AS (SELECT tenant_id, ns, term, count(*) AS tf, count(DISTINCT id) AS df FROM tk WHERE length(term) >= 3 GROUP BY ALL HAVING count(*) >= 2),
ks AS (SELECT tenant_id, ns, term, tf, df, tf * CASE WHEN df < n THEN ln(n::DOUBLE / df + 1) ELSE 0.5 END AS score FROM kw JOIN nn USING (tenant_id, ns)),
kr AS (SELECT *, row_number() OVER (PARTITION BY tenant_id, ns ORDER BY round(score, 9) DESC, term) AS r FROM ks QUALIFY r <= 8)"""


def keywords(rows: DataFrame, group: list[str], key: str, text: str, k: int = 8) -> DataFrame:
    """(group, term, tf, df, score, r): the k terms that mark each group, by frequency and rarity among its texts.

    Terms are counted from two occurrences and three characters on; the score
    is tf * ln(n / df + 1), or tf / 2 for a term of all texts.
    """
    sizes = rows.groupBy(*group).agg(F.count("*").alias("_n"))
    terms = rows.select(*group, key, F.explode(T.lexical_tokens(F.col(text))).alias("term")).where(F.length("term") >= 3)
    # Counted for each text first, so that a frequent term of a large group is many small rows no more.
    counted = terms.groupBy(*group, key, "term").agg(F.count("*").alias("tf")).groupBy(*group, "term").agg(F.sum("tf").alias("tf"), F.count("*").alias("df")).where("tf >= 2")
    rarity = F.when(F.col("df") < F.col("_n"), F.log(F.col("_n") / F.col("df") + 1)).otherwise(F.lit(0.5))
    scored = counted.join(sizes, group).withColumn("score", F.col("tf") * rarity)
    order = Window.partitionBy(*group).orderBy(F.desc(F.round("score", 9)), "term")
    return scored.withColumn("r", F.row_number().over(order)).where(F.col("r") <= k).drop("_n")


def _named(spark: SparkSession, d: str) -> DataFrame:
    return entries(spark, d).where("ns is not null")


@query("keyword_extraction", f"WITH {_KEYWORDS} SELECT tenant_id, ns, term, tf, df, round(score, 6) AS score, r::INTEGER AS r FROM kr")
def keyword_extraction(spark: SparkSession, d: str) -> DataFrame:
    """Keywords of each namespace, unstemmed."""
    return keywords(_named(spark, d), ["tenant_id", "ns"], "id", "text").withColumn("score", F.round("score", 6))


_BREAKDOWN = "cb AS (SELECT tenant_id, ns, category, count(*) AS n FROM e WHERE ns IS NOT NULL AND category IS NOT NULL GROUP BY ALL), cr AS (SELECT *, row_number() OVER (PARTITION BY tenant_id, ns ORDER BY n DESC, category) AS r FROM cb QUALIFY r <= 3)"


def _breakdown(rows: DataFrame, group: list[str]) -> DataFrame:
    counted = rows.where("category is not null").groupBy(*group, "category").agg(F.count("*").alias("n"))
    return counted.withColumn("r", F.row_number().over(Window.partitionBy(*group).orderBy(F.desc("n"), "category"))).where("r <= 3")


@query("category_breakdown", f"WITH {ENTRIES_SQL}, {_BREAKDOWN} SELECT tenant_id, ns, category, n, r::INTEGER AS r FROM cr")
def category_breakdown(spark: SparkSession, d: str) -> DataFrame:
    """The three largest categories of each namespace."""
    return _breakdown(_named(spark, d), ["tenant_id", "ns"])


@query("representative_snippets", f"WITH {ENTRIES_SQL} SELECT tenant_id, ns, id, length(text)::INTEGER AS size FROM e WHERE ns IS NOT NULL AND text IS NOT NULL QUALIFY row_number() OVER (PARTITION BY tenant_id, ns ORDER BY length(text) DESC, access_count DESC NULLS LAST, id) <= 2")
def representative_snippets(spark: SparkSession, d: str) -> DataFrame:
    """The two entries that speak for a namespace: longest first, then most used."""
    order = Window.partitionBy("tenant_id", "ns").orderBy(F.desc(F.length("text")), F.desc_nulls_last("access_count"), "id")
    rows = _named(spark, d).where("text is not null").withColumn("r", F.row_number().over(order)).where("r <= 2")
    return rows.select("tenant_id", "ns", "id", F.length("text").alias("size"))


@query("summary_text", f"WITH {_KEYWORDS}, {_BREAKDOWN}, a AS (SELECT tenant_id, ns, string_agg(category || ' (' || n || ')', ', ' ORDER BY r) AS c FROM cr GROUP BY ALL), b AS (SELECT tenant_id, ns, string_agg(term, ', ' ORDER BY r) AS k FROM kr GROUP BY ALL) SELECT tenant_id, ns, nn.n || ' entries. Categories: ' || coalesce(c, 'none') || '. Keywords: ' || coalesce(k, 'none') || '.' AS summary FROM nn LEFT JOIN a USING (tenant_id, ns) LEFT JOIN b USING (tenant_id, ns)")
def summary_text(spark: SparkSession, d: str) -> DataFrame:
    """One sentence or two about each namespace."""
    rows, group = _named(spark, d), ["tenant_id", "ns"]
    listed = lambda df, c, name: df.groupBy(*group).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r", c.alias("t")))), lambda e: e["t"]), ", ").alias(name))
    a = listed(_breakdown(rows, group), F.concat("category", F.lit(" ("), F.col("n").cast("string"), F.lit(")")), "c")
    b = listed(keywords(rows, group, "id", "text"), F.col("term"), "k")
    sizes = rows.groupBy(*group).agg(F.count("*").cast("string").alias("n")).join(a, group, "left").join(b, group, "left")
    none = F.lit("none")
    return sizes.select(*group, F.concat("n", F.lit(" entries. Categories: "), F.coalesce("c", none), F.lit(". Keywords: "), F.coalesce("k", none), F.lit(".")).alias("summary"))


@query("contradiction_resolution", f"WITH {EDGES_SQL}, {ENTRIES_SQL}, cp AS (SELECT DISTINCT src, dst FROM g WHERE relation = 'contradicts'), dr AS (SELECT CASE WHEN a.lifecycle_state = 'archived' AND b.lifecycle_state <> 'archived' THEN a.id WHEN b.lifecycle_state = 'archived' AND a.lifecycle_state <> 'archived' THEN b.id END AS id FROM cp JOIN e a ON a.id = src JOIN e b ON b.id = dst) SELECT id, ns FROM e WHERE id NOT IN (SELECT id FROM dr WHERE id IS NOT NULL)")
def contradiction_resolution(spark: SparkSession, d: str) -> DataFrame:
    """Entries without the archived side of a contradiction whose other side is live."""
    rows = entries(spark, d)
    state = lambda end, name: rows.select(F.col("id").alias(end), F.col("lifecycle_state").alias(name))
    pairs = edges(spark, d).where("relation = 'contradicts'").select("src", "dst").distinct().join(state("src", "a"), "src").join(state("dst", "b"), "dst")
    old = F.when((F.col("a") == "archived") & (F.col("b") != "archived"), F.col("src")).when((F.col("b") == "archived") & (F.col("a") != "archived"), F.col("dst"))
    return rows.join(pairs.select(old.alias("id")).where("id is not null"), "id", "left_anti").select("id", "ns")


@query("contradiction_finder", f"WITH {EDGES_SQL}, k AS (SELECT DISTINCT least(src, dst) AS a, greatest(src, dst) AS b FROM g WHERE relation = 'contradicts'), vp AS (SELECT x.vec_id AS a, y.vec_id AS b, list_cosine_similarity(x.embedding::DOUBLE[], y.embedding::DOUBLE[]) AS score FROM embeddings x JOIN embeddings y ON x.vec_id < y.vec_id) SELECT k.a AS id_a, k.b AS id_b, 'edge' AS source, round(vp.score, 6) AS score FROM k LEFT JOIN vp USING (a, b) UNION ALL SELECT a, b, 'similar', round(score, 6) FROM vp WHERE score >= 0.38 AND (a, b) NOT IN (SELECT (a, b) FROM k)")
def contradiction_finder(spark: SparkSession, d: str) -> DataFrame:
    """Known contradictions with their cosine, and further pairs so near that they may contradict each other."""
    known = edges(spark, d).where("relation = 'contradicts'").select(F.least("src", "dst").alias("id_a"), F.greatest("src", "dst").alias("id_b")).distinct()
    vectors = _vectors(spark, d)
    side = lambda c, v: vectors.select(F.col("id").alias(c), F.col("vector").alias(v))
    from heddle.functions.vector import cosine

    told = known.join(side("id_a", "x"), "id_a", "left").join(side("id_b", "y"), "id_b", "left").select("id_a", "id_b", F.lit("edge").alias("source"), F.round(F.when(F.col("x").isNotNull() & F.col("y").isNotNull(), cosine(F.col("x"), F.col("y"))), 6).alias("score"))
    near = R.pairs_above(vectors, 0.38).join(known, ["id_a", "id_b"], "left_anti").select("id_a", "id_b", F.lit("similar").alias("source"), F.round("score", 6).alias("score"))
    return told.unionByName(near)


@query("prefiltered_duplicates", "SELECT a.vec_id AS id_a, b.vec_id AS id_b, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS score FROM embeddings a JOIN embeddings b ON a.vec_id < b.vec_id WHERE list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) >= 0.35")
def prefiltered_duplicates(spark: SparkSession, d: str) -> DataFrame:
    """Pairs above a cosine by way of a subspace; exact, since what lies outside the subspace is bounded by its length."""
    return R.pairs_above_prefiltered(_vectors(spark, d), 0.35).withColumn("score", F.round("score", 6))


@query("worker_status", "SELECT operation_type AS worker, max(reported_at) AS last_run, count(DISTINCT summary_id) AS cycles, sum(sample_total)::BIGINT AS total FROM (SELECT DISTINCT ON (summary_id) * FROM metric_summaries) GROUP BY operation_type")
def worker_status(spark: SparkSession, d: str) -> DataFrame:
    """Last run, cycles and totals of each worker."""
    rows = table(spark, d, "metric_summaries").dropDuplicates(["summary_id"])
    return rows.groupBy(F.col("operation_type").alias("worker")).agg(F.max("reported_at").alias("last_run"), F.count("*").alias("cycles"), F.sum("sample_total").alias("total"))


@query("unmatched_keys", "WITH s AS (SELECT DISTINCT dataset_id, search_mode, query_id FROM query_scores WHERE query_id IS NOT NULL), b AS (SELECT dataset_id, query_id FROM s WHERE search_mode = 'vector'), m AS (SELECT DISTINCT dataset_id, search_mode FROM s WHERE search_mode <> 'vector') SELECT m.dataset_id, m.search_mode, count(*) FILTER (s.query_id IS NULL) AS only_base, 0::BIGINT + (SELECT count(*) FROM s x WHERE x.dataset_id = m.dataset_id AND x.search_mode = m.search_mode AND NOT EXISTS (SELECT 1 FROM b y WHERE y.dataset_id = x.dataset_id AND y.query_id = x.query_id)) AS only_candidate FROM m JOIN b USING (dataset_id) LEFT JOIN s ON s.dataset_id = m.dataset_id AND s.search_mode = m.search_mode AND s.query_id = b.query_id GROUP BY m.dataset_id, m.search_mode")
def unmatched_keys(spark: SparkSession, d: str) -> DataFrame:
    """Queries that only one side of a comparison has; a gate refuses to compare where there are any."""
    rows = table(spark, d, "query_scores").where("query_id is not null").select("dataset_id", "search_mode", "query_id").distinct()
    base = rows.where("search_mode = 'vector'").select("dataset_id", "query_id")
    other = rows.where("search_mode <> 'vector'")
    modes = other.select("dataset_id", "search_mode").distinct()
    both = modes.join(base.withColumn("_b", F.lit(1)), "dataset_id").join(other.withColumn("_c", F.lit(1)), ["dataset_id", "search_mode", "query_id"], "full_outer")
    with_base = both.join(base.select("dataset_id").distinct(), "dataset_id", "left_semi")
    return with_base.groupBy("dataset_id", "search_mode").agg(F.count(F.when(F.col("_c").isNull(), 1)).alias("only_base"), F.count(F.when(F.col("_b").isNull(), 1)).alias("only_candidate"))
