"""Graph queries and density clusters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from heddle.functions import vector as V
from heddle.operators import graph as G
from heddle.operators import retrieval as R
from heddle.registry import Registry
from heddle.session import table
from heddle.sources.tables import EDGES_SQL, ENTRIES_SQL, edges, entries

REGISTRY = Registry()
query = REGISTRY.query

WEIGHT_SQL = "CASE relation WHEN 'depends_on' THEN 0.9::DOUBLE WHEN 'parent_child' THEN 0.8::DOUBLE WHEN 'elaborates' THEN 0.7::DOUBLE WHEN 'cross_reference' THEN 0.6::DOUBLE WHEN 'similar_to' THEN 0.5::DOUBLE WHEN 'contradicts' THEN 0.3::DOUBLE ELSE 0.5::DOUBLE END"


@query("edges_mirrored", f"WITH {EDGES_SQL}, b AS (SELECT src, dst, relation, weight FROM g UNION ALL SELECT dst, src, relation, weight FROM g WHERE relation = 'cross_reference') SELECT src, dst, relation, round(max(weight), 6) AS weight FROM b GROUP BY ALL")
def edges_mirrored(spark: SparkSession, d: str) -> DataFrame:
    return G.mirrored(edges(spark, d)).withColumn("weight", F.round("weight", 6))


@query("neighbors", f"WITH {EDGES_SQL}, {ENTRIES_SQL}, b AS (SELECT src AS id, dst AS other, relation, 'outgoing' AS direction FROM g UNION ALL SELECT dst, src, relation, 'incoming' FROM g) SELECT b.id, direction, relation, count(*) AS neighbours, min(other) AS first_neighbour FROM b JOIN e ON e.id = b.other GROUP BY ALL")
def neighbors(spark: SparkSession, d: str) -> DataFrame:
    """Neighbours that exist as entries, by direction and relation."""
    rows = edges(spark, d)
    both = rows.select(F.col("src").alias("id"), F.col("dst").alias("other"), "relation", F.lit("outgoing").alias("direction")).unionByName(rows.select(F.col("dst").alias("id"), F.col("src").alias("other"), "relation", F.lit("incoming").alias("direction")))
    there = both.join(entries(spark, d).select(F.col("id").alias("other")), "other", "left_semi")
    return there.groupBy("id", "direction", "relation").agg(F.count("*").alias("neighbours"), F.min("other").alias("first_neighbour"))


@query("bfs_traverse", f"WITH RECURSIVE {EDGES_SQL}, h AS (SELECT DISTINCT src, dst FROM g WHERE weight >= 0.2), r(start, node, depth) AS (SELECT id, id, 0 FROM (SELECT DISTINCT id FROM entries WHERE id % 50 = 0) UNION SELECT r.start, h.dst, r.depth + 1 FROM r JOIN h ON h.src = r.node WHERE r.depth < 3) SELECT start, node, min(depth)::INTEGER AS depth FROM r GROUP BY start, node")
def bfs_traverse(spark: SparkSession, d: str) -> DataFrame:
    """Three hops along edges of some weight, from every 50th entry."""
    starts = table(spark, d, "entries").where("id % 50 = 0").select(F.col("id").alias("start")).distinct()
    return G.traverse(edges(spark, d), starts, 3, least=0.2)


@query("contradictions", f"WITH {EDGES_SQL}, {ENTRIES_SQL} SELECT g.src, g.dst, coalesce(a.ns, b.ns) AS ns FROM g LEFT JOIN e a ON a.id = g.src LEFT JOIN e b ON b.id = g.dst WHERE relation = 'contradicts' AND (a.id IS NOT NULL OR b.id IS NOT NULL)")
def contradictions(spark: SparkSession, d: str) -> DataFrame:
    """Contradicting edges with either end in the store."""
    ns = entries(spark, d).select("id", "ns")
    rows = edges(spark, d).where("relation = 'contradicts'")
    rows = rows.join(ns.select(F.col("id").alias("src"), F.col("ns").alias("a")), "src", "left").join(ns.select(F.col("id").alias("dst"), F.col("ns").alias("b")), "dst", "left")
    return rows.where("a is not null or b is not null").select("src", "dst", F.coalesce("a", "b").alias("ns"))


@query("edge_transfer", f"WITH {EDGES_SQL}, m AS (SELECT entry_a.id AS gone, min(entry_b.id) AS kept FROM duplicate_pairs WHERE entry_a.id <> entry_b.id GROUP BY 1), t AS (SELECT coalesce(a.kept, src) AS src, coalesce(b.kept, dst) AS dst, relation, weight FROM g LEFT JOIN m a ON a.gone = src LEFT JOIN m b ON b.gone = dst) SELECT src, dst, relation, round(max(weight), 6) AS weight FROM t WHERE src <> dst GROUP BY src, dst, relation")
def edge_transfer(spark: SparkSession, d: str) -> DataFrame:
    """Edges after the first sides of reported pairs are merged into the second; self loops are dropped."""
    pairs = table(spark, d, "duplicate_pairs").select(F.col("entry_a.id").alias("gone"), F.col("entry_b.id").alias("kept")).where("gone <> kept")
    merged = pairs.groupBy("gone").agg(F.min("kept").alias("kept"))
    rows = edges(spark, d)
    for end in ("src", "dst"):
        rows = rows.join(merged.withColumnRenamed("gone", end), end, "left").withColumn(end, F.coalesce("kept", end)).drop("kept")
    return rows.where("src <> dst").groupBy("src", "dst", "relation").agg(F.round(F.max("weight"), 6).alias("weight"))


@query("graph_snapshot_stats", f"WITH {EDGES_SQL}, {ENTRIES_SQL}, v AS (SELECT id FROM e WHERE lifecycle_state <> 'archived') SELECT relation, count(*) AS edges, count(DISTINCT src) AS sources, round(avg(weight), 6) AS mean_weight FROM g WHERE src IN (SELECT id FROM v) AND dst IN (SELECT id FROM v) GROUP BY relation")
def graph_snapshot_stats(spark: SparkSession, d: str) -> DataFrame:
    """The graph induced by visible entries."""
    seen = entries(spark, d).where("lifecycle_state <> 'archived'").select("id")
    rows = edges(spark, d).join(seen.withColumnRenamed("id", "src"), "src", "left_semi").join(seen.withColumnRenamed("id", "dst"), "dst", "left_semi")
    return rows.groupBy("relation").agg(F.count("*").alias("edges"), F.count_distinct("src").alias("sources"), F.round(F.avg("weight"), 6).alias("mean_weight"))


@query("auto_link", f"WITH {EDGES_SQL}, p AS (SELECT a.vec_id AS src, b.vec_id AS dst, list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS weight FROM embeddings a JOIN embeddings b ON a.vec_id < b.vec_id) SELECT src, dst, 'similar_to' AS relation, round(weight, 6) AS weight FROM p WHERE weight >= 0.3 AND NOT EXISTS (SELECT 1 FROM g WHERE (g.src = p.src AND g.dst = p.dst) OR (g.src = p.dst AND g.dst = p.src))")
def auto_link(spark: SparkSession, d: str) -> DataFrame:
    """New links between similar vectors that are not linked in either direction."""
    pairs = R.pairs_above(table(spark, d, "embeddings"), 0.30, "vec_id", "embedding").select(F.col("id_a").alias("src"), F.col("id_b").alias("dst"), F.col("score").alias("weight"))
    linked = edges(spark, d).select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).distinct()
    return pairs.join(linked, ["src", "dst"], "left_anti").select("src", "dst", F.lit("similar_to").alias("relation"), F.round("weight", 6).alias("weight"))


@query("spreading_activation", f"""WITH {EDGES_SQL}, b AS (SELECT src, dst, relation FROM g UNION ALL SELECT dst, src, relation FROM g), dg AS (SELECT src, count(*) AS d FROM b GROUP BY src),
h AS (SELECT b.src, b.dst, {WEIGHT_SQL} / sqrt(d) AS f FROM b JOIN dg USING (src)),
s1 AS (SELECT s.id AS start, h.dst AS node, 1.0::DOUBLE * f AS boost FROM (SELECT DISTINCT id FROM entries WHERE id % 50 = 0) s JOIN h ON h.src = s.id WHERE 1.0::DOUBLE * f >= 0.1::DOUBLE),
s2 AS (SELECT start, h.dst AS node, boost * 0.5::DOUBLE * f AS boost FROM s1 JOIN h ON h.src = s1.node WHERE boost * 0.5::DOUBLE >= 0.1::DOUBLE AND boost * 0.5::DOUBLE * f >= 0.1::DOUBLE),
s3 AS (SELECT start, h.dst AS node, boost * 0.5::DOUBLE * f AS boost FROM s2 JOIN h ON h.src = s2.node WHERE boost * 0.5::DOUBLE >= 0.1::DOUBLE AND boost * 0.5::DOUBLE * f >= 0.1::DOUBLE)
SELECT start, node, round(sum(boost), 6) AS boost FROM (SELECT * FROM s1 UNION ALL SELECT * FROM s2 UNION ALL SELECT * FROM s3) WHERE start <> node GROUP BY start, node""")
def spreading_activation(spark: SparkSession, d: str) -> DataFrame:
    starts = table(spark, d, "entries").where("id % 50 = 0").select(F.col("id").alias("start")).distinct().withColumn("energy", F.lit(1.0))
    return G.spread(edges(spark, d), starts).withColumn("boost", F.round("boost", 6))


@query("connected_components", f"WITH RECURSIVE {EDGES_SQL}, u AS (SELECT src AS a, dst AS b FROM g WHERE relation IN ('similar_to', 'parent_child') AND src <> dst UNION SELECT dst, src FROM g WHERE relation IN ('similar_to', 'parent_child') AND src <> dst), r(a, b) AS (SELECT a, a FROM u UNION SELECT r.a, u.b FROM r JOIN u ON u.a = r.b) SELECT a AS node, min(b) AS component FROM r GROUP BY a")
def connected_components(spark: SparkSession, d: str) -> DataFrame:
    """Components over similar_to and parent_child edges."""
    rows = edges(spark, d).where(F.col("relation").isin("similar_to", "parent_child"))
    return G.components(rows.select(F.col("src").alias("a"), F.col("dst").alias("b")))


DB_SQL = """p AS (SELECT a.vec_id AS a, b.vec_id AS b FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id AND 1 - list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) <= 0.64),
k AS (SELECT a AS id FROM p GROUP BY a HAVING count(*) >= 3), i AS (SELECT a, b FROM p WHERE a IN (SELECT id FROM k) AND b IN (SELECT id FROM k)),
r(id, c) AS (SELECT id, id FROM k UNION SELECT i.b, r.c FROM r JOIN i ON i.a = r.id), n AS (SELECT id, min(c) AS cluster FROM r GROUP BY id),
bd AS (SELECT p.a AS id, min(n.cluster) AS cluster FROM p JOIN n ON n.id = p.b WHERE p.a NOT IN (SELECT id FROM k) GROUP BY p.a),
db AS (SELECT v.vec_id AS id, coalesce(n.cluster, bd.cluster) AS cluster, n.id IS NOT NULL AS core FROM embeddings v LEFT JOIN n ON n.id = v.vec_id LEFT JOIN bd ON bd.id = v.vec_id)"""


def _clusters(spark: SparkSession, d: str) -> DataFrame:
    vectors = table(spark, d, "embeddings")
    return G.dbscan(R.pairs_above(vectors, 1 - 0.64, "vec_id", "embedding"), vectors.select(F.col("vec_id").alias("id")))


@query("dbscan", f"WITH RECURSIVE {DB_SQL} SELECT id, cluster, core FROM db")
def dbscan(spark: SparkSession, d: str) -> DataFrame:
    """Density clusters; the radius 0.64 suits these vectors."""
    return _clusters(spark, d)


@query("cluster_centroids", f"WITH RECURSIVE {DB_SQL}, x AS (SELECT db.cluster, unnest(v.embedding)::DOUBLE AS x, generate_subscripts(v.embedding, 1) AS i FROM db JOIN embeddings v ON v.vec_id = db.id WHERE cluster IS NOT NULL), m AS (SELECT cluster, i, avg(x) AS x, count(*) AS n FROM x GROUP BY cluster, i) SELECT cluster, any_value(n) AS members, round(sqrt(sum(x * x)), 6) AS length FROM m GROUP BY cluster")
def cluster_centroids(spark: SparkSession, d: str) -> DataFrame:
    """Members of each cluster and the length of its centroid, by sums per component."""
    rows = _clusters(spark, d).where("cluster is not null").join(table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "embedding"), "id")
    parts = rows.select("cluster", F.posexplode("embedding").alias("i", "x")).groupBy("cluster", "i").agg(F.avg(F.col("x").cast("double")).alias("x"), F.count("*").alias("n"))
    return parts.groupBy("cluster").agg(F.max("n").alias("members"), F.round(F.sqrt(F.sum(F.col("x") * F.col("x"))), 6).alias("length"))


@query("topological_levels", f"WITH RECURSIVE {EDGES_SQL}, dp AS (SELECT DISTINCT src AS a, dst AS b FROM g WHERE relation = 'depends_on'), nd AS (SELECT a AS n FROM dp UNION SELECT b FROM dp), rc(a, b) AS (SELECT a, b FROM dp UNION SELECT rc.a, dp.b FROM rc JOIN dp ON dp.a = rc.b), lp AS (SELECT DISTINCT a AS n FROM rc WHERE a = b), bd AS (SELECT n FROM lp UNION SELECT rc.b FROM rc JOIN lp ON lp.n = rc.a), lv(n, l) AS (SELECT n, 0 FROM nd WHERE n NOT IN (SELECT n FROM bd) AND n NOT IN (SELECT b FROM dp) UNION SELECT dp.b, lv.l + 1 FROM lv JOIN dp ON dp.a = lv.n WHERE dp.b NOT IN (SELECT n FROM bd)) SELECT n AS node, max(l)::INTEGER AS level FROM lv GROUP BY n")
def topological_levels(spark: SparkSession, d: str) -> DataFrame:
    """Levels of depends_on edges, loops and what lies behind them left out."""
    rows = edges(spark, d).where("relation = 'depends_on'")
    return G.kahn_levels(rows.select(F.col("src").alias("before"), F.col("dst").alias("after")))


@query("summary_staleness", f"WITH {ENTRIES_SQL}, m AS (SELECT tenant_id, ns, max(created_at) FILTER (is_summary_node) AS summarized, max(created_at) FILTER (NOT is_summary_node) AS newest FROM e GROUP BY tenant_id, ns) SELECT tenant_id, ns, newest > summarized AS stale FROM m WHERE summarized IS NOT NULL AND newest IS NOT NULL")
def summary_staleness(spark: SparkSession, d: str) -> DataFrame:
    """A namespace's summary is stale if an entry is newer."""
    newest = lambda flag: F.max(F.when(F.col("is_summary_node") == flag, F.col("created_at")))
    rows = entries(spark, d).groupBy("tenant_id", "ns").agg(newest(True).alias("s"), newest(False).alias("n"))
    return rows.where("s is not null and n is not null").select("tenant_id", "ns", (F.col("n") > F.col("s")).alias("stale"))


_SNAPSHOT = f"{EDGES_SQL}, {ENTRIES_SQL}, vs AS (SELECT id, ns FROM e WHERE lifecycle_state <> 'archived' AND tenant_id IN ('', 'acorn'))"


@query("graph_snapshot", f"WITH {_SNAPSHOT} SELECT src, dst, relation, round(weight, 6) AS weight, a.ns AS src_ns, b.ns AS dst_ns FROM g JOIN vs a ON a.id = src JOIN vs b ON b.id = dst")
def graph_snapshot(spark: SparkSession, d: str) -> DataFrame:
    """Edges whose both ends one tenant may read, with their namespaces."""
    seen = entries(spark, d).where(F.col("tenant_id").isin("", "acorn") & (F.col("lifecycle_state") != "archived"))
    end = lambda c: seen.select(F.col("id").alias(c), F.col("ns").alias(f"{c}_ns"))
    return edges(spark, d).join(end("src"), "src").join(end("dst"), "dst").select("src", "dst", "relation", F.round("weight", 6).alias("weight"), "src_ns", "dst_ns")


@query("edges_of_entry", f"WITH {EDGES_SQL} SELECT id, other, relation, direction FROM (SELECT src AS id, dst AS other, relation, 'out' AS direction FROM g UNION ALL SELECT dst, src, relation, 'in' FROM g) WHERE id % 50 = 0")
def edges_of_entry(spark: SparkSession, d: str) -> DataFrame:
    """All edges at every 50th entry, in either direction."""
    rows = edges(spark, d)
    side = lambda a, b, name: rows.where(F.col(a) % 50 == 0).select(F.col(a).alias("id"), F.col(b).alias("other"), "relation", F.lit(name).alias("direction"))
    return side("src", "dst", "out").unionByName(side("dst", "src", "in"))


@query("remove_edges", f"WITH {EDGES_SQL} SELECT src, dst, relation FROM g WHERE (src, dst) NOT IN (SELECT (entry_a.id, entry_b.id) FROM duplicate_pairs WHERE entry_a.id IS NOT NULL AND entry_b.id IS NOT NULL) AND relation <> 'similar_to'")
def remove_edges(spark: SparkSession, d: str) -> DataFrame:
    """Edges left after those between reported pairs, and all of one kind, were removed."""
    gone = table(spark, d, "duplicate_pairs").select(F.col("entry_a.id").alias("src"), F.col("entry_b.id").alias("dst"))
    return edges(spark, d).where("relation <> 'similar_to'").join(gone, ["src", "dst"], "left_anti").select("src", "dst", "relation")


_CASES = f"""{EDGES_SQL}, {ENTRIES_SQL}, cs AS (SELECT scan_id, entry_a.id AS cited, entry_b.id AS held, row_number() OVER (PARTITION BY scan_id ORDER BY pair_id) AS n FROM (SELECT DISTINCT scan_id, pair_id, entry_a, entry_b FROM duplicate_pairs)),
ct AS (SELECT scan_id, cited AS id, min(n) AS n FROM cs GROUP BY ALL), hd AS (SELECT DISTINCT scan_id, id FROM (SELECT scan_id, held AS id FROM cs UNION ALL SELECT scan_id, cited FROM cs WHERE n % 2 = 0)),
st AS (SELECT ct.scan_id, ct.id, lead(ct.id) OVER (PARTITION BY scan_id ORDER BY n) AS nxt, e.lifecycle_state AS s, hd.id IS NOT NULL AS backed FROM ct LEFT JOIN e USING (id) LEFT JOIN hd USING (scan_id, id)),
lk AS (SELECT DISTINCT src, dst FROM g), cd AS (SELECT DISTINCT least(src, dst) AS a, greatest(src, dst) AS b FROM g WHERE relation = 'contradicts'), dp AS (SELECT DISTINCT src, dst FROM g WHERE relation = 'depends_on')"""


@query("reasoning_metrics", f"""WITH {_CASES} SELECT st.scan_id, count(*) AS cited, round(count(*) FILTER (backed) / count(*)::DOUBLE, 6) AS backed_share, round(count(*) FILTER (s = 'archived') / count(*)::DOUBLE, 6) AS stale_share,
count(*) FILTER (EXISTS (SELECT 1 FROM lk WHERE lk.src = st.id AND lk.dst = st.nxt)) AS valid_steps, count(*) FILTER (st.id IN (SELECT src FROM dp) AND EXISTS (SELECT 1 FROM dp JOIN ct x ON x.id = dp.dst AND x.scan_id = st.scan_id WHERE dp.src = st.id)) AS supported,
(SELECT count(*) FROM cd JOIN ct x ON x.id = cd.a JOIN ct y ON y.id = cd.b AND y.scan_id = x.scan_id WHERE x.scan_id = st.scan_id) AS contradictions,
round((SELECT count(*) FROM hd WHERE hd.scan_id = st.scan_id AND hd.id NOT IN (SELECT id FROM ct WHERE ct.scan_id = st.scan_id)) / (SELECT count(*) FROM hd WHERE hd.scan_id = st.scan_id)::DOUBLE, 6) AS noise_share FROM st GROUP BY st.scan_id""")
def reasoning_metrics(spark: SparkSession, d: str) -> DataFrame:
    """Of the entries each case cites in order: backed by its context, stale, linked step by step, supported by what they depend on, contradicting each other; and the noise of its context.

    Scans of reported pairs stand for cases: first entries are cited, second ones and every other first one are the context.
    """
    pairs = table(spark, d, "duplicate_pairs").select("scan_id", "pair_id", F.col("entry_a.id").alias("cited"), F.col("entry_b.id").alias("held")).distinct()
    place = pairs.withColumn("n", F.row_number().over(Window.partitionBy("scan_id").orderBy("pair_id")))
    cited = place.groupBy("scan_id", F.col("cited").alias("id")).agg(F.min("n").alias("n"))
    held = place.select("scan_id", F.col("held").alias("id")).unionByName(place.where("n % 2 = 0").select("scan_id", F.col("cited").alias("id"))).distinct()
    return G.reasoning(cited, held, edges(spark, d), entries(spark, d).select("id", "lifecycle_state"), "scan_id")
