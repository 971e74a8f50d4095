"""Vector search, fusion, re-ranking and search pipelines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from heddle.functions import text as T
from heddle.functions import vector as V
from heddle.operators import retrieval as R
from heddle.plans.texts import POSTINGS_SQL, bm25_sql, tokens_sql
from heddle.registry import Registry
from heddle.session import cut, table
from heddle.sources.tables import CORPUS_SQL, corpus

REGISTRY = Registry()
query = REGISTRY.query

#: Queries are all rows whose id is divisible by 50, against all rows.
EVERY = 50

COS = "list_cosine_similarity(q.vector, c.vector)"


def _queries(rows: DataFrame) -> DataFrame:
    return rows.where(F.col("id") % EVERY == 0)


def _vectors(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), "label")


VECTORS_SQL = "v AS (SELECT vec_id AS id, embedding::DOUBLE[] AS vector, label FROM embeddings)"


@query("knn_topk", f"WITH {VECTORS_SQL}, s AS (SELECT q.id AS query_id, c.id, {COS} AS score FROM v q JOIN v c ON q.id <> c.id WHERE q.id % 50 = 0) SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, id)::INTEGER AS rank, id, round(score, 6) AS score FROM s QUALIFY rank <= 10")
def knn_topk(spark: SparkSession, d: str) -> DataFrame:
    """Exact 10 nearest vectors."""
    rows = _vectors(spark, d)
    found = R.knn(_queries(rows).withColumnRenamed("id", "query_id"), rows, 10, exclude_self=True)
    return found.withColumn("score", F.round("score", 6))


def _search_sql(where: str, k: int, order: str = "round(score, 9) DESC, id") -> str:
    return f"WITH {CORPUS_SQL}, s AS (SELECT q.id AS query_id, c.id, c.is_summary_node, {COS} AS score FROM c q JOIN c ON q.id <> c.id AND q.vector IS NOT NULL AND c.vector IS NOT NULL WHERE q.id % 50 = 0 AND {where}) SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY {order})::INTEGER AS rank, id, round(score, 6) AS score FROM s QUALIFY rank <= {k}"


@query("knn_filtered_states", _search_sql("c.lifecycle_state IN ('stm', 'ltm') AND c.category IS NOT DISTINCT FROM q.category AND list_cosine_similarity(q.vector, c.vector) >= 0.05", 10))
def knn_filtered_states(spark: SparkSession, d: str) -> DataFrame:
    """Only short- and long-term entries of the query's category, with a least score."""
    rows = corpus(spark, d).where(F.col("lifecycle_state").isin("stm", "ltm"))
    queries = _queries(corpus(spark, d)).select(F.col("id").alias("query_id"), F.col("category").alias("_c"), "vector")
    found = R.knn(queries, rows, 10, min_score=0.05, exclude_self=True, by="category")
    own = found.join(queries.select("query_id", "_c"), "query_id").where(F.col("_c").eqNullSafe(F.col("category")))
    return own.select("query_id", "rank", "id", F.round("score", 6).alias("score"))


@query("knn_summary_first", _search_sql("c.lifecycle_state IN ('stm', 'ltm')", 10, "is_summary_node DESC, round(score, 9) DESC, id"))
def knn_summary_first(spark: SparkSession, d: str) -> DataFrame:
    """Summaries before other entries: the ten best of each kind, then the ten first."""
    rows = corpus(spark, d).where(F.col("lifecycle_state").isin("stm", "ltm"))
    queries = _queries(corpus(spark, d)).withColumnRenamed("id", "query_id")
    parts = [R.knn(queries, rows.where(F.col("is_summary_node") == flag), 10, exclude_self=True).withColumn("s", F.lit(flag)) for flag in (True, False)]
    order = Window.partitionBy("query_id").orderBy(F.desc("s"), "rank")
    return parts[0].unionByName(parts[1]).withColumn("rank", F.row_number().over(order)).where("rank <= 10").select("query_id", "rank", "id", F.round("score", 6).alias("score"))


QUANT_SQL = f"""{VECTORS_SQL}, b AS (SELECT *, list_min(vector) AS lo, CASE WHEN list_max(vector) > list_min(vector) THEN list_max(vector) - list_min(vector) ELSE 1.0 END AS w FROM v),
z AS (SELECT *, list_transform(vector, lambda x: greatest(-128.0, least(127.0, round_even((x - lo) * 255 / w, 0) - 128))::INTEGER) AS codes FROM b)"""


@query("int8_quantize", f"WITH {QUANT_SQL} SELECT id, codes, round(lo, 6) AS min, round(w / 255, 9) AS scale, list_sum(list_transform(codes, lambda x: x * x))::BIGINT AS self_dot FROM z")
def int8_quantize(spark: SparkSession, d: str) -> DataFrame:
    rows = _vectors(spark, d).select("id", V.quantize(F.col("vector")).alias("z"))
    return rows.select("id", "z.codes", F.round("z.min", 6).alias("min"), F.round("z.scale", 9).alias("scale"), "z.self_dot")


@query("int8_screen", f"""WITH {QUANT_SQL},
s AS (SELECT q.id AS query_id, c.id, list_dot_product(q.codes::DOUBLE[], c.codes::DOUBLE[]) / sqrt(list_sum(list_transform(q.codes, lambda x: x * x))::DOUBLE * list_sum(list_transform(c.codes, lambda x: x * x))::DOUBLE) AS rough, list_cosine_similarity(q.vector, c.vector) AS score FROM z q JOIN z c ON q.id <> c.id WHERE q.id % 50 = 0),
k AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY round(rough, 9) DESC, id) <= 80)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, id)::INTEGER AS rank, id, round(score, 6) AS score FROM k QUALIFY rank <= 10""")
def int8_screen(spark: SparkSession, d: str) -> DataFrame:
    """The 8k best by int8 codes, rescored exactly."""
    rows = _vectors(spark, d).withColumn("codes", V.quantize(F.col("vector")).getField("codes").cast("array<double>"))
    queries = _queries(rows).withColumnRenamed("id", "query_id")
    rough = R.knn(queries, rows, 80, vector="codes", exclude_self=True).select("query_id", "id")
    pairs = rough.join(queries.select("query_id", F.col("vector").alias("_q")), "query_id").join(rows.select("id", "vector"), "id")
    order = Window.partitionBy("query_id").orderBy(F.desc(F.round("score", 9)), "id")
    scored = pairs.select("query_id", "id", V.cosine(F.col("_q"), F.col("vector")).alias("score"))
    return scored.withColumn("rank", F.row_number().over(order)).where("rank <= 10").select("query_id", "rank", "id", F.round("score", 6).alias("score"))


POOL = 40
HYBRID_SQL = f"""{CORPUS_SQL}, {POSTINGS_SQL}, q AS (SELECT id AS query_id, text FROM c WHERE id % 50 = 0 AND text IS NOT NULL), {bm25_sql('q', POOL)},
lx AS (SELECT query_id, rank, doc_id AS id, score FROM bm),
vs AS (SELECT q.id AS query_id, c.id, {COS} AS score FROM c q JOIN c ON c.vector IS NOT NULL WHERE q.id % 50 = 0 AND q.text IS NOT NULL AND q.vector IS NOT NULL),
vx AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, id) AS rank, id, score FROM vs QUALIFY rank <= {POOL})"""


def _vector_list(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Corpus and vector list of every query."""
    rows = corpus(spark, d)
    asked = _queries(rows).where("text is not null")
    return rows, R.knn(asked.select(F.col("id").alias("query_id"), "vector"), rows, POOL)


def _lists(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Corpus, vector list and lexical list of every query; lists are kept, since plans read them several times."""
    rows = corpus(spark, d)
    asked = _queries(rows).where("text is not null")
    vector = cut(R.knn(asked.select(F.col("id").alias("query_id"), "vector"), rows, POOL))
    # Texts alone need no join with the vectors.
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text")
    lexical = R.lexical_search(_queries(docs).where("text is not null").withColumnRenamed("id", "query_id"), "query_id", "text", docs, "id", "text", POOL)
    return rows, vector, cut(lexical)


@query("rrf_hybrid", f"""WITH {HYBRID_SQL}, f AS (SELECT query_id, id, vx.score AS cosine, lx.score AS bm25, coalesce(1.0::DOUBLE / (60 + vx.rank), 0) + coalesce(1.0::DOUBLE / (60 + lx.rank), 0) AS rrf FROM vx FULL JOIN lx USING (query_id, id))
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY round(rrf, 9) DESC, id)::INTEGER AS rank, id, round(rrf, 8) AS rrf, round(cosine, 6) AS cosine, round(bm25, 6) AS bm25 FROM f QUALIFY rank <= 10""")
def rrf_hybrid(spark: SparkSession, d: str) -> DataFrame:
    _, vector, lexical = _lists(spark, d)
    rows = R.rrf(vector, lexical, "query_id", "id", 10)
    return rows.withColumns({"rrf": F.round("rrf", 8), "cosine": F.round("cosine", 6), "bm25": F.round("bm25", 6)})


@query("hybrid_adaptive_k", f"""WITH {HYBRID_SQL}, k AS (SELECT query_id, CASE WHEN max(score) >= 0.80 THEN 120 WHEN max(score) < 0.50 THEN 30 ELSE 60 END AS c FROM vx GROUP BY query_id),
f AS (SELECT query_id, id, coalesce(1.0::DOUBLE / (coalesce(c, 60) + vx.rank), 0) + coalesce(1.0::DOUBLE / (coalesce(c, 60) + lx.rank), 0) AS rrf FROM vx FULL JOIN lx USING (query_id, id) LEFT JOIN (SELECT query_id, c FROM k) USING (query_id))
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY round(rrf, 9) DESC, id)::INTEGER AS rank, id, round(rrf, 8) AS rrf FROM f QUALIFY rank <= 10""")
def hybrid_adaptive_k(spark: SparkSession, d: str) -> DataFrame:
    """The constant follows the query's best cosine."""
    _, vector, lexical = _lists(spark, d)
    return R.rrf(vector, lexical, "query_id", "id", 10, R.adaptive_constant()).select("query_id", "rank", "id", F.round("rrf", 8).alias("rrf"))


@query("hybrid_early_exit", f"WITH {HYBRID_SQL} SELECT query_id, count(*) AS hits, max(score) >= 0.85 AND count(*) >= 10 AS vector_only FROM vx GROUP BY query_id")
def hybrid_early_exit(spark: SparkSession, d: str) -> DataFrame:
    """Queries whose vector hits are so sure that the lexical side is skipped."""
    _, vector = _vector_list(spark, d)
    return vector.groupBy("query_id").agg(F.count("*").alias("hits"), ((F.max("score") >= 0.85) & (F.count("*") >= 10)).alias("vector_only"))


@query("hybrid_cascade", f"""WITH {HYBRID_SQL}, m AS (SELECT *, max(score) OVER (PARTITION BY query_id) AS mx FROM lx),
l AS (SELECT vx.query_id, vx.id, vx.score * (1 + 0.15::DOUBLE * coalesce(m.score / m.mx, 0)) AS score, false AS injected FROM vx LEFT JOIN m USING (query_id, id)),
o AS (SELECT m.query_id, m.id, m.rank, vs.score FROM m JOIN vs USING (query_id, id) ANTI JOIN vx USING (query_id, id) WHERE vs.score >= 0.1),
j AS (SELECT query_id, id, score, true AS injected FROM o QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY rank) <= 3)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, id)::INTEGER AS rank, id, round(score, 6) AS score, injected FROM (SELECT * FROM l UNION ALL SELECT * FROM j) QUALIFY rank <= 45""")
def hybrid_cascade(spark: SparkSession, d: str) -> DataFrame:
    """Lift and gated injection; the gate is 0.10 here, since these vectors and texts are unrelated."""
    rows, vector, lexical = _lists(spark, d)
    asked = _queries(rows).select(F.col("id").alias("query_id"), F.col("vector").alias("_q"))
    cosines = lexical.join(asked, "query_id").join(rows.select("id", "vector"), "id").select("query_id", "id", V.cosine(F.col("_q"), F.col("vector")).alias("cosine"))
    return R.cascade(vector, lexical, cosines, "query_id", "id", 45, gate=0.10).withColumn("score", F.round("score", 6))


@query("semantic_gate", f"WITH {HYBRID_SQL}, tp AS (SELECT query_id, max(score) AS top FROM vx GROUP BY query_id) SELECT lx.query_id, lx.id, round(vs.score, 6) AS cosine FROM lx JOIN vs USING (query_id, id) JOIN tp USING (query_id) ANTI JOIN vx USING (query_id, id) WHERE tp.top < 0.30 OR vs.score >= 0.10")
def semantic_gate(spark: SparkSession, d: str) -> DataFrame:
    """Lexical-only hits that are close enough, where the vector side is sure of itself."""
    rows, vector, lexical = _lists(spark, d)
    top = vector.groupBy("query_id").agg(F.max("score").alias("top"))
    asked = _queries(rows).select(F.col("id").alias("query_id"), F.col("vector").alias("_q"))
    only = lexical.join(vector.select("query_id", "id"), ["query_id", "id"], "left_anti").join(top, "query_id").join(asked, "query_id").join(rows.select("id", "vector"), "id")
    only = only.select("query_id", "id", "top", V.cosine(F.col("_q"), F.col("vector")).alias("cosine"))
    return only.where((F.col("top") < 0.30) | (F.col("cosine") >= 0.10)).select("query_id", "id", F.round("cosine", 6).alias("cosine"))


@query("token_rerank", f"""WITH {HYBRID_SQL}, r AS (SELECT vx.query_id, vx.id, vx.score, {tokens_sql('q.text')} AS qt0, {tokens_sql('c.text')} AS dt FROM vx JOIN q USING (query_id) JOIN c ON c.id = vx.id),
g AS (SELECT *, list_distinct([qt0[i] || ' ' || qt0[i + 1] FOR i IN range(1, greatest(len(qt0), 1))]) AS qg, list_distinct([dt[i] || ' ' || dt[i + 1] FOR i IN range(1, greatest(len(dt), 1))]) AS dg FROM r),
h AS (SELECT query_id, id, score, CASE WHEN len(qt0) = 0 OR len(dt) = 0 THEN 0.0::DOUBLE ELSE 0.40::DOUBLE * len(list_intersect(list_distinct(qt0), list_distinct(dt))) / len(list_distinct(qt0)) + CASE WHEN len(qg) > 0 THEN 0.25::DOUBLE * len(list_intersect(qg, dg)) / len(qg) ELSE 0 END
 + 0.20::DOUBLE * len(list_intersect(list_distinct(qt0), list_distinct(dt))) / len(qt0) + 0.15::DOUBLE * len(list_filter(dt[1:greatest(len(dt) // 5, 5)], lambda t: list_contains(qt0, t))) / len(qt0) END AS overlap FROM g)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY round(0.6 * score + 0.4 * overlap, 9) DESC, id)::INTEGER AS rank, id, round(0.6 * score + 0.4 * overlap, 6) AS score FROM h QUALIFY rank <= 10""")
def token_rerank(spark: SparkSession, d: str) -> DataFrame:
    """0.6 of the cosine and 0.4 of the token overlap; tokens are made once for each text."""
    rows, vector = _vector_list(spark, d)
    vector = cut(vector)
    # Only texts of some pair are tokenised.
    needed = vector.select(F.explode(F.array("query_id", "id")).alias("id")).distinct()
    tokens = cut(rows.select("id", "text").join(needed, "id", "left_semi").select("id", T.lexical_tokens(F.col("text")).alias("t")))
    pairs = vector.join(tokens.select(F.col("id").alias("query_id"), F.col("t").alias("q")), "query_id").join(tokens, "id")
    scored = pairs.select("query_id", "id", (0.6 * F.col("score") + 0.4 * R.rerank_score(F.col("q"), F.col("t"))).alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc(F.round("score", 9)), "id")
    return scored.withColumn("rank", F.row_number().over(order)).where("rank <= 10").select("query_id", "rank", "id", F.round("score", 6).alias("score"))


@query("category_boost", f"WITH {HYBRID_SQL} SELECT vx.query_id, vx.id, round(vx.score * CASE WHEN list_has_any({tokens_sql('c.category')}, {tokens_sql('q.text')}) THEN 1.15::DOUBLE ELSE 1.0::DOUBLE END, 6) AS score FROM vx JOIN q USING (query_id) JOIN c ON c.id = vx.id")
def category_boost(spark: SparkSession, d: str) -> DataFrame:
    """Hits whose category is named in the query score 15 % more."""
    rows, vector = _vector_list(spark, d)
    asked = rows.select(F.col("id").alias("query_id"), T.lexical_tokens(F.col("text")).alias("q"))
    pairs = vector.join(asked, "query_id").join(rows.select("id", T.lexical_tokens(F.col("category")).alias("c")), "id")
    boost = F.when(F.arrays_overlap("c", "q"), 1.15).otherwise(1.0)
    return pairs.select("query_id", "id", F.round(F.col("score") * boost, 6).alias("score"))


@query("cross_namespace_rrf", f"""WITH {CORPUS_SQL}, s AS (SELECT q.id AS query_id, c.ns, c.id, {COS} AS score FROM c q JOIN c ON q.id <> c.id AND q.vector IS NOT NULL AND c.vector IS NOT NULL WHERE q.id % 50 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id, ns ORDER BY round(score, 9) DESC, id)::INTEGER AS ns_rank FROM s QUALIFY ns_rank <= 5)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY ns_rank, ns)::INTEGER AS rank, ns, id, round(score, 6) AS score FROM r QUALIFY rank <= 20""")
def cross_namespace_rrf(spark: SparkSession, d: str) -> DataFrame:
    """Each namespace is searched on its own; hits merge by 1 / (60 + rank inside it)."""
    rows = corpus(spark, d)
    ranked = R.knn(_queries(rows).select(F.col("id").alias("query_id"), "vector"), rows, 5, exclude_self=True, by="ns").withColumnRenamed("rank", "ns_rank")
    order = Window.partitionBy("query_id").orderBy(F.desc(1 / (60 + F.col("ns_rank"))), "ns")
    return ranked.withColumn("rank", F.row_number().over(order)).where("rank <= 20").select("query_id", "rank", "ns", "id", F.round("score", 6).alias("score"))


@query("mmr_diversity")
def mmr_diversity(spark: SparkSession, d: str) -> DataFrame:
    """Ten diverse hits of pools of thirty."""
    rows, vector = _vector_list(spark, d)
    pool = vector.where("rank <= 30").select("query_id", "id", "score").join(rows.select("id", "vector", "category"), "id")
    return R.mmr(pool, "query_id", "id", "vector", "score", 10, category="category").withColumn("score", F.round("score", 6))


PHYSICS = "ln(1 + c.access_count) * CASE c.lifecycle_state WHEN 'ltm' THEN 2.0::DOUBLE WHEN 'archived' THEN 0.5::DOUBLE ELSE 1.0::DOUBLE END / power(greatest(1 - vx.score, 0.001::DOUBLE), 2)"


@query("physics_rank", f"""WITH {HYBRID_SQL}, p AS (SELECT vx.query_id, vx.id, vx.score, {PHYSICS} AS g FROM vx JOIN c ON c.id = vx.id WHERE vx.id <> vx.query_id),
b AS (SELECT *, 0.5::DOUBLE * score + 0.5::DOUBLE * g / max(g) OVER (PARTITION BY query_id) AS blended FROM p)
SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY round(blended, 9) DESC, id)::INTEGER AS rank, round(g, 4) AS gravity, round(blended, 6) AS blended, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, id) = 1 AS asteroid, row_number() OVER (PARTITION BY query_id ORDER BY round(g, 9) DESC, id) = 1 AS sun FROM b""")
def physics_rank(spark: SparkSession, d: str) -> DataFrame:
    """Cosine blended half and half with gravity; the nearest and the heaviest hit are marked."""
    rows, vector = _vector_list(spark, d)
    hits = vector.where("id <> query_id").join(rows.select("id", "access_count", "lifecycle_state"), "id")
    hits = hits.withColumn("g", R.gravity(F.col("score"), F.col("access_count"), F.col("lifecycle_state")))
    of = Window.partitionBy("query_id")
    hits = hits.withColumn("blended", 0.5 * F.col("score") + 0.5 * F.col("g") / F.max("g").over(of))
    place = lambda c: F.row_number().over(of.orderBy(F.desc(F.round(c, 9)), "id"))
    return hits.select("query_id", "id", place("blended").alias("rank"), F.round("g", 4).alias("gravity"), F.round("blended", 6).alias("blended"), (place("score") == 1).alias("asteroid"), (place("g") == 1).alias("sun"))


@query("deep_recall", f"WITH {CORPUS_SQL}, s AS (SELECT q.id AS query_id, c.id, c.lifecycle_state AS state, {COS} AS score FROM c q JOIN c ON q.id <> c.id AND q.vector IS NOT NULL AND c.vector IS NOT NULL WHERE q.id % 50 = 0) SELECT query_id, id, round(score, 6) AS score, CASE WHEN state = 'archived' AND score >= 0.25 THEN 'stm' ELSE state END AS new_state, state = 'archived' AND score >= 0.25 AS resurrected FROM s QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, id) <= 10")
def deep_recall(spark: SparkSession, d: str) -> DataFrame:
    """All states are searched; archived hits above a threshold (0.25 on these vectors) come back to life."""
    rows = corpus(spark, d)
    hits = R.knn(_queries(rows).select(F.col("id").alias("query_id"), "vector"), rows, 10, exclude_self=True).join(rows.select("id", "lifecycle_state"), "id")
    revived = (F.col("lifecycle_state") == "archived") & (F.col("score") >= 0.25)
    return hits.select("query_id", "id", F.round("score", 6).alias("score"), F.when(revived, "stm").otherwise(F.col("lifecycle_state")).alias("new_state"), revived.alias("resurrected"))


@query("near_duplicates", f"WITH {VECTORS_SQL} SELECT a.id AS id_a, b.id AS id_b, round(list_cosine_similarity(a.vector, b.vector), 6) AS score FROM v a JOIN v b ON a.id < b.id WHERE list_cosine_similarity(a.vector, b.vector) >= 0.35")
def near_duplicates(spark: SparkSession, d: str) -> DataFrame:
    """All pairs of vectors above a cosine, exact; only such pairs leave a task."""
    return R.pairs_above(_vectors(spark, d), 0.35).withColumn("score", F.round("score", 6))


@query("duplicates_for_entry", f"WITH {VECTORS_SQL} SELECT q.id AS entry_id, c.id, round({COS}, 6) AS score FROM v q JOIN v c ON q.id <> c.id WHERE q.id % 50 = 0 AND {COS} >= 0.30")
def duplicates_for_entry(spark: SparkSession, d: str) -> DataFrame:
    rows = _vectors(spark, d)
    found = R.knn(_queries(rows).withColumnRenamed("id", "query_id"), rows, 1 << 30, min_score=0.30, exclude_self=True)
    return found.select(F.col("query_id").alias("entry_id"), "id", F.round("score", 6).alias("score"))


@query("exact_text_duplicates", "SELECT min(doc_id) AS first_id, count(*) AS copies, sha256(text) AS digest FROM documents WHERE text IS NOT NULL GROUP BY text HAVING count(*) > 1")
def exact_text_duplicates(spark: SparkSession, d: str) -> DataFrame:
    """Grouped by hash, so that texts themselves never travel."""
    rows = table(spark, d, "documents").where("text is not null").select("doc_id", F.sha2("text", 256).alias("digest"))
    return rows.groupBy("digest").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("copies")).where("copies > 1")
