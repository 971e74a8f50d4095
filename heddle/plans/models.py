"""Queries over models that a caller brings, and spectral re-ranking."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from heddle.operators import plug
from heddle.operators import spectral as S
from heddle.plans.ranking import HYBRID_SQL, _vector_list
from heddle.plans.recalls import ranked
from heddle.registry import Registry
from heddle.session import cut
from heddle.sources.tables import EDGES_SQL, ENTRIES_SQL, edges, entries

REGISTRY = Registry()
query = REGISTRY.query

_LETTERS = "etaoinsh"


def letter_embedder() -> plug.Embedder:
    """A stand-in for a model: how often eight letters occur."""
    return lambda texts: [[float(t.lower().count(c)) for c in _LETTERS] for t in texts]


def length_scorer() -> plug.Reranker:
    """A stand-in for a model: shared words of query and text."""
    return lambda queries, texts: [float(len(set(q.lower().split(" ")) & set(t.lower().split(" ")))) for q, t in zip(queries, texts, strict=True)]


@query("embed_with_model", f"WITH {ENTRIES_SQL} SELECT id, list_transform([{', '.join(repr(c) for c in _LETTERS)}], lambda c: (length(lower(text)) - length(replace(lower(text), c, '')))::DOUBLE) AS vector FROM e WHERE text IS NOT NULL")
def embed_with_model(spark: SparkSession, d: str) -> DataFrame:
    return plug.embed(entries(spark, d).select("id", "text").where("text is not null"), "text", letter_embedder).select("id", "vector")


@query("rerank_with_model", f"WITH {HYBRID_SQL} SELECT vx.query_id, vx.id, len(list_intersect(list_distinct(string_split(lower(q.text), ' ')), list_distinct(string_split(lower(c.text), ' '))))::DOUBLE AS score FROM vx JOIN q USING (query_id) JOIN c ON c.id = vx.id WHERE vx.rank <= 10 AND c.text IS NOT NULL")
def rerank_with_model(spark: SparkSession, d: str) -> DataFrame:
    rows, vector = _vector_list(spark, d)
    texts = rows.where("text is not null").select("id", "text")
    pairs = vector.where("rank <= 10").select("query_id", "id").join(texts, "id").join(texts.select(F.col("id").alias("query_id"), F.col("text").alias("query")), "query_id")
    return plug.rerank(pairs, "query", "text", length_scorer).select("query_id", "id", "score")


def _steps_sql(t: float, steps: int) -> str:
    out = ["x0 AS (SELECT query_id, id, score AS value FROM pl)"]
    for i in range(steps):
        out.append(f"x{i + 1} AS (SELECT x.query_id, x.id, CASE WHEN l.id IS NOT NULL THEN x.value + {t / steps}::DOUBLE * (coalesce(f.s, 0) - x.value) ELSE x.value END AS value FROM x{i} x LEFT JOIN (SELECT DISTINCT query_id, a AS id FROM bo) l USING (query_id, id) LEFT JOIN (SELECT bo.query_id, bo.a AS id, sum(bo.value * y.value) AS s FROM bo JOIN x{i} y ON y.query_id = bo.query_id AND y.id = bo.b GROUP BY ALL) f USING (query_id, id))")
    return ", ".join(out)


@query("spectral_rerank", f"""WITH {HYBRID_SQL}, {EDGES_SQL}, pl AS (SELECT query_id, id, score FROM vx),
w AS (SELECT x.query_id, least(src, dst) AS a, greatest(src, dst) AS b, max(g.weight) AS w FROM g JOIN pl x ON x.id = src JOIN pl y ON y.query_id = x.query_id AND y.id = dst WHERE relation <> 'contradicts' AND g.weight > 0 AND src <> dst GROUP BY ALL),
dg AS (SELECT query_id, n, sum(w) AS d FROM (SELECT query_id, a AS n, w FROM w UNION ALL SELECT query_id, b, w FROM w) GROUP BY ALL),
nv AS (SELECT w.query_id, a, b, w / sqrt(x.d * y.d) AS value FROM w JOIN dg x ON x.query_id = w.query_id AND x.n = a JOIN dg y ON y.query_id = w.query_id AND y.n = b), bo AS (SELECT query_id, a, b, value FROM nv UNION ALL SELECT query_id, b, a, value FROM nv),
{_steps_sql(1.0, 2)} SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY round(value, 9) DESC, id)::INTEGER AS rank, round(value, 6) AS score FROM x2 QUALIFY rank <= 10""")
def spectral_rerank(spark: SparkSession, d: str) -> DataFrame:
    """Scores of a query's pool smoothed along the links inside it (the low pass); links of hits lift each other."""
    _, vector = _vector_list(spark, d)
    pool = cut(vector.select("query_id", "id", "score"))
    end = lambda c: pool.select("query_id", F.col("id").alias(c))
    inside = edges(spark, d).join(end("src"), "src").join(end("dst"), ["query_id", "dst"])
    values = S.normalized(S.adjacency(inside, "query_id"), "query_id")
    out = S.heat_steps(pool.withColumnRenamed("score", "value"), values, "query_id", 1.0, 2)
    return ranked(out, "value", 10).select("query_id", "id", "rank", F.round("value", 6).alias("score"))
