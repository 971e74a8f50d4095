"""Tokens, postings, lexical ranking, enrichment and text features."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from heddle.functions import text as T
from heddle.functions.synonyms import COLLOQUIAL, SYNONYMS
from heddle.operators import retrieval
from heddle.registry import Registry
from heddle.session import table

REGISTRY = Registry()
query = REGISTRY.query

_STOP = ", ".join(f"'{w}'" for w in T.STOP_WORDS)


def tokens_sql(column: str) -> str:
    """SQL of ``lexical_tokens``."""
    parts = "list_filter(string_split(r, '-'), lambda p: p <> '')"
    return (
        f"list_filter(flatten(list_transform(regexp_extract_all(lower(coalesce({column}, '')), '[\\p{{L}}\\p{{Nd}}-]+'), lambda r: CASE WHEN contains(r, '-') THEN list_concat({parts}, [array_to_string({parts}, '')]) ELSE [r] END)),"
        f" lambda t: length(t) >= 2 AND NOT list_contains([{_STOP}], t))"
    )


def loose_sql(column: str) -> str:
    """SQL of ``loose_tokens``."""
    return f"list_filter(list_transform(regexp_extract_all(lower(coalesce({column}, '')), '[\\p{{L}}\\p{{Nd}}_-]+'), lambda r: trim(r, '-_')), lambda t: length(t) >= 2)"


def table_sql(text: str) -> str:
    """VALUES of a word table: term, pos, other."""
    rows = [f"('{line.split(':')[0].strip()}', {i}, '{w}')" for line in text.strip().splitlines() for i, w in enumerate(line.split(":")[1].split())]
    return f"(VALUES {', '.join(rows)}) m(term, pos, other)"


POSTINGS_SQL = f"""t AS (SELECT doc_id, {tokens_sql('text')} AS tk FROM documents),
post AS (SELECT doc_id, term, count(*) AS tf, any_value(dl) AS dl FROM (SELECT doc_id, len(tk) AS dl, unnest(tk) AS term FROM t) GROUP BY doc_id, term)"""


def bm25_sql(queries: str, k: int, name: str = "bm") -> str:
    """CTEs of a BM25 ranking of ``queries`` (query_id, text) over ``post``."""
    return f"""st AS (SELECT count(*) AS n, avg(dl) AS avg_dl FROM (SELECT doc_id, any_value(dl) AS dl FROM post GROUP BY doc_id)),
dfs AS (SELECT term, count(*) AS df FROM post GROUP BY term),
qt AS (SELECT query_id, unnest(list_distinct({tokens_sql('text')})) AS term FROM {queries}),
sc AS (SELECT query_id, doc_id, sum(ln((n - df + 0.5) / (df + 0.5) + 1) * tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / avg_dl))) AS score FROM qt JOIN dfs USING (term) JOIN post USING (term), st GROUP BY query_id, doc_id),
{name} AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id) AS rank, doc_id, score FROM sc QUALIFY rank <= {k})"""


def _postings(spark: SparkSession, d: str) -> DataFrame:
    return retrieval.postings(table(spark, d, "documents"), "doc_id", "text")


def _items(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "eval_items").select(F.col("item_id").alias("query_id"), "text")


ITEMS_SQL = "q AS (SELECT item_id AS query_id, text FROM eval_items)"


@query("tokenize_terms", f"SELECT doc_id, len({tokens_sql('text')})::INTEGER AS terms, len(list_distinct({tokens_sql('text')}))::INTEGER AS distinct_terms FROM documents")
def tokenize_terms(spark: SparkSession, d: str) -> DataFrame:
    tokens = T.lexical_tokens(F.col("text"))
    return table(spark, d, "documents").select("doc_id", F.size(tokens).alias("terms"), F.size(F.array_distinct(tokens)).alias("distinct_terms"))


@query("bm25_postings", f"WITH {POSTINGS_SQL} SELECT term, count(*) AS df, sum(tf)::BIGINT AS cf, max(tf) AS top_tf FROM post GROUP BY term")
def bm25_postings(spark: SparkSession, d: str) -> DataFrame:
    return _postings(spark, d).groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf"), F.max("tf").alias("top_tf"))


@query("bm25_topk", f"WITH {POSTINGS_SQL}, {ITEMS_SQL}, {bm25_sql('q', 20)} SELECT query_id, rank::INTEGER AS rank, doc_id, round(score, 6) AS score FROM bm")
def bm25_topk(spark: SparkSession, d: str) -> DataFrame:
    """Top 20 documents for every held-out item."""
    rows = retrieval.lexical_search(_items(spark, d), "query_id", "text", table(spark, d, "documents"), "doc_id", "text", 20)
    return rows.withColumn("score", F.round("score", 6))


@query("bm25_stemmed")
def bm25_stemmed(spark: SparkSession, d: str) -> DataFrame:
    """The same with stems; each distinct term is stemmed once."""
    index = T.stemmed(_postings(spark, d), "term").groupBy("doc_id", "term").agg(F.sum("tf").alias("tf"), F.first("dl").alias("dl"))
    terms = _items(spark, d).select("query_id", F.explode(T.lexical_tokens(F.col("text"))).alias("term"))
    asked = T.stemmed(terms, "term").groupBy("query_id").agg(F.array_join(F.array_sort(F.collect_set("term")), " ").alias("text"))
    rows = retrieval.bm25(asked, "query_id", "text", index, "doc_id", 20, terms=lambda c: F.split(c, " "))
    return rows.withColumn("score", F.round("score", 6))


@query("prf_terms", f"""WITH {POSTINGS_SQL}, {ITEMS_SQL}, {bm25_sql('q', 5)},
x AS (SELECT bm.query_id, bm.rank, unnest(t.tk) AS term FROM bm JOIN t USING (doc_id)),
y AS (SELECT query_id, term, count(DISTINCT rank) AS df, count(*) AS tf FROM x WHERE (query_id, term) NOT IN (SELECT (query_id, term) FROM qt) GROUP BY 1, 2 HAVING count(DISTINCT rank) >= 2)
SELECT query_id, term, df, tf, df * 10 + tf AS score, row_number() OVER (PARTITION BY query_id ORDER BY df * 10 + tf DESC, term)::INTEGER AS rank FROM y QUALIFY rank <= 5""")
def prf_terms(spark: SparkSession, d: str) -> DataFrame:
    """Feedback terms of every held-out item from its five best documents."""
    items = _items(spark, d)
    best = retrieval.lexical_search(items, "query_id", "text", table(spark, d, "documents"), "doc_id", "text", 5)
    docs = table(spark, d, "documents").select("doc_id", F.col("text").alias("doc_text"))
    ranked = best.join(docs, "doc_id").join(items, "query_id")
    return T.expansion_terms(ranked, "query_id", "doc_text", "text")


@query("synonym_expand")
def synonym_expand(spark: SparkSession, d: str) -> DataFrame:
    """Synonyms added to the text of every entry that has any."""
    rows = T.expand_queries(table(spark, d, "entries").dropDuplicates(["id"]), "id", "text").where(F.size("expansions") > 0)
    return rows.select("id", F.array_join("expansions", " ").alias("expansion"))


@query("synonym_candidates", f"""WITH t AS (SELECT id, list_distinct({loose_sql('any_value(text)')}) AS tk FROM entries GROUP BY id),
x AS (SELECT id, tk, unnest(tk) AS term FROM t) SELECT x.id, x.term, m.other AS synonym FROM x JOIN {table_sql(SYNONYMS)} ON m.term = x.term WHERE NOT list_contains(tk, m.other)""")
def synonym_candidates(spark: SparkSession, d: str) -> DataFrame:
    """All synonyms of an entry's tokens that the entry does not hold yet."""
    tokens = table(spark, d, "entries").groupBy("id").agg(F.any_value("text").alias("text")).select("id", F.array_distinct(T.loose_tokens(F.col("text"))).alias("tk"))
    rows = tokens.select("id", "tk", F.explode("tk").alias("term")).join(F.broadcast(T.mapping(spark, SYNONYMS)), "term")
    return rows.where(~F.array_contains("tk", F.col("other"))).select("id", "term", F.col("other").alias("synonym"))


@query("doc_enrich", f"""WITH t AS (SELECT id, list_distinct({loose_sql('any_value(text)')}) AS tk FROM entries GROUP BY id),
x AS (SELECT id, tk, unnest(tk) AS term FROM t), y AS (SELECT x.id, list_sort(list_distinct(list(m.other))) AS k FROM x JOIN {table_sql(COLLOQUIAL)} ON m.term = x.term WHERE NOT list_contains(tk, m.other) GROUP BY x.id)
SELECT id, array_to_string(k[1:20], ' ') AS keywords FROM y""")
def doc_enrich(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "entries").groupBy("id").agg(F.any_value("text").alias("text"))
    return T.enrich(rows, "id", "text").select("id", F.array_join("keywords", " ").alias("keywords"))


@query("token_estimates", "SELECT doc_id, floor((length(text) + 3) / 4)::INTEGER AS quarter, (list_sum(list_transform(list_concat([''], regexp_extract_all(text, '[\\p{L}\\p{Nd}]+')), lambda r: ceil(strlen(r) / 4))) + length(regexp_replace(text, '[\\p{L}\\p{Nd}\\t\\n\\v\\f\\r ]', '', 'g')))::INTEGER AS fine FROM documents WHERE text IS NOT NULL")
def token_estimates(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").where("text is not null")
    return docs.select("doc_id", T.token_estimate(F.col("text")).alias("quarter"), T.token_estimate_fine(F.col("text")).alias("fine"))


@query("contextual_prefix", "SELECT doc_id, md5('[' || CASE WHEN trim(doc_kind) <> '' THEN doc_kind ELSE ns END || '] ' || text) AS digest FROM documents")
def contextual_prefix(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.md5(T.contextual(F.col("doc_kind"), F.col("ns"), F.col("text")).cast("binary")).alias("digest"))


@query("text_truncation", "SELECT doc_id, CASE WHEN length(text) <= 120 THEN text WHEN contains(substr(text, 1, 117), ' ') THEN substr(text, 1, 117 - strpos(reverse(substr(text, 1, 117)), ' ')::INTEGER) || '...' ELSE substr(text, 1, 117) || '...' END AS short FROM documents")
def text_truncation(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", T.truncated(F.col("text")).alias("short"))


@query("spectral_mode", "SELECT DISTINCT result_id, CASE WHEN regexp_matches(probe, '[0-9]') OR regexp_matches(probe, '\"[^\"]+\"') OR len(string_split_regex(trim(probe), '\\s+')) >= 5 THEN 'specific' ELSE 'broad' END AS mode FROM task_results WHERE probe IS NOT NULL")
def spectral_mode(spark: SparkSession, d: str) -> DataFrame:
    """Filter direction by query: a digit, a quoted phrase or five words make it specific."""
    probe = F.col("probe")
    specific = probe.rlike("[0-9]") | probe.rlike('"[^"]+"') | (F.size(F.split(F.trim(probe), r"\s+")) >= 5)
    return table(spark, d, "task_results").where("probe is not null").select("result_id", F.when(specific, "specific").otherwise("broad").alias("mode")).distinct()


@query("metadata_flatten", "SELECT DISTINCT id, unnest(map_keys(metadata)) AS key, unnest(map_values(metadata)) AS value FROM entries WHERE metadata IS NOT NULL")
def metadata_flatten(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "entries").select("id", F.explode("metadata")).distinct()


@query("member_fingerprint", "WITH m AS (SELECT DISTINCT run_id, task_id FROM task_results) SELECT run_id, count(*) AS members, substr(sha256(string_agg(task_id, chr(10) ORDER BY task_id)), 1, 32) AS fingerprint FROM m GROUP BY run_id")
def member_fingerprint(spark: SparkSession, d: str) -> DataFrame:
    """Order-free fingerprint of a member set."""
    rows = table(spark, d, "task_results").groupBy("run_id").agg(F.array_sort(F.collect_set("task_id")).alias("m"))
    return rows.select("run_id", F.size("m").cast("long").alias("members"), F.substring(F.sha2(F.array_join("m", "\n"), 256), 1, 32).alias("fingerprint"))
