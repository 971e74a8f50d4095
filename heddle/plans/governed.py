"""Sharing, rules, publishing, provenance and plans under rights."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from heddle.operators import governance as G
from heddle.operators import retrieval as R
from heddle.plans.governing import EXPERTS_SQL, HASH_SQL, OWN_SQL, _rights, _routes
from heddle.plans.ranking import COS, _queries
from heddle.plans.training import hash_key
from heddle.registry import Registry
from heddle.session import table
from heddle.sources.tables import CORPUS_SQL, EDGES_SQL, ENTRIES_SQL, corpus, edges, entries

REGISTRY = Registry()
query = REGISTRY.query

_SHARES_SQL = "sh AS (SELECT entry_a.ns AS ns, entry_b.ns AS agent, similarity IS NOT NULL AS granted, scanned_at, pair_id FROM duplicate_pairs WHERE entry_a.ns IS NOT NULL AND entry_b.ns IS NOT NULL)"


@query("share_unshare", f"WITH {_SHARES_SQL}, l AS (SELECT * FROM sh QUALIFY row_number() OVER (PARTITION BY ns, agent ORDER BY scanned_at DESC NULLS LAST, pair_id DESC) = 1) SELECT ns, agent, scanned_at AS since FROM l WHERE granted")
def share_unshare(spark: SparkSession, d: str) -> DataFrame:
    """Grants in force after a log of shares and withdrawals: the last word on a namespace and agent holds."""
    log = table(spark, d, "duplicate_pairs").select(F.col("entry_a.ns").alias("ns"), F.col("entry_b.ns").alias("agent"), F.col("similarity").isNotNull().alias("granted"), "scanned_at", "pair_id")
    last = log.where("ns is not null and agent is not null").groupBy("ns", "agent").agg(F.max(F.struct("scanned_at", "pair_id", "granted")).alias("l"))
    return last.where("l.granted").select("ns", "agent", F.col("l.scanned_at").alias("since"))


@query("expert_tree", f"WITH {EDGES_SQL}, pc AS (SELECT src, dst FROM g WHERE relation = 'parent_child' AND src <> dst), k AS (SELECT src AS node, count(*) AS children, string_agg(dst::VARCHAR, ',' ORDER BY dst) AS listed FROM pc GROUP BY src) SELECT node, children, sha256(listed) AS digest, node NOT IN (SELECT dst FROM pc) AS is_root FROM k")
def expert_tree(spark: SparkSession, d: str) -> DataFrame:
    """Nodes of the domain tree with their ordered child lists; links of a node to itself are refused."""
    links = edges(spark, d).where("relation = 'parent_child' and src <> dst").select("src", "dst")
    lists = links.groupBy(F.col("src").alias("node")).agg(F.count("*").alias("children"), F.sha2(F.array_join(F.array_sort(F.collect_list("dst")).cast("array<string>"), ","), 256).alias("digest"))
    below = links.select(F.col("dst").alias("node"), F.lit(False).alias("_top")).distinct()
    return lists.join(below, "node", "left").select("node", "children", "digest", F.coalesce("_top", F.lit(True)).alias("is_root"))


@query("expert_route_tree", f"WITH {EXPERTS_SQL}, tr AS (SELECT expert, (expert - 1) // 2 AS parent, CASE WHEN expert = 0 THEN 0 WHEN expert <= 2 THEN 1 ELSE 2 END AS level FROM ex), rt AS (SELECT query_id, ro.expert, score FROM ro JOIN tr USING (expert) WHERE level = 1 AND score >= 0.05 QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, ro.expert) <= 2), lf AS (SELECT ro.query_id, ro.expert, ro.score FROM ro JOIN tr USING (expert) JOIN rt ON rt.query_id = ro.query_id AND rt.expert = tr.parent WHERE tr.level = 2 AND ro.score >= 0.05 QUALIFY row_number() OVER (PARTITION BY ro.query_id ORDER BY ro.score DESC, ro.expert) <= 3), fb AS (SELECT query_id, expert, score FROM ro WHERE query_id NOT IN (SELECT query_id FROM lf) QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, expert) <= 3) SELECT query_id, expert, round(score, 6) AS score, 'tree' AS via FROM lf UNION ALL SELECT query_id, expert, round(score, 6), 'flat' FROM fb")
def expert_route_tree(spark: SparkSession, d: str) -> DataFrame:
    """Branches above a bar, then leaves below the two best of them; queries that reach no leaf are routed flat.

    The tree is the heap order of the experts' numbers.
    """
    of = Window.partitionBy("query_id").orderBy(F.desc("score"), "expert")
    best = lambda rows, k: rows.withColumn("_r", F.row_number().over(of)).where(F.col("_r") <= k).drop("_r")
    rows = _routes(spark, d).withColumn("parent", F.floor((F.col("expert") - 1) / 2).cast("int"))
    branches = best(rows.where("expert in (1, 2) and score >= 0.05"), 2).select("query_id", F.col("expert").alias("parent"))
    leaves = best(rows.where("expert > 2 and score >= 0.05").join(branches, ["query_id", "parent"], "left_semi"), 3).select("query_id", "expert", "score", F.lit("tree").alias("via"))
    flat = best(rows.join(leaves.select("query_id").distinct(), "query_id", "left_anti"), 3).select("query_id", "expert", "score", F.lit("flat").alias("via"))
    return leaves.unionByName(flat).withColumn("score", F.round("score", 6))


#: Rules as a table: name, order, the field they look at, what they compare, and their severity (0 allow to 3 deny).
RULES = (("slow", 1, "latency_ms", "above", 30000.0, 2), ("lengthy", 2, "prompt_tokens", "above", 8000.0, 1), ("thin", 3, "context_tokens", "below", 1.0, 1), ("unlike", 4, "similarity", "below", 0.2, 2))
_RULES_SQL = "ru(rule, place, field, op, bar, severity) AS (VALUES " + ", ".join(f"('{a}', {b}, '{c}', '{o}', {v}::DOUBLE, {s})" for a, b, c, o, v, s in RULES) + ")"


@query("rule_evaluation", f"""WITH {_RULES_SQL}, t AS (SELECT DISTINCT ON (result_id) result_id, latency_ms, prompt_tokens::DOUBLE AS prompt_tokens, context_tokens::DOUBLE AS context_tokens, similarity::DOUBLE AS similarity FROM task_results),
f AS (UNPIVOT (SELECT result_id, coalesce(latency_ms, 'NaN'::DOUBLE) AS latency_ms, coalesce(prompt_tokens, 'NaN'::DOUBLE) AS prompt_tokens, coalesce(context_tokens, 'NaN'::DOUBLE) AS context_tokens, coalesce(similarity, 'NaN'::DOUBLE) AS similarity FROM t) ON latency_ms, prompt_tokens, context_tokens, similarity INTO NAME field VALUE v),
h AS (SELECT result_id, place, rule, CASE WHEN isnan(v) THEN 3 WHEN (op = 'above' AND v > bar) OR (op = 'below' AND v < bar) THEN severity ELSE 0 END AS s FROM f JOIN ru USING (field))
SELECT result_id, max(s)::INTEGER AS severity, arg_max(rule, s * 100 - place) AS decided_by FROM h GROUP BY result_id""")
def rule_evaluation(spark: SparkSession, d: str) -> DataFrame:
    """Rules of a table on each result: the worst outcome holds, the first rule that gives it decides; a missing value denies."""
    rules = spark.createDataFrame(list(RULES), "rule string, place int, field string, op string, bar double, severity int")
    fields = sorted({r[2] for r in RULES})
    rows = table(spark, d, "task_results").dropDuplicates(["result_id"])
    return G.evaluate_rules(rows, "result_id", fields, rules)


@query("kernel_audit", f"WITH {_RULES_SQL}, t AS (SELECT DISTINCT ON (result_id) result_id, run_id, latency_ms FROM task_results), dc AS (SELECT run_id, result_id, CASE WHEN latency_ms IS NULL OR isnan(latency_ms) THEN 'deny' WHEN latency_ms > 30000 THEN 'warn' ELSE 'allow' END AS decision FROM t) SELECT run_id, result_id, row_number() OVER (PARTITION BY run_id ORDER BY result_id)::INTEGER AS seq, decision, sha256(run_id || '|' || result_id || '|' || decision) AS digest FROM dc")
def kernel_audit(spark: SparkSession, d: str) -> DataFrame:
    """Decisions as they are appended to a run's audit, each with its digest."""
    c = F.col("latency_ms")
    rows = table(spark, d, "task_results").dropDuplicates(["result_id"]).select("run_id", "result_id", F.when(c.isNull() | F.isnan(c), "deny").when(c > 30000, "warn").otherwise("allow").alias("decision"))
    seq = F.row_number().over(Window.partitionBy("run_id").orderBy("result_id"))
    return rows.select("run_id", "result_id", seq.alias("seq"), "decision", F.sha2(F.concat_ws("|", F.col("run_id").cast("string"), F.col("result_id").cast("string"), "decision"), 256).alias("digest"))


@query("tool_filter", "WITH t AS (SELECT DISTINCT ON (result_id) result_id, arm, probe, insufficient_context FROM task_results) SELECT result_id, CASE arm WHEN 'full_context' THEN 'read' WHEN 'engram_retrieval' THEN 'search' ELSE 'unknown' END AS operation, sha256(coalesce(probe, '')) AS arguments, CASE WHEN arm NOT IN ('full_context', 'engram_retrieval') THEN 'unmapped' WHEN trim(coalesce(probe, '')) = '' THEN 'no_arguments' WHEN insufficient_context IS NULL THEN 'no_precondition' END AS blocked FROM t")
def tool_filter(spark: SparkSession, d: str) -> DataFrame:
    """Calls as operations with the digest of their arguments; calls without a mapping, arguments or precondition are blocked."""
    rows = table(spark, d, "task_results").dropDuplicates(["result_id"])
    operation = F.when(F.col("arm") == "full_context", "read").when(F.col("arm") == "engram_retrieval", "search").otherwise("unknown")
    probe = F.coalesce("probe", F.lit(""))
    blocked = F.when(operation == "unknown", "unmapped").when(F.trim(probe) == "", "no_arguments").when(F.col("insufficient_context").isNull(), "no_precondition")
    return rows.select("result_id", operation.alias("operation"), F.sha2(probe, 256).alias("arguments"), blocked.alias("blocked"))


_VERSIONS_SQL = f"v AS (SELECT DISTINCT constitution_id, version_label, published_at, rule_total, {HASH_SQL.format('content_hash')} AS own, {HASH_SQL.format('supersedes_version_hash')} AS before FROM constitution_versions)"


def _versions(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "constitution_versions").select("constitution_id", "version_label", "published_at", "rule_total", hash_key("content_hash").alias("own"), hash_key("supersedes_version_hash").alias("before")).distinct()


@query("constitution_tighten", f"WITH {_VERSIONS_SQL}, b AS (SELECT own, max(rule_total) AS total FROM v WHERE own IS NOT NULL GROUP BY own) SELECT v.constitution_id, v.own, CASE WHEN v.before IS NULL THEN 'base' WHEN b.own IS NULL THEN 'unknown_parent' WHEN v.rule_total < b.total THEN 'loosened' ELSE 'tightened' END AS outcome FROM v LEFT JOIN b ON b.own = v.before WHERE v.own IS NOT NULL")
def constitution_tighten(spark: SparkSession, d: str) -> DataFrame:
    """Overlays may only tighten: a version with fewer rules than its predecessor is refused, as is one whose predecessor is unknown."""
    rows = _versions(spark, d).where("own is not null")
    parents = rows.groupBy(F.col("own").alias("before")).agg(F.max("rule_total").alias("_total"), F.lit(True).alias("_known"))
    outcome = F.when(F.col("before").isNull(), "base").when(F.col("_known").isNull(), "unknown_parent").when(F.col("rule_total") < F.col("_total"), "loosened").otherwise("tightened")
    return rows.join(parents, "before", "left").select("constitution_id", "own", outcome.alias("outcome"))


@query("knowledge_publish", f"WITH {_VERSIONS_SQL}, s AS (SELECT constitution_id, own, before, rule_total, lag(rule_total) OVER (PARTITION BY constitution_id ORDER BY published_at NULLS FIRST, own NULLS FIRST, version_label) AS prior, row_number() OVER (PARTITION BY constitution_id ORDER BY published_at NULLS FIRST, own NULLS FIRST, version_label) AS n FROM v) SELECT constitution_id, n::INTEGER AS n, CASE WHEN own IS NULL THEN 'no_evidence' WHEN prior IS NOT NULL AND rule_total > prior + 1 THEN 'skips_a_step' ELSE 'published' END AS outcome FROM s")
def knowledge_publish(spark: SparkSession, d: str) -> DataFrame:
    """Maturity (here the rule count) may rise by one step at a time, and the evidence must be a digest of 64 hex digits."""
    order = Window.partitionBy("constitution_id").orderBy("published_at", "own", "version_label")
    rows = _versions(spark, d).withColumns({"_prior": F.lag("rule_total").over(order), "n": F.row_number().over(order)})
    outcome = F.when(F.col("own").isNull(), "no_evidence").when(F.col("rule_total") > F.col("_prior") + 1, "skips_a_step").otherwise("published")
    return rows.select("constitution_id", "n", outcome.alias("outcome"))


@query("promotion_evaluation", f"WITH {ENTRIES_SQL}, {EDGES_SQL}, ct AS (SELECT DISTINCT src AS id FROM g WHERE relation = 'contradicts'), ev AS (SELECT dst AS id, count(*) AS n FROM g WHERE relation = 'depends_on' GROUP BY dst) SELECT e.id, CASE WHEN lifecycle_state = 'archived' THEN 'rejected:archived' WHEN ct.id IS NOT NULL THEN 'rejected:contradicted' WHEN coalesce(ev.n, 0) < 1 THEN 'held:no_evidence' WHEN access_count < 3 THEN 'held:unused' ELSE 'promoted' END AS outcome FROM e LEFT JOIN ct USING (id) LEFT JOIN ev USING (id)")
def promotion_evaluation(spark: SparkSession, d: str) -> DataFrame:
    """The first finding in order decides whether an entry is promoted."""
    links = edges(spark, d)
    against = links.where("relation = 'contradicts'").select(F.col("src").alias("id"), F.lit(True).alias("_against")).distinct()
    proof = links.where("relation = 'depends_on'").groupBy(F.col("dst").alias("id")).agg(F.count("*").alias("_proof"))
    rows = entries(spark, d).join(against, "id", "left").join(proof, "id", "left")
    outcome = F.when(F.col("lifecycle_state") == "archived", "rejected:archived").when(F.col("_against"), "rejected:contradicted").when(F.coalesce("_proof", F.lit(0)) < 1, "held:no_evidence").when(F.col("access_count") < 3, "held:unused")
    return rows.select("id", outcome.otherwise("promoted").alias("outcome"))


@query("governed_commit")
def governed_commit(spark: SparkSession, d: str) -> DataFrame:
    """Versions committed in order of time: each must name the hash that is active then; the same commit again changes nothing."""
    return G.commits(_versions(spark, d), "constitution_id", "published_at", "own", "before")


@query("provenance_append", f"WITH {EDGES_SQL}, {ENTRIES_SQL}, s AS (SELECT src AS id, dst AS source, recorded_at FROM g WHERE relation = 'depends_on' QUALIFY row_number() OVER (PARTITION BY src ORDER BY recorded_at NULLS FIRST, dst) = 1) SELECT s.id, s.source, CASE WHEN x.id IS NULL THEN 'unknown_source' WHEN x.tenant_id <> '' AND x.tenant_id IS DISTINCT FROM y.tenant_id THEN 'not_authorised' ELSE 'appended' END AS outcome, sha256(s.id || '<' || s.source) AS digest FROM s LEFT JOIN e x ON x.id = s.source LEFT JOIN e y ON y.id = s.id")
def provenance_append(spark: SparkSession, d: str) -> DataFrame:
    """The first record of an id stands and never changes; its source must exist and belong to the same tenant or to none."""
    first = edges(spark, d).where("relation = 'depends_on'").groupBy(F.col("src").alias("id")).agg(F.min_by("dst", F.struct(F.col("recorded_at").isNotNull(), "recorded_at", "dst")).alias("source"))
    owner = lambda key, name: entries(spark, d).select(F.col("id").alias(key), F.col("tenant_id").alias(name))
    rows = first.join(owner("source", "_x"), "source", "left").join(owner("id", "_y"), "id", "left")
    outcome = F.when(F.col("_x").isNull(), "unknown_source").when((F.col("_x") != "") & ~F.col("_x").eqNullSafe(F.col("_y")), "not_authorised").otherwise("appended")
    return rows.select("id", "source", outcome.alias("outcome"), F.sha2(F.concat(F.col("id").cast("string"), F.lit("<"), F.col("source").cast("string")), 256).alias("digest"))


@query("profile_loadout", f"WITH {ENTRIES_SQL}, p AS (SELECT tenant_id, list_sort(list_distinct(list(category))) AS allowed, max(access_count) AS budget FROM e WHERE category IS NOT NULL GROUP BY tenant_id), l AS (SELECT tenant_id, ns, list_sort(list_distinct(list(category))) AS asked, sum(access_count)::BIGINT AS wish FROM e WHERE category IS NOT NULL AND NOT coalesce(is_summary_node, false) GROUP BY ALL) SELECT l.tenant_id, ns, len(list_filter(asked, lambda x: NOT list_contains(allowed, x))) = 0 AS narrower, least(budget, wish) AS budget FROM l JOIN p USING (tenant_id)")
def profile_loadout(spark: SparkSession, d: str) -> DataFrame:
    """What a namespace asks for may only narrow what its tenant is allowed; the smaller budget holds."""
    rows = entries(spark, d).where("category is not null")
    allowed = rows.groupBy("tenant_id").agg(F.collect_set("category").alias("_allowed"), F.max("access_count").alias("_budget"))
    asked = rows.where("not coalesce(is_summary_node, false)").groupBy("tenant_id", "ns").agg(F.collect_set("category").alias("_asked"), F.sum("access_count").alias("_wish"))
    return asked.join(allowed, "tenant_id").select("tenant_id", "ns", (F.size(F.array_except("_asked", "_allowed")) == 0).alias("narrower"), F.least(F.col("_budget").cast("long"), F.col("_wish")).alias("budget"))


@query("asset_publish", "WITH a AS (SELECT doc_id, doc_kind, trim(text) AS t FROM documents) SELECT doc_id, CASE WHEN t IS NULL OR t = '' THEN 'rejected:empty' WHEN doc_kind IS NULL THEN 'rejected:kind' WHEN row_number() OVER (PARTITION BY doc_kind, sha256(t) ORDER BY doc_id) > 1 THEN 'unchanged' ELSE 'published' END AS outcome, sha256(doc_kind || chr(10) || t) AS digest FROM a")
def asset_publish(spark: SparkSession, d: str) -> DataFrame:
    """Assets of each kind by canonical digest: empty ones are refused, a digest that is there already changes nothing."""
    rows = table(spark, d, "documents").select("doc_id", "doc_kind", F.trim("text").alias("t"))
    first = F.row_number().over(Window.partitionBy("doc_kind", "_h").orderBy("doc_id"))
    rows = rows.select("doc_id", "doc_kind", F.sha2("t", 256).alias("_h"), (F.col("t").isNull() | (F.col("t") == "")).alias("_void"), F.sha2(F.concat("doc_kind", F.lit("\n"), "t"), 256).alias("digest"))
    outcome = F.when(F.col("_void"), "rejected:empty").when(F.col("doc_kind").isNull(), "rejected:kind").when(first > 1, "unchanged").otherwise("published")
    return rows.select("doc_id", outcome.alias("outcome"), "digest")


_PLAN = f"""{OWN_SQL}, {CORPUS_SQL}, s AS (SELECT q.id AS query_id, c.id, c.ns, c.category, c.lifecycle_state AS state, {COS} AS score FROM c q JOIN c ON q.id <> c.id AND q.vector IS NOT NULL AND c.vector IS NOT NULL WHERE q.id % 50 = 0),
pl AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, id) AS r FROM s QUALIFY r <= 20),
tc AS (SELECT query_id, id, score, r, CASE WHEN id NOT IN (SELECT id FROM e) THEN 'no_source' WHEN ns IS NULL THEN 'no_search_right' WHEN state = 'archived' THEN 'no_artifact_right' END AS omitted FROM pl),
td AS (SELECT *, row_number() OVER (PARTITION BY query_id, omitted IS NULL ORDER BY r) AS k FROM tc)"""


@query("authorised_plan", f"WITH {_PLAN} SELECT query_id, id, round(score, 6) AS score, CASE WHEN omitted IS NOT NULL THEN omitted WHEN k > 5 THEN 'beyond_limit' ELSE 'taken' END AS outcome FROM td")
def authorised_plan(spark: SparkSession, d: str) -> DataFrame:
    """Candidates in order of score with the first right that is missing; five that pass are taken. Omissions stay in the trace."""
    rows = corpus(spark, d)
    found = R.knn(_queries(rows).select(F.col("id").alias("query_id"), "vector"), rows, 20, exclude_self=True)
    known = entries(spark, d).select("id", F.lit(True).alias("_known"))
    traced = found.join(rows.select("id", "ns", "lifecycle_state"), "id").join(known, "id", "left")
    omitted = F.when(F.col("_known").isNull(), "no_source").when(F.col("ns").isNull(), "no_search_right").when(F.col("lifecycle_state") == "archived", "no_artifact_right")
    traced = traced.withColumn("omitted", omitted).withColumn("_free", F.col("omitted").isNull())
    place = F.row_number().over(Window.partitionBy("query_id", "_free").orderBy("rank"))
    return traced.withColumn("_k", place).select("query_id", "id", F.round("score", 6).alias("score"), F.coalesce("omitted", F.when(F.col("_k") > 5, "beyond_limit").otherwise("taken")).alias("outcome"))


@query("context_compilation")
def context_compilation(spark: SparkSession, d: str) -> DataFrame:
    """What a plan took, in order, into a budget of items, tokens and bytes, with rights checked once more; what does not fit is skipped."""
    plan = authorised_plan(spark, d).where("outcome = 'taken'").select("query_id", "id", "score")
    texts = table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.ceil(F.length("text") / 4).cast("int").alias("tokens"), F.octet_length("text").alias("bytes"))
    live = entries(spark, d).where("lifecycle_state <> 'archived'").select("id")
    rows = plan.join(texts, "id").join(live, "id", "left_semi")
    rows = rows.withColumn("place", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id")))
    return G.compile_context(rows, "query_id", "place", {"tokens": 1500, "bytes": 5000}, 3).select("query_id", "id", "place", "tokens", "bytes", "taken")


@query("holm_bonferroni", """WITH s AS (SELECT DISTINCT ON (score_id) score_id, dataset_id, search_mode, query_id, mrr::DOUBLE AS v FROM query_scores), a AS (SELECT dataset_id, search_mode, query_id, avg(v) AS v FROM s WHERE query_id IS NOT NULL GROUP BY ALL),
p AS (SELECT c.dataset_id, c.search_mode, count(*) FILTER (c.v > b.v) AS wins, count(*) FILTER (c.v < b.v) AS losses FROM a c JOIN a b ON b.dataset_id = c.dataset_id AND b.query_id = c.query_id AND b.search_mode = 'vector' WHERE c.search_mode <> 'vector' GROUP BY ALL),
t AS (SELECT *, exp(-2.0::DOUBLE * greatest(0, wins / greatest(wins + losses, 1)::DOUBLE - 0.5) ^ 2 * (wins + losses)) AS bound FROM p),
o AS (SELECT *, least(1.0, (count(*) OVER (PARTITION BY dataset_id) - row_number() OVER (PARTITION BY dataset_id ORDER BY bound, search_mode) + 1) * bound) AS x FROM t)
SELECT dataset_id, search_mode, wins, losses, round(max(x) OVER (PARTITION BY dataset_id ORDER BY bound, search_mode ROWS UNBOUNDED PRECEDING), 6) AS adjusted FROM o""")
def holm_bonferroni(spark: SparkSession, d: str) -> DataFrame:
    """Step-down adjustment of sign tests of each mode against plain search; p by its exponential bound."""
    from heddle.operators import evaluation as X

    rows = table(spark, d, "query_scores").dropDuplicates(["score_id"]).where("query_id is not null").groupBy("dataset_id", "search_mode", "query_id").agg(F.avg(F.col("mrr").cast("double")).alias("v"))
    base = rows.where("search_mode = 'vector'").select("dataset_id", "query_id", F.col("v").alias("_b"))
    pairs = rows.where("search_mode <> 'vector'").join(base, ["dataset_id", "query_id"])
    counts = pairs.groupBy("dataset_id", "search_mode").agg(F.count(F.when(F.col("v") > F.col("_b"), 1)).alias("wins"), F.count(F.when(F.col("v") < F.col("_b"), 1)).alias("losses"))
    n = F.col("wins") + F.col("losses")
    p = F.exp(-2.0 * F.pow(F.greatest(F.lit(0.0), F.col("wins") / F.greatest(n, F.lit(1)) - 0.5), 2) * n)
    out = X.holm(counts.withColumn("p", p), ["dataset_id"], "p", "search_mode")
    return out.select("dataset_id", "search_mode", "wins", "losses", F.round("adjusted", 6).alias("adjusted"))


@query("sample_window", "WITH s AS (SELECT DISTINCT ON (score_id) score_id, search_mode, latency_ms, recorded_at FROM query_scores), w AS (SELECT * FROM s WHERE NOT isnan(latency_ms) AND latency_ms >= 0 QUALIFY row_number() OVER (PARTITION BY search_mode ORDER BY recorded_at DESC NULLS LAST, score_id DESC) <= 1000) SELECT search_mode, count(*) AS n, min(recorded_at) AS since, round(avg(latency_ms), 4) AS mean_ms, max(latency_ms) AS max_ms FROM w GROUP BY search_mode")
def sample_window(spark: SparkSession, d: str) -> DataFrame:
    """The last thousand usable samples of each mode, which is all that a bounded window keeps; taken per salt first, so that no task sees a whole mode."""
    rows = table(spark, d, "query_scores").dropDuplicates(["score_id"]).where("not isnan(latency_ms) and latency_ms >= 0").select("search_mode", "score_id", "latency_ms", "recorded_at")
    newest = [F.desc_nulls_last("recorded_at"), F.desc("score_id")]
    local = rows.withColumn("_r", F.row_number().over(Window.partitionBy("search_mode", F.pmod(F.xxhash64("score_id"), F.lit(32))).orderBy(*newest))).where("_r <= 1000")
    last = local.withColumn("_r", F.row_number().over(Window.partitionBy("search_mode").orderBy(*newest))).where("_r <= 1000")
    return last.groupBy("search_mode").agg(F.count("*").alias("n"), F.min("recorded_at").alias("since"), F.round(F.avg("latency_ms"), 4).alias("mean_ms"), F.max("latency_ms").alias("max_ms"))
