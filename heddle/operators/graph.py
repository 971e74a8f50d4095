"""Traversal, propagation and components over typed, weighted edges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from heddle.session import cut

# Energy that an edge hands on, by relation; others 0.5.
EDGE_WEIGHTS = {"depends_on": 0.9, "parent_child": 0.8, "elaborates": 0.7, "cross_reference": 0.6, "similar_to": 0.5, "contradicts": 0.3}


def edge_weight(relation: Column) -> Column:
    """Energy factor of a relation."""
    out = F.lit(0.5)
    for name, weight in EDGE_WEIGHTS.items():
        out = F.when(relation == name, F.lit(weight)).otherwise(out)
    return out


def mirrored(edges: DataFrame, relation: str = "cross_reference") -> DataFrame:
    """Edges with the reverse of every edge of ``relation``, each edge once."""
    back = edges.where(F.col("relation") == relation).select(F.col("dst").alias("src"), F.col("src").alias("dst"), "relation", "weight")
    both = edges.select("src", "dst", "relation", "weight").unionByName(back)
    return both.groupBy("src", "dst", "relation").agg(F.max("weight").alias("weight"))


def traverse(edges: DataFrame, starts: DataFrame, depth: int, relation: str | None = None, least: float = 0.0) -> DataFrame:
    """(start, node, depth): nodes reached along outgoing edges, at their least depth; the start itself has depth 0.

    ``starts``: (start).  The frontier shrinks by an anti-join with what is
    seen; the depth is clamped to 1..5.
    """
    rows = edges.where(F.col("weight") >= least)
    if relation:
        rows = rows.where(F.col("relation") == relation)
    hops = rows.select("src", "dst").distinct()
    seen = starts.select("start", F.col("start").alias("node"), F.lit(0).alias("depth"))
    frontier = seen
    for step in range(1, max(1, min(5, depth)) + 1):
        ahead = frontier.select("start", F.col("node").alias("src")).join(hops, "src").select("start", F.col("dst").alias("node")).distinct()
        frontier = ahead.join(seen.select("start", "node"), ["start", "node"], "left_anti").withColumn("depth", F.lit(step))
        seen = seen.unionByName(frontier)
    return seen


def spread(edges: DataFrame, starts: DataFrame, depth: int = 3, decay: float = 0.5, least: float = 0.1) -> DataFrame:
    """(start, node, boost): activation handed along edges in both directions, start itself left out.

    ``starts``: (start, energy).  A neighbour gets energy * edge weight /
    sqrt(degree); parts below ``least`` stop, path by path; what goes on is
    halved at each hop.
    """
    both = edges.select("src", "dst", "relation").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "relation"))
    degree = both.groupBy("src").agg(F.count("*").alias("_d"))
    hops = both.join(degree, "src").select("src", "dst", (edge_weight(F.col("relation")) / F.sqrt("_d")).alias("_f"))
    front = starts.select("start", F.col("start").alias("node"), "energy")
    reached = None
    for _ in range(depth):
        step = front.where(F.col("energy") >= least).select("start", F.col("node").alias("src"), "energy").join(hops, "src")
        step = step.select("start", F.col("dst").alias("node"), (F.col("energy") * F.col("_f")).alias("boost")).where(F.col("boost") >= least)
        reached = step if reached is None else reached.unionByName(step)
        front = step.select("start", "node", (F.col("boost") * decay).alias("energy"))
    return reached.where("start <> node").groupBy("start", "node").agg(F.sum("boost").alias("boost"))


def components(links: DataFrame) -> DataFrame:
    """(node, component): smallest node of the connected component; ``links``: (a, b).

    Large-star and small-star rounds (Kiveris et al., 2014): a number of
    rounds logarithmic in the component's size, aggregates only.
    """
    edges = cut(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    while True:
        both = edges.union(edges.select("v", "u"))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        star = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        low = star.groupBy("u").agg(F.min("v").alias("m"))
        down = star.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        after = cut(down.union(low.select("u", F.col("m").alias("v"))).distinct())
        changed = after.join(edges, ["u", "v"], "left_anti").limit(1).count() + edges.join(after, ["u", "v"], "left_anti").limit(1).count()
        edges = after
        if not changed:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("component"))).distinct()


def dbscan(pairs: DataFrame, points: DataFrame, min_points: int = 3) -> DataFrame:
    """(id, cluster, core): density clusters from the pairs within the radius.

    ``pairs``: (id_a, id_b), each pair once; ``points``: (id).  A core point
    has at least ``min_points`` other points near it; a cluster is named by
    its smallest core point; a border point joins the adjacent cluster with
    the smallest name; noise gets null.
    """
    near = pairs.select(F.col("id_a").alias("id"), F.col("id_b").alias("other")).unionByName(pairs.select(F.col("id_b").alias("id"), F.col("id_a").alias("other")))
    cores = cut(near.groupBy("id").agg(F.count("*").alias("n")).where(F.col("n") >= min_points).select("id"))
    inner = near.join(cores, "id").join(cores.withColumnRenamed("id", "other"), "other").where("id < other")
    named = components(inner.select(F.col("id").alias("a"), F.col("other").alias("b")))
    named = cores.join(named.withColumnRenamed("node", "id"), "id", "left").select("id", F.coalesce("component", "id").alias("cluster"))
    border = near.join(cores, "id", "left_anti").join(named.withColumnRenamed("id", "other"), "other").groupBy("id").agg(F.min("cluster").alias("cluster"))
    both = named.withColumn("core", F.lit(True)).unionByName(border.withColumn("core", F.lit(False)))
    return points.select("id").join(both, "id", "left").select("id", "cluster", F.coalesce("core", F.lit(False)).alias("core"))


def kahn_levels(edges: DataFrame) -> DataFrame:
    """(node, level): longest path from a node without predecessors; nodes on or behind a loop are left out.

    ``edges``: (before, after).  One round for each level of the graph; a
    round that frees no node ends it, and what is left then hangs on loops.
    """
    left = cut(edges.where("before is not null and after is not null").distinct())
    remaining = cut(left.select(F.col("before").alias("node")).union(left.select("after")).distinct())
    done, level = remaining.limit(0).withColumn("level", F.lit(0)), 0
    while True:
        blocked = left.select(F.col("after").alias("node")).distinct()
        ready = cut(remaining.join(blocked, "node", "left_anti"))
        if ready.isEmpty():
            return done
        done = done.unionByName(ready.withColumn("level", F.lit(level)))
        remaining = cut(remaining.join(ready, "node", "left_anti"))
        left = cut(left.join(ready.withColumnRenamed("node", "before"), "before", "left_anti").select("before", "after"))
        level += 1


def reasoning(cited: DataFrame, held: DataFrame, edges: DataFrame, states: DataFrame, case: str) -> DataFrame:
    """Quality of what each case cites; ``cited``: (case, id, n), ``held``: (case, id) of its context.

    Output: case, cited, backed_share (in the context), stale_share
    (archived), valid_steps (an edge leads to the next cited one), supported
    (something it depends on is cited), contradictions (pairs of cited ids),
    noise_share (context that is not cited; null without context).
    """
    known = states.select("id", (F.col("lifecycle_state") == "archived").alias("_stale"))
    rows = cited.withColumn("_next", F.lead("id").over(Window.partitionBy(case).orderBy("n")))
    rows = rows.join(known, "id", "left").join(held.withColumn("_backed", F.lit(True)), [case, "id"], "left")
    links = edges.select(F.col("src").alias("id"), F.col("dst").alias("_next")).distinct().withColumn("_step", F.lit(True))
    rows = rows.join(links, ["id", "_next"], "left")
    needs = edges.where("relation = 'depends_on'").select(F.col("src").alias("id"), F.col("dst").alias("_need")).distinct()
    support = cited.select(case, "id").join(needs, "id").join(cited.select(case, F.col("id").alias("_need")), [case, "_need"], "left_semi").select(case, "id").distinct().withColumn("_supported", F.lit(True))
    rows = rows.join(support, [case, "id"], "left")
    share = lambda c: F.round(F.count(F.when(F.col(c), 1)) / F.count("*"), 6)
    count = lambda c: F.count(F.when(F.col(c), 1))
    out = rows.groupBy(case).agg(F.count("*").alias("cited"), share("_backed").alias("backed_share"), share("_stale").alias("stale_share"), count("_step").alias("valid_steps"), count("_supported").alias("supported"))
    against = edges.where("relation = 'contradicts'").select(F.least("src", "dst").alias("_a"), F.greatest("src", "dst").alias("_b")).distinct()
    pairs = against.join(cited.select(case, F.col("id").alias("_a")), "_a").join(cited.select(case, F.col("id").alias("_b")), [case, "_b"]).groupBy(case).agg(F.count("*").alias("_c"))
    noise = held.join(cited.select(case, "id", F.lit(True).alias("_used")), [case, "id"], "left").groupBy(case).agg(F.round(F.count(F.when(F.col("_used").isNull(), 1)) / F.count("*"), 6).alias("noise_share"))
    return out.join(pairs, case, "left").join(noise, case, "left").select(*out.columns, F.coalesce("_c", F.lit(0)).alias("contradictions"), "noise_share")
