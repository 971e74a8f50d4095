"""Parent-child rows to full hierarchies, by splitters and a reduced pointer graph.

Every node has at most one parent.  A deterministic hash picks about one node
in ``rate`` as a splitter; roots are always stops.  Each node walks to the
next stop above it (walks are doubled, so a walk of length w takes log2(w)
rounds); then only the splitters are solved against each other, and every node
takes root, depth and path from its stop.  A loop without any splitter never
meets a stop: its nodes and everything below them are what no round ends.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from heddle.session import cut


def latest_parent(edges: DataFrame, child: str, parent: str, at: str) -> DataFrame:
    """One (node, parent) row for each child: the parent recorded last.

    Rows without child or parent are left out.  A null time counts as the
    earliest; among equal times the greatest parent holds.
    """
    rows = edges.where(F.col(child).isNotNull() & F.col(parent).isNotNull())
    best = rows.groupBy(F.col(child).alias("node")).agg(F.max(F.struct(F.col(at).alias("t"), F.col(parent).alias("p"))).alias("m"))
    return best.select("node", F.col("m.p").alias("parent"))


def _double(state: DataFrame, with_paths: bool) -> DataFrame:
    """Follow pointers until each is done; loops end with ``cyclic``.

    ``state``: node, cur, dist, done, dead, hops.  ``hops`` are the nodes
    passed, nearest first, ``cur`` included; ``dead`` marks a row that is done
    because a loop lies above it, and is handed down.

    An open row has gone exactly ``steps`` hops without a stop.  If one of
    them still had a stop ahead, the nodes on its way would be at every
    smaller distance from it, and some would have been done in this round; so
    when a round ends no row, all open rows are on loops or below them.
    """
    columns = ["node", "cur", "dist", "done", "dead", *(["hops"] if with_paths else [])]
    state = cut(state.select(*columns))
    # Rows that are done are written once and only looked up from then on.
    done, going = state.where("done"), state.where(~F.col("done"))
    before, left = None, going.count()
    while left and left != before:
        ahead = done.unionByName(going).select(F.col("node").alias("cur"), *[F.col(c).alias(f"_{c}") for c in columns[1:]])
        moved = going.join(ahead, "cur").select(
            "node", F.col("_cur").alias("cur"), (F.col("dist") + F.col("_dist")).alias("dist"), F.col("_done").alias("done"), F.col("_dead").alias("dead"),
            *([F.concat("hops", "_hops").alias("hops")] if with_paths else []),
        )
        moved = cut(moved)
        done, going = done.unionByName(moved.where("done")), moved.where(~F.col("done"))
        before, left = left, going.count()
    return done.withColumn("cyclic", F.col("dead")).unionByName(going.withColumn("cyclic", F.lit(True)))


def _is_splitter(node: Column, rate: int) -> Column:
    return F.pmod(F.xxhash64(node), F.lit(rate)) == 0


def resolve(pointers: DataFrame, nodes: DataFrame | None = None, rate: int = 8, with_paths: bool = False) -> DataFrame:
    """Root and depth of every node.

    ``pointers``: (node, parent), one row for each node that has a parent;
    ``nodes``: further nodes (column node).  Output: node, root, depth,
    is_cycle and, if asked, path (array from the root down to the node).
    Nodes on a loop or below one get root null, depth -1, path null.  An empty
    input gives an empty result.
    """
    pointers = cut(pointers.select("node", "parent").where(F.col("node").isNotNull() & F.col("parent").isNotNull()))
    everything = pointers.select("node").union(pointers.select("parent"))
    if nodes is not None:
        everything = everything.union(nodes.select("node").where(F.col("node").isNotNull()))
    everything = everything.distinct()
    child = pointers.select(F.col("node").alias("parent"), F.lit(False).alias("_top"))
    first = pointers.join(child, "parent", "left").select(
        "node", F.col("parent").alias("cur"), F.lit(1).cast("long").alias("dist"), F.coalesce("_top", F.lit(True)).alias("at_root"), *([F.array("parent").alias("hops")] if with_paths else [])
    )
    walk = first.withColumn("done", F.col("at_root") | _is_splitter(F.col("cur"), rate)).withColumn("dead", F.lit(False)).drop("at_root")
    walked = _double(walk, with_paths)
    # Stops that are splitters have a pointer of their own, roots do not.
    kind = pointers.select(F.col("node").alias("cur"), F.lit(False).alias("_top")).where(_is_splitter(F.col("cur"), rate))
    walked = cut(walked.join(kind, "cur", "left").withColumn("at_root", ~F.col("cyclic") & F.coalesce("_top", F.lit(True))).drop("_top"))
    reduced = walked.where(_is_splitter(F.col("node"), rate)).select(
        "node", "cur", "dist", (F.col("at_root") | F.col("cyclic")).alias("done"), F.col("cyclic").alias("dead"), *(["hops"] if with_paths else [])
    )
    solved = _double(reduced, with_paths)
    verdict = solved.select(F.col("node").alias("cur"), F.col("cur").alias("_root"), F.col("dist").alias("_depth"), F.col("cyclic").alias("_loop"), *([F.col("hops").alias("_hops")] if with_paths else []))
    ends = walked.where("at_root").select("node", F.col("cur").alias("root"), F.col("dist").alias("depth"), F.lit(False).alias("is_cycle"), *(["hops"] if with_paths else []))
    lost = walked.where("cyclic").select("node", F.lit(None).cast(pointers.schema["node"].dataType).alias("root"), F.lit(-1).cast("long").alias("depth"), F.lit(True).alias("is_cycle"), *(["hops"] if with_paths else []))
    via = walked.where(~F.col("at_root") & ~F.col("cyclic")).join(verdict, "cur")
    via = via.select(
        "node", F.when(~F.col("_loop"), F.col("_root")).alias("root"), F.when(F.col("_loop"), F.lit(-1)).otherwise(F.col("dist") + F.col("_depth")).cast("long").alias("depth"), F.col("_loop").alias("is_cycle"),
        *([F.concat("hops", "_hops").alias("hops")] if with_paths else []),
    )
    below = ends.unionByName(via).unionByName(lost)
    tops = everything.join(pointers.select("node"), "node", "left_anti").select("node", F.col("node").alias("root"), F.lit(0).cast("long").alias("depth"), F.lit(False).alias("is_cycle"), *([F.slice(F.array("node"), 1, 0).alias("hops")] if with_paths else []))
    out = below.unionByName(tops)
    if with_paths:
        path = F.when(~F.col("is_cycle"), F.concat(F.reverse("hops"), F.array("node")))
        out = out.withColumn("path", path).drop("hops")
    return out


def descendants(resolved: DataFrame) -> DataFrame:
    """All (ancestor, node, distance) rows of ``resolve(..., with_paths=True)``.

    Nodes on or below a loop have no defined ancestors and give no rows.
    """
    rows = resolved.where(~F.col("is_cycle")).select("node", "depth", F.posexplode("path").alias("_at", "ancestor"))
    return rows.where(F.col("ancestor") != F.col("node")).select("ancestor", "node", (F.col("depth") - F.col("_at")).alias("distance"))
