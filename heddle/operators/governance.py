"""Permissions, provenance, budgets and promotion."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from heddle.session import cut


def intersect_grants(grants: DataFrame, sources: DataFrame) -> DataFrame:
    """(target, capability, subject): what every source of a target grants.

    ``grants``: (artifact, capability, subject); ``sources``: (target,
    artifact).  A source without any grant leaves nothing.
    """
    needed = sources.distinct().groupBy("target").agg(F.count("*").alias("_n"))
    held = sources.distinct().join(grants.distinct(), "artifact").groupBy("target", "capability", "subject").agg(F.count_distinct("artifact").alias("_h"))
    return held.join(needed, "target").where("_h = _n").select("target", "capability", "subject")


def narrower(child: DataFrame, parent: DataFrame, key: str) -> DataFrame:
    """(key, narrower): whether the child grants nothing that the parent does not; both have (key, capability, subject)."""
    extra = child.distinct().join(parent, [key, "capability", "subject"], "left_anti").select(key).distinct().withColumn("_x", F.lit(True))
    return child.select(key).distinct().join(extra, key, "left").select(key, F.col("_x").isNull().alias("narrower"))


def visible(rows: DataFrame, owners: DataFrame, grants: DataFrame, agent: str) -> DataFrame:
    """Rows of namespaces that the agent owns or has a grant for; names that start with _ are hidden."""
    mine = owners.where(F.col("owner") == agent).select("ns").union(grants.where(F.col("agent_id") == agent).select("ns")).distinct()
    return rows.where(~F.col("ns").startswith("_")).join(mine, "ns", "left_semi")


def lineage(sources: DataFrame, starts: DataFrame, depth: int = 8) -> DataFrame:
    """(start, artifact, depth, complete): all sources behind a target, at their least depth.

    ``sources``: (target, artifact); ``complete`` is false where something
    lies beyond the depth.
    """
    seen = starts.select("start", F.col("start").alias("artifact"), F.lit(0).alias("depth"))
    front, hops = seen, sources.select(F.col("target").alias("_t"), F.col("artifact").alias("_s")).distinct()
    for step in range(1, depth + 2):
        ahead = front.join(hops, front["artifact"] == F.col("_t")).select("start", F.col("_s").alias("artifact")).distinct()
        front = cut(ahead.join(seen.select("start", "artifact"), ["start", "artifact"], "left_anti").withColumn("depth", F.lit(step)))
        if step <= depth:
            seen = seen.unionByName(front)
    beyond = front.select("start").distinct().withColumn("_b", F.lit(True))
    return seen.where("depth > 0").join(beyond, "start", "left").select("start", "artifact", "depth", F.col("_b").isNull().alias("complete"))


def greedy_budget(items: DataFrame, group: str, order: str, cost: str, budget: int, most: int) -> DataFrame:
    """(group, order, cost, taken): items in order while they fit; one that does not is skipped, later ones may fit.

    A group is one request's ranked candidates, which the retrieval plan bounds.
    """

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        left, room, taken = budget, most, []
        for c in rows.sort_values(order)[cost]:
            fits = room > 0 and c <= left
            taken.append(fits)
            left, room = left - c * fits, room - fits
        return rows.sort_values(order)[[group, order, cost]].assign(taken=taken)

    kinds = {f.name: f.dataType.simpleString() for f in items.schema.fields}
    return items.select(group, order, cost).groupBy(group).applyInPandas(run, f"{group} {kinds[group]}, {order} {kinds[order]}, {cost} {kinds[cost]}, taken boolean")


def veto(checks: DataFrame, key: str) -> DataFrame:
    """(key, step, ran): checks in order, deterministic ones first; nothing runs after a veto."""
    order = Window.partitionBy(key).orderBy(F.desc("deterministic"), "step")
    stopped = F.max(F.col("vetoed").cast("int")).over(order.rowsBetween(Window.unboundedPreceding, -1))
    return checks.withColumn("ran", F.coalesce(stopped, F.lit(0)) == 0).select(key, "step", "ran")


def chained(versions: DataFrame, group: str, order: str, own: str, before: str) -> DataFrame:
    """(group, own, linked): whether each version names the hash of the one before it."""
    prior = F.lag(own).over(Window.partitionBy(group).orderBy(order, own))
    return versions.select(group, own, F.when(F.col(before).isNull(), prior.isNull()).otherwise(F.coalesce(F.col(before) == prior, F.lit(False))).alias("linked"))


def evaluate_rules(rows: DataFrame, key: str, fields: list[str], rules: DataFrame) -> DataFrame:
    """(key, severity, decided_by): the worst outcome of all rules, and the first rule in order that gives it.

    ``rules``: (rule, place, field, op, bar, severity) with op above or below;
    a null or NaN value denies (3).  Rules are a small table by nature and are
    broadcast; rows never meet one another.
    """
    unpivoted = rows.select(key, F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).cast("double").alias("v")) for f in fields])).alias("f")).select(key, "f.*")
    met = unpivoted.join(F.broadcast(rules), "field")
    broken = ((F.col("op") == "above") & (F.col("v") > F.col("bar"))) | ((F.col("op") == "below") & (F.col("v") < F.col("bar")))
    outcome = F.when(F.col("v").isNull() | F.isnan("v"), 3).when(broken, F.col("severity")).otherwise(0)
    return met.groupBy(key).agg(F.max(outcome).alias("severity"), F.max_by("rule", F.struct(outcome, -F.col("place"))).alias("decided_by"))


def commits(versions: DataFrame, group: str, order: str, own: str, before: str) -> DataFrame:
    """(group, own, outcome) of commits applied one after the other: accepted, conflict, repeated or invalid.

    A commit is accepted if it names the active hash (null at first) and
    becomes active; the active one again is repeated.  One group is one
    artifact's history, whose commits depend on each other by definition.
    """
    kinds = {f.name: f.dataType.simpleString() for f in versions.schema.fields}

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        active, out = None, []
        for mine, named in zip(rows[own], rows[before], strict=True):
            mine, named = (None if x is None or x != x else x for x in (mine, named))
            if mine is None:
                out.append("invalid")
            elif mine == active:
                out.append("repeated")
            elif named == active:
                active = mine
                out.append("accepted")
            else:
                out.append("conflict")
        return rows[[group, own]].assign(outcome=out)

    def ordered(rows: pd.DataFrame) -> pd.DataFrame:
        return run(rows.sort_values([order, own], na_position="first"))

    return versions.select(group, order, own, before).groupBy(group).applyInPandas(ordered, f"{group} {kinds[group]}, {own} {kinds[own]}, outcome string")


def compile_context(items: DataFrame, group: str, order: str, budgets: dict[str, int], most: int) -> DataFrame:
    """``items`` with ``taken``: in order while every budget and the number of items allow; one that does not fit is skipped, later ones may.

    A null cost does not fit.  A group is one request's plan, which is short.
    """
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in items.schema.fields) + ", taken boolean"

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(order)
        left, room, taken = dict(budgets), most, []
        for costs in rows[list(budgets)].itertuples(index=False):
            fits = room > 0 and all(c == c and c is not None and c <= left[b] for b, c in zip(budgets, costs, strict=True))
            if fits:
                left = {b: left[b] - c for b, c in zip(budgets, costs, strict=True)}
                room -= 1
            taken.append(fits)
        return rows.assign(taken=taken)

    return items.groupBy(group).applyInPandas(run, schema)
