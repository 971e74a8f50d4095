"""Ageing, feedback, merging and admission of entries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# How much faster a state decays.
DECAY_MULTIPLIERS = {"stm": 3.0, "ltm": 1.0, "archived": 0.1}


def _multiplier(state: Column) -> Column:
    out = F.lit(1.0)
    for name, factor in DECAY_MULTIPLIERS.items():
        out = F.when(state == name, F.lit(factor)).otherwise(out)
    return out


def decay(entries: DataFrame, now: Column, rate: float = 0.1, reinforcement: float = 1.0, stm_below: float = 2.0, archive_below: float = -5.0) -> DataFrame:
    """``entries`` with new_energy and new_state after one cycle; summaries are left out.

    Energy is accesses * reinforcement less hours since the last access *
    rate * the state's multiplier.  Short-term entries below ``stm_below``
    become long-term, long-term ones below ``archive_below`` are archived.  A
    null access time counts as no time passed.
    """
    hours = F.coalesce((F.unix_micros(now) - F.unix_micros("last_accessed_at")) / F.lit(3.6e9), F.lit(0.0))
    energy = F.col("access_count") * reinforcement - hours * rate * _multiplier(F.col("lifecycle_state"))
    state = F.col("lifecycle_state")
    rows = entries.where(~F.coalesce("is_summary_node", F.lit(False))).withColumn("new_energy", energy)
    moved = F.when((state == "stm") & (F.col("new_energy") < stm_below), "ltm").when((state == "ltm") & (F.col("new_energy") < archive_below), "archived").otherwise(state)
    return rows.withColumn("new_state", moved)


def feedback(entries: DataFrame, deltas: DataFrame, promote: float = 2.0, demote: float = -2.0) -> DataFrame:
    """(id, new_energy, new_state, accesses): the sum of feedback (each within ten) applied.

    ``deltas``: (id, delta).  Positive feedback counts as an access.  Rising to
    ``promote`` lifts stm to ltm and archived to stm; falling to ``demote``
    sinks ltm to stm and stm to archived.
    """
    clamped = F.greatest(F.lit(-10.0), F.least(F.lit(10.0), F.col("delta")))
    sums = deltas.groupBy("id").agg(F.sum(clamped).alias("_d"), F.count(F.when(F.col("delta") > 0, 1)).alias("_n"))
    rows = entries.join(sums, "id")
    energy = F.col("activation_energy") + F.col("_d")
    state = F.col("lifecycle_state")
    up, down = (F.col("_d") > 0) & (energy >= promote), (F.col("_d") < 0) & (energy <= demote)
    moved = F.when(up & (state == "stm"), "ltm").when(up & (state == "archived"), "stm").when(down & (state == "ltm"), "stm").when(down & (state == "stm"), "archived").otherwise(state)
    return rows.select("id", energy.alias("new_energy"), moved.alias("new_state"), (F.col("access_count") + F.col("_n")).alias("accesses"))


def merge(entries: DataFrame, pairs: DataFrame) -> DataFrame:
    """(id, accesses, metadata, archived): entries after merging; ``pairs``: (kept, gone), each gone entry once.

    The kept entry sums the accesses; of metadata keys held by both its own
    values stay; merged entries are archived.  ``entries`` has a map metadata.
    """
    gone = pairs.join(entries.select(F.col("id").alias("gone"), F.col("access_count").alias("_a"), F.col("metadata").alias("_m")), "gone")
    added = gone.groupBy("kept").agg(F.sum("_a").alias("_a"), F.array_distinct(F.flatten(F.sort_array(F.collect_list(F.map_entries("_m"))))).alias("_e"))
    rows = entries.join(added.withColumnRenamed("kept", "id"), "id", "left").join(pairs.select(F.col("gone").alias("id"), F.lit(True).alias("_gone")), "id", "left")
    own = F.coalesce("metadata", F.create_map().cast("map<string,string>"))
    fresh = F.filter(F.coalesce("_e", F.array().cast("array<struct<key:string,value:string>>")), lambda e: ~F.map_contains_key(own, e["key"]))
    first = F.aggregate(fresh, F.array().cast("array<struct<key:string,value:string>>"), lambda s, e: F.when(F.exists(s, lambda x: x["key"] == e["key"]), s).otherwise(F.array_append(s, e)))
    return rows.select("id", (F.col("access_count") + F.coalesce("_a", F.lit(0))).alias("accesses"), F.map_concat(own, F.map_from_entries(first)).alias("metadata"), F.coalesce("_gone", F.lit(False)).alias("archived"))


def admission(best: Column, block: float = 0.95, warn: float = 0.90, link: float = 0.85, cross: float = 0.65) -> Column:
    """What to do with a new entry, by its cosine to the nearest stored one."""
    return F.when(best >= block, "blocked").when(best >= warn, "warned").when(best >= link, "similar_to").when(best >= cross, "cross_reference").otherwise("stored")
