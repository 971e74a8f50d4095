"""Exact percentiles by a full distributed sort, and mergeable summaries.

``sorted_percentiles`` sorts all values once, counts each group's rows in each
partition, turns the counts into offsets, and reads the one or two order
statistics a percentile needs from the partitions that hold them.  No group is
ever collected: a group of any size is spread over many partitions.

``summaries`` keeps counts in buckets whose width is a fixed ratio, so that
summaries of separate shards or days can be added up; a percentile read from
them has a bounded relative error.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from heddle.session import cut, partitions


#: Positions to look up that are broadcast at most, about 100 bytes each; more of them shuffle.
BROADCAST_ROWS = 200_000


def usable(value: str) -> F.Column:
    """Neither null nor NaN nor negative."""
    c = F.col(value)
    return c.isNotNull() & ~F.isnan(c.cast("double")) & (c >= 0)


def _ranks(table: pa.Table, group: list[str], key: str | None, value: str, carry: dict | None) -> tuple[np.ndarray, np.ndarray]:
    """For sorted rows: whether each starts a new group and whether it repeats the row before."""
    n = table.num_rows
    new = np.zeros(n, bool)
    repeat = np.ones(n, bool)
    for c in [*group, value, *([key] if key else [])]:
        column = table[c].combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = column.chunk(0) if column.num_chunks == 1 else pa.concat_arrays(column.chunks)
        codes = column.dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
        differs = np.empty(n, bool)
        differs[1:] = codes[1:] != codes[:-1]
        differs[0] = carry is None or column[0].as_py() != carry[c]
        if c in group:
            new |= differs
        repeat &= ~differs
    return new, (repeat if key else np.zeros(n, bool))


def sorted_percentiles(df: DataFrame, group: list[str], value: str, quantiles: list[float], key: str | None = None) -> DataFrame:
    """Percentiles of ``value`` by group, linearly interpolated between ranks.

    Only usable values (see ``usable``) count.  ``key`` names a row id: rows
    with equal group, value and key are one row delivered again and count
    once; they are neighbours after the sort, so dropping them costs no
    further shuffle.  Null group values form a group.  Output: group, n,
    quantile, percentile; groups without usable values give no rows.
    """
    order = [*group, value, *([key] if key else [])]
    rows = df.where(usable(value)).select(*order)
    n = partitions(df.sparkSession)
    columns = [F.col(c).asc_nulls_first() for c in order]
    ranged = rows.repartitionByRange(n, *columns).sortWithinPartitions(*columns)
    fields = [df.schema[c] for c in group]
    schema = T.StructType([*fields, T.StructField("_value", T.DoubleType()), T.StructField("_pid", T.IntegerType()), T.StructField("_pos", T.LongType())])

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        pid = TaskContext.get().partitionId()
        carry, position = None, -1
        for batch in batches:
            table = pa.Table.from_batches([batch])
            if not table.num_rows:
                continue
            new, repeat = _ranks(table, group, key, value, carry)
            kept = ~repeat
            step = np.cumsum(kept)
            # Position in (group, partition): distance from the group's first kept row.
            at = np.where(new, step, 0)
            base = np.maximum.accumulate(at)
            place = np.where(base > 0, step - base, position + step)
            position = int(place[-1])
            carry = {c: table[c][table.num_rows - 1].as_py() for c in order}
            chosen = pa.array(kept)
            out = [pc.filter(batch.column(batch.schema.get_field_index(c)), chosen) for c in group]
            out.append(pc.filter(batch.column(batch.schema.get_field_index(value)).cast(pa.float64()), chosen))
            out += [pa.array(np.full(int(kept.sum()), pid, np.int32)), pa.array(place[kept].astype(np.int64))]
            yield pa.RecordBatch.from_arrays(out, names=[f.name for f in schema.fields])

    # Equal keys share a range partition, so repeats never straddle two partitions.
    placed = cut(ranged.mapInArrow(number, schema))
    counts = placed.groupBy(*group, "_pid").agg((F.max("_pos") + 1).alias("_n"))
    within = Window.partitionBy(*group)
    before = within.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    # One row for each group and partition it touches: groups + partitions at most.
    offsets = counts.select(*group, "_pid", "_n", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_from"), F.sum("_n").over(within).alias("n"))
    wanted = offsets.withColumn("quantile", F.explode(F.array(*[F.lit(float(q)) for q in quantiles])))
    rank = F.col("quantile") * (F.col("n") - 1)
    wanted = wanted.withColumn("_low", F.floor(rank)).withColumn("_part", rank - F.floor(rank))
    wanted = wanted.withColumn("_side", F.explode(F.array(F.lit(0), F.lit(1))))
    target = F.least(F.col("_low") + F.col("_side"), F.col("n") - 1) - F.col("_from")
    wanted = wanted.withColumn("_pos", target).where((F.col("_pos") >= 0) & (F.col("_pos") < F.col("_n")))
    keys = [*group, "_pid", "_pos"]
    wanted = cut(wanted.select(*[F.col(c).alias(f"_w{c}") for c in keys], "n", "quantile", "_side", "_part"))
    condition = F.lit(True)
    for c in keys:
        condition = condition & F.col(c).eqNullSafe(F.col(f"_w{c}"))
    # Two rows for each group and percentile: as long as these are few, the sorted rows stay where they are.
    near = F.broadcast(wanted) if wanted.count() <= BROADCAST_ROWS else wanted
    found = placed.join(near, condition).select(*group, "n", "quantile", "_side", "_part", "_value")
    out = found.groupBy(*group, "n", "quantile").agg(
        F.max(F.when(F.col("_side") == 0, F.col("_value"))).alias("_a"), F.max(F.when(F.col("_side") == 1, F.col("_value"))).alias("_b"), F.max("_part").alias("_part")
    )
    return out.select(*group, "n", "quantile", (F.col("_a") + (F.col("_b") - F.col("_a")) * F.col("_part")).alias("percentile"))


def summaries(df: DataFrame, group: list[str], value: str, error: float = 0.01) -> DataFrame:
    """Mergeable summary: counts by group and bucket of usable values.

    Bucket b > -2^31 holds values in (g^(b-1), g^b] with g = (1+error)/(1-error);
    zeros have the bucket null.  Adding up the counts of two summaries gives
    the summary of the union, whatever the split into shards or days.
    """
    g = math.log((1 + error) / (1 - error))
    bucket = F.when(F.col(value) > 0, F.ceil(F.log(F.col(value).cast("double")) / F.lit(g)).cast("int"))
    return df.where(usable(value)).groupBy(*group, bucket.alias("bucket")).agg(F.count("*").alias("count"))


def merge(parts: DataFrame, group: list[str]) -> DataFrame:
    """The summary by ``group`` from summaries by a finer grouping."""
    return parts.groupBy(*group, "bucket").agg(F.sum("count").alias("count"))


def read_summary(summary: DataFrame, group: list[str], quantiles: list[float], error: float = 0.01) -> DataFrame:
    """Percentiles of a summary: the relative error is at most ``error`` for the order statistic at the rank."""
    g = (1 + error) / (1 - error)
    within = Window.partitionBy(*group)
    running = within.orderBy(F.col("bucket").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, 0)
    rows = summary.select(*group, "bucket", "count", F.sum("count").over(running).alias("_upto"), F.sum("count").over(within).alias("n"))
    rows = rows.withColumn("quantile", F.explode(F.array(*[F.lit(float(q)) for q in quantiles])))
    at = F.floor(F.col("quantile") * (F.col("n") - 1)) + 1
    hit = rows.where((F.col("_upto") >= at) & (F.col("_upto") - F.col("count") < at))
    middle = F.coalesce(F.pow(F.lit(g), F.col("bucket")) * 2 / (1 + g), F.lit(0.0))
    return hit.select(*group, "n", "quantile", middle.alias("percentile"))
