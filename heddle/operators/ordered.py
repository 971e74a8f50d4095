"""Order-dependent work on range-partitioned data, without one task per group."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from heddle.session import cut, partitions


def range_sorted(df: DataFrame, keys: list[str], pid: str = "_pid") -> DataFrame:
    """``df`` in one global order: partition number first, then row order.

    Range bounds fall inside large groups too, so a group that holds a third
    of all rows is spread over a third of the partitions.  The result is
    written once, so that all later reads see the same partitions.
    """
    n = partitions(df.sparkSession)
    ranged = df.repartitionByRange(n, *[F.col(k).asc_nulls_first() for k in keys])
    ranged = ranged.sortWithinPartitions(*[F.col(k).asc_nulls_first() for k in keys])
    return cut(ranged.withColumn(pid, F.spark_partition_id()))


def previous_row(df: DataFrame, group: list[str], order: list[str], values: list[str], prefix: str = "prev_") -> DataFrame:
    """Each row with ``values`` of the row just before it in its group.

    Same result as ``lag(value) over (partition by group order by order)``,
    nulls first, but a group's rows need not fit one task: rows are range
    partitioned by (group, order), shifted inside each partition, and only the
    last row of each partition travels to the next one.  Nulls in a group
    column form a group of their own.  The first row of a group gets nulls.
    ``order`` should be a total order inside a group; ties come out in any order.
    """
    keys = [*group, *order]
    ranged = range_sorted(df, keys)
    carried = [*group, *values]
    fields = list(ranged.schema.fields)
    by_name = {f.name: f for f in fields}
    shifted_fields = [T.StructField(f"_p_{c}", by_name[c].dataType) for c in carried]
    schema = T.StructType([*fields, *shifted_fields, T.StructField("_first", T.BooleanType()), T.StructField("_last", T.BooleanType())])

    def shift(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        tail: pa.Table | None = None

        def out(current: pa.Table, before: pa.Table | None, last: bool) -> list[pa.RecordBatch]:
            n = current.num_rows
            columns = {name: current[name] for name in current.column_names}
            for c in carried:
                kind = current[c].type
                head = before[c] if before is not None else pa.chunked_array([pa.nulls(1, kind)])
                columns[f"_p_{c}"] = pa.chunked_array([*head.chunks, *current[c].slice(0, n - 1).chunks], type=kind).combine_chunks()
            columns["_first"] = pa.array([before is None] + [False] * (n - 1))
            columns["_last"] = pa.array([False] * (n - 1) + [last])
            return pa.table(columns).combine_chunks().to_batches()

        for batch in batches:
            if not batch.num_rows:
                continue
            if held is not None:
                yield from out(held, tail, False)
                tail = held.slice(held.num_rows - 1, 1)
            held = pa.Table.from_batches([batch])
        if held is not None:
            yield from out(held, tail, True)

    shifted = ranged.mapInArrow(shift, schema)
    # One row for each partition: bounded by the number of partitions.
    edges = shifted.where(F.col("_first") | F.col("_last"))
    tails = edges.groupBy("_pid").agg(*[F.max(F.when(F.col("_last"), F.struct(F.col(c)))).getField(c).alias(f"_t_{c}") for c in carried])
    before = Window.orderBy("_pid")
    links = tails.select("_pid", *[F.lag(f"_t_{c}").over(before).alias(f"_b_{c}") for c in carried])
    joined = shifted.join(F.broadcast(links), "_pid", "left")
    pick = lambda c: F.when(F.col("_first"), F.col(f"_b_{c}")).otherwise(F.col(f"_p_{c}"))
    same = F.lit(True)
    for g in group:
        same = same & pick(g).eqNullSafe(F.col(g))
    # The very first row has no row before it: all of its _b_ columns are null.
    return joined.select(*[F.col(c) for c in df.columns], *[F.when(same, pick(v)).alias(f"{prefix}{v}") for v in values])


def exact_percentiles(df: DataFrame, group: list[str], value: str, quantiles: list[float]) -> DataFrame:
    """(group, n, quantile, percentile): exact percentiles, interpolated between ranks, of groups of any size.

    One range-partitioned sort spreads even a single group over all tasks;
    counts by group and partition tell where each wanted rank lies, and only
    those rows are looked up.  Null and NaN values take no part.
    """
    kept = df.where(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double"))).select(*group, F.col(value).cast("double").alias("_v"))
    rows = range_sorted(kept, [*group, "_v"]).withColumn("_at", F.monotonically_increasing_id())
    counts = rows.groupBy(*group, "_pid").agg(F.min("_at").alias("_first"), F.count("*").alias("_c"))
    within = Window.partitionBy(*group)
    before = F.coalesce(F.sum("_c").over(within.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = counts.select(*group, "_first", "_c", before.alias("_from"), F.sum("_c").over(within).alias("n"))
    wanted = offsets.withColumn("quantile", F.explode(F.array(*[F.lit(float(q)) for q in quantiles])))
    wanted = wanted.withColumn("_rank", F.col("quantile") * (F.col("n") - 1)).withColumn("_side", F.explode(F.array(F.lit(0), F.lit(1))))
    target = F.least(F.floor("_rank") + F.col("_side"), F.col("n") - 1) - F.col("_from")
    wanted = wanted.withColumn("_target", target).where((F.col("_target") >= 0) & (F.col("_target") < F.col("_c")))
    wanted = wanted.select(*group, "n", "quantile", "_side", (F.col("_rank") - F.floor("_rank")).alias("_part"), (F.col("_first") + F.col("_target")).alias("_at"))
    found = wanted.join(rows.select("_at", "_v"), "_at").groupBy(*group, "n", "quantile").agg(F.max(F.when(F.col("_side") == 0, F.col("_v"))).alias("_a"), F.max(F.when(F.col("_side") == 1, F.col("_v"))).alias("_b"), F.max("_part").alias("_part"))
    return found.select(*group, "n", "quantile", (F.col("_a") + (F.col("_b") - F.col("_a")) * F.col("_part")).alias("percentile"))
