"""Deeply nested records to flat tables that keep parent-child links.

Lists are flattened on Arrow buffers: the list offsets give every child's
parent index and its place, and the parent's keys are carried over by one
vectorised take.  No row is visited in Python.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def unnest(df: DataFrame, column: str, keep: list[str], item: str = "item", ord: str = "ord") -> DataFrame:
    """One row for each element of the list ``column``.

    Output: the ``keep`` columns of the parent, ``ord`` (place in the list,
    from 0) and ``item`` (the element, which may be null).  A null or empty
    list gives no rows.  Elements may be of any type, lists and structs
    included, so calls can be chained down to any depth.
    """
    element = df.schema[column].dataType.elementType
    fields = [df.schema[c] for c in keep] + [T.StructField(ord, T.IntegerType()), T.StructField(item, element)]
    schema = T.StructType(fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(batch.schema.get_field_index(column))
            parents = pc.list_parent_indices(lists)
            children = pc.list_flatten(lists)
            # Place in the list: position among all children less that of the parent's first child.
            counts = pc.fill_null(pc.list_value_length(lists), 0)
            starts = pc.subtract(pc.cumulative_sum(counts), counts)
            at = pa.array(range(0), pa.int64()) if not len(children) else pc.subtract(pa.array(_iota(len(children))), pc.take(starts, parents).cast(pa.int64()))
            columns = [pc.take(batch.column(batch.schema.get_field_index(c)), parents) for c in keep]
            yield pa.RecordBatch.from_arrays([*columns, at.cast(pa.int32()), children], names=[*keep, ord, item])

    return df.select(*keep, column).mapInArrow(run, schema)


def _iota(n: int):  # noqa: ANN202
    import numpy as np

    return np.arange(n, dtype=np.int64)


def pick(entry: Column, name: str) -> Column:
    """Value of a map<string,string> whose key is ``name`` but for case and separators.

    Where several spellings are present the first one holds.
    """
    hit = F.filter(F.map_entries(entry), lambda e: (F.regexp_replace(F.lower(e["key"]), "[^a-z0-9]", "") == name) & e["value"].isNotNull())
    return F.when(F.size(hit) > 0, hit[0]["value"])


def id_list(raw: Column, depth: int = 3) -> Column:
    """The ids in a list that is written in any of several forms.

    Understood are a JSON list of strings, of objects with an ``id``, of
    lists, an object of such lists, JSON inside a string, ids separated by
    comma, semicolon, bar or white space, and a single id.  Ids are trimmed;
    null and blank ones are left out.  Null gives an empty list.
    """
    text = F.trim(raw)
    none = F.array().cast("array<string>")
    bare = F.split(F.regexp_replace(text, r'^"|"$', ""), r"[;,|\s]+")
    if depth == 0:
        found = bare
    else:
        listed = F.coalesce(F.from_json(text, "array<string>"), none)
        mapped = F.coalesce(F.from_json(text, "map<string,string>"), F.create_map().cast("map<string,string>"))
        own = F.element_at(mapped, "id")
        members = F.flatten(F.transform(F.map_values(mapped), lambda v: id_list(v, depth - 1))) if depth > 1 else none
        inner = F.flatten(F.transform(listed, lambda v: id_list(v, depth - 1)))
        found = F.when(text.startswith("["), inner).when(text.startswith("{"), F.when(own.isNotNull(), F.array(own)).otherwise(members)).otherwise(bare)
    trimmed = F.transform(found, lambda v: F.trim(v))
    return F.coalesce(F.filter(trimmed, lambda v: v.isNotNull() & (v != "")), none)


_SIDE = "struct<condition:string,taskResults:array<map<string,string>>>"
_BODY = f"baselineCondition string, baseline {_SIDE}, comparisons array<struct<condition:string,result:{_SIDE}>>"


def artifacts(df: DataFrame, key: str, body: str) -> dict[str, DataFrame]:
    """Flat tables of nested evaluation files.

    * ``conditions``: key, arm_ord, arm_name, is_baseline. The baseline comes
      first (arm_ord 0), comparisons follow in file order.
    * ``tasks``: key, arm_ord, arm_name, task_ord, task_id, fields (map).
    * ``memory_ids``: key, arm_ord, arm_name, task_ord, list_name
      (``context`` or ``cited``), id_ord, memory_id.

    A null, blank or unparsable body and missing parts give no rows; repeated
    tasks keep their own task_ord.  An arm's name is null where the file has none.
    """
    text = F.regexp_replace(F.col(f"`{body}`"), "^\\ufeff", "")
    parsed = df.select(F.col(f"`{key}`").alias("_key"), F.from_json(text, _BODY).alias("o"))
    side = lambda name, base, results: F.struct(name.alias("arm_name"), base.alias("is_baseline"), results.alias("results"))
    base = F.when(F.col("o.baseline").isNotNull(), F.array(side(F.coalesce("o.baseline.condition", "o.baselineCondition"), F.lit(True), F.col("o.baseline.taskResults"))))
    rest = F.transform("o.comparisons", lambda c: side(F.coalesce(c["condition"], c["result"]["condition"]), F.lit(False), c["result"]["taskResults"]))
    none = F.array().cast("array<struct<arm_name:string,is_baseline:boolean,results:array<map<string,string>>>>")
    arms = parsed.select("_key", F.concat(F.coalesce(base, none), F.coalesce(rest, none)).alias("arms"))
    arms = unnest(arms, "arms", ["_key"], "arm", "arm_ord").select("_key", "arm_ord", "arm.*")
    conditions = arms.select(F.col("_key").alias(key), "arm_ord", "arm_name", "is_baseline")
    tasks = unnest(arms, "results", ["_key", "arm_ord", "arm_name"], "fields", "task_ord")
    lists = tasks.select(
        "_key", "arm_ord", "arm_name", "task_ord",
        F.array(*[F.struct(F.lit(n).alias("list_name"), pick(F.col("fields"), f"{n}memoryids").alias("raw")) for n in ("context", "cited")]).alias("lists"),
    )
    lists = lists.select("_key", "arm_ord", "arm_name", "task_ord", F.explode("lists").alias("l")).where("l.raw is not null")
    lists = lists.select("_key", "arm_ord", "arm_name", "task_ord", "l.list_name", id_list(F.col("l.raw")).alias("ids"))
    ids = unnest(lists, "ids", ["_key", "arm_ord", "arm_name", "task_ord", "list_name"], "memory_id", "id_ord")
    named = lambda d: d.withColumnRenamed("_key", key)
    return {
        "conditions": conditions,
        "tasks": named(tasks.withColumn("task_id", pick(F.col("fields"), "taskid"))).select(key, "arm_ord", "arm_name", "task_ord", "task_id", "fields"),
        "memory_ids": named(ids),
    }
