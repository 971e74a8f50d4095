"""Rescue-column ingestion of JSON files whose fields drift.

``ingest`` reads every file into one fixed table: fields of the target schema
land in typed columns, everything else (unknown fields, values that cannot be
cast) is kept as JSON in ``_rescued``.  ``drift_report`` tells the fields of a
file from its typed columns and its rescued paths, and compares them with
those of the file before it.  ``proposals`` reads from the report which fields
are later or earlier names of a target field; ``promote`` moves approved ones
out of the rescue column into a typed column and replays the values kept so
far.

Paths join keys with ``.`` and mark an array of objects with ``[]``.  In the
rescue column a dot, bracket or backslash inside a key has a backslash before
it, so that paths of different fields never meet; reports write keys plainly.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from heddle.operators.ordered import previous_row
from heddle.session import cut

#: How target types are written in a schema given to ``ingest``.
KINDS = {
    "string": T.StringType(),
    "double": T.DoubleType(),
    "long": T.LongType(),
    "boolean": T.BooleanType(),
    "strings": T.ArrayType(T.StringType()),
    "doubles": T.ArrayType(T.DoubleType()),
}


def _reject(name: str) -> None:
    raise ValueError(f"{name} is no JSON")


def parse(body: str | None) -> dict | None:
    """The JSON object in ``body``, or None where it is null, cut off or no object.

    A leading byte-order mark is skipped.  NaN and Infinity are no JSON.
    """
    if body is None:
        return None
    try:
        value = json.loads(body.removeprefix("﻿"), parse_constant=_reject)
    except (ValueError, RecursionError):
        return None
    return value if isinstance(value, dict) else None


def json_type(value: object) -> str:
    """number, string, boolean, object, array or null."""
    if value is None:
        return "null"
    if isinstance(value, bool):
        return "boolean"
    if isinstance(value, (int, float)):
        return "number"
    if isinstance(value, str):
        return "string"
    return "object" if isinstance(value, dict) else "array"


_SPECIAL = re.compile(r"[.\[\\]")
_ESCAPED = re.compile(r"\\(.)")
_DOT = re.compile(r"(?<!\\)(?:\\\\)*\.")


def leaves(record: dict) -> dict[str, list]:
    """The values of every leaf by path, in file order.

    Leaves are all values but objects with keys and arrays that hold an
    object.  Other members of such an array, and objects without keys in it,
    are kept under the array's path with ``[]``.
    """
    found: dict[str, list] = {}
    stack: list[tuple[str, dict]] = [("", record)]
    while stack:
        prefix, node = stack.pop()
        below: list[tuple[str, dict]] = []
        for key, value in node.items():
            path = prefix + (_SPECIAL.sub(r"\\\g<0>", key) if _SPECIAL.search(key) else key)
            if isinstance(value, dict) and value:
                below.append((path + ".", value))
            elif isinstance(value, list) and any(isinstance(x, dict) for x in value):
                for x in value:
                    if isinstance(x, dict) and x:
                        below.append((path + "[].", x))
                    else:
                        found.setdefault(path + "[]", []).append(x)
            else:
                found.setdefault(path, []).append(value)
        stack.extend(reversed(below))
    return found


def _steps(path: str) -> list[str]:
    """The segments of a path, still escaped."""
    if "\\" not in path:
        return path.split(".")
    out, start = [], 0
    for m in _DOT.finditer(path):
        out.append(path[start : m.end() - 1])
        start = m.end()
    return [*out, path[start:]]


_ABOVE: dict[str, list[tuple[str, str]]] = {}


def _above(path: str) -> list[tuple[str, str]]:
    """The fields that a leaf lies in, with their JSON types."""
    if path not in _ABOVE:
        if len(_ABOVE) > 1 << 16:
            _ABOVE.clear()
        steps, out = _steps(path), []
        for i, step in enumerate(steps):
            array = step.endswith("[]")
            if i < len(steps) - 1 or array:
                out.append((".".join(steps[: i + 1]).removesuffix("[]"), "array" if array else "object"))
        _ABOVE[path] = out
    return _ABOVE[path]


def field_types(types: dict[str, set[str]]) -> list[str]:
    """All fields as ``path TAB types``, in order, from the JSON types of the leaves."""
    out: dict[str, set[str]] = {}
    for path, kinds in types.items():
        for field, kind in _above(path):
            out.setdefault(field, set()).add(kind)
        if not path.endswith("[]"):
            out.setdefault(path, set()).update(kinds)
    return sorted(f"{path}\t{'|'.join(sorted(kinds))}" for path, kinds in out.items())


def cast(found: list, kind: str) -> tuple[object, bool]:
    """The value of a target column and whether all of ``found`` could be cast."""
    many = kind in ("strings", "doubles")
    if not many and len(found) > 1:
        return None, False
    out: list = []
    for value in found:
        if value is None:
            out.append(None)
        elif kind in ("string", "strings") and isinstance(value, str):
            out.append(value)
        elif kind == "boolean" and isinstance(value, bool):
            out.append(value)
        elif kind in ("double", "doubles", "long") and not isinstance(value, (dict, list, bool)):
            try:
                number = float(value)
                out.append(int(value) if kind == "long" else number)
            except (ValueError, OverflowError):
                return None, False
        else:
            return None, False
    if kind == "long" and out and out[0] is not None and not -(2**63) <= out[0] < 2**63:
        return None, False
    return (out if many else out[0]), True


#: The JSON type of a kind's values where no note says otherwise.
PLAIN = {"string": "string", "strings": "string", "double": "number", "doubles": "number", "long": "number", "boolean": "boolean"}


def ingest(df: DataFrame, body: str, target: dict[str, tuple[str, str]]) -> DataFrame:
    """One row for each row of ``df``, with the fields of ``target`` as typed columns.

    ``target`` maps a column to (path, kind); kinds are the keys of ``KINDS``.
    Added columns:

    * the target columns; null where the field is absent, null or uncastable;
    * ``_parsed``: whether the file is a JSON object (else all of it is null);
    * ``_rescued``: JSON object from path to the list of values that no typed
      column holds; null where nothing was rescued;
    * ``_notes``: JSON object from the path of a typed field to the JSON types
      it had, where the typed column does not tell them: null, or cast from
      another type; null where there is nothing to note.

    Columns of ``df`` that have the name of an added column are replaced.
    """
    names = [*target, "_parsed", "_rescued", "_notes"]
    kept = [f for f in df.schema.fields if f.name not in names and f.name != body]
    added = [T.StructField(c, KINDS[kind], True, {"path": path, "kind": kind}) for c, (path, kind) in target.items()]
    added += [T.StructField("_parsed", T.BooleanType()), T.StructField("_rescued", T.StringType()), T.StructField("_notes", T.StringType())]
    schema = T.StructType([*kept, *added])
    wanted = {path: (c, kind) for c, (path, kind) in target.items()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrow = {f.name: _arrow(f.dataType) for f in added}
        for batch in batches:
            rows: dict[str, list] = {f.name: [] for f in added}
            for text in batch.column(batch.schema.get_field_index("_body")).to_pylist():
                record = parse(text)
                row: dict[str, object] = dict.fromkeys(rows)
                row["_parsed"] = record is not None
                if record is not None:
                    rescued, notes = {}, {}
                    for path, found in leaves(record).items():
                        column, kind = wanted.get(path, (None, ""))
                        if column is not None:
                            value, ok = cast(found, kind)
                            if ok:
                                row[column] = value
                                types = {json_type(x) for x in found}
                                if types != {PLAIN[kind]}:
                                    notes[path] = "|".join(sorted(types))
                                continue
                        rescued[path] = found
                    row["_rescued"] = json.dumps(rescued, ensure_ascii=False) if rescued else None
                    row["_notes"] = json.dumps(notes, ensure_ascii=False) if notes else None
                for c, v in row.items():
                    rows[c].append(v)
            columns = [batch.column(batch.schema.get_field_index(f.name)) for f in kept]
            columns += [pa.array(rows[f.name], arrow[f.name]) for f in added]
            yield pa.RecordBatch.from_arrays(columns, names=[f.name for f in schema.fields])

    return df.select(*[F.col(f"`{f.name}`") for f in kept], F.col(f"`{body}`").alias("_body")).mapInArrow(run, schema)


def _arrow(kind: T.DataType) -> pa.DataType:
    if isinstance(kind, T.ArrayType):
        return pa.list_(_arrow(kind.elementType))
    return {T.StringType: pa.string(), T.DoubleType: pa.float64(), T.LongType: pa.int64(), T.BooleanType: pa.bool_()}[type(kind)]


def promote(df: DataFrame, column: str, paths: list[str], kind: str) -> DataFrame:
    """Make approved rescued fields the typed column ``column``.

    The first of ``paths`` that has a castable value wins (so renamed fields
    land in one column).  Values already in ``column`` are kept.  Values that
    can be cast leave ``_rescued``; values that cannot stay there.
    """
    typed = T.StructType([T.StructField("value", KINDS[kind]), T.StructField("rescued", T.StringType())])
    kept = [f for f in df.schema.fields if f.name not in (column, "_rescued")]
    had = column in df.columns
    schema = T.StructType([*kept, T.StructField("_replayed", typed)] + ([T.StructField(column, df.schema[column].dataType)] if had else []))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        struct = pa.struct([("value", _arrow(KINDS[kind])), ("rescued", pa.string())])
        for batch in batches:
            out = []
            for text in batch.column(batch.schema.get_field_index("_rescued")).to_pylist():
                rescued = json.loads(text) if text else {}
                chosen = None
                for path in paths:
                    if path in rescued:
                        value, ok = cast(rescued[path], kind)
                        if ok:
                            del rescued[path]
                            chosen = value if chosen is None else chosen
                out.append({"value": chosen, "rescued": json.dumps(rescued, ensure_ascii=False) if rescued else None})
            names = [f.name for f in kept]
            columns = [batch.column(batch.schema.get_field_index(n)) for n in names] + [pa.array(out, struct)]
            if had:
                columns.append(batch.column(batch.schema.get_field_index(column)))
            yield pa.RecordBatch.from_arrays(columns, names=[f.name for f in schema.fields])

    replayed = df.mapInArrow(run, schema)
    value = F.col("_replayed.value")
    value = F.coalesce(F.col(column), value) if had else value
    return replayed.select(*[F.col(f"`{f.name}`") for f in kept], value.alias(column), F.col("_replayed.rescued").alias("_rescued"))


def _tree(fields: list[str]) -> dict[str, dict[str, frozenset[str]]]:
    """Fields by level: prefix -> name -> JSON types without null."""
    levels: dict[str, dict[str, frozenset[str]]] = {}
    for line in fields:
        path, _, kinds = line.rpartition("\t")
        *above, name = _steps(path)
        levels.setdefault(".".join(above), {})[name] = frozenset(kinds.split("|")) - {"null"}
    return levels


def compare(before: list[str], after: list[str]) -> list[tuple[str, str, str | None]]:
    """The changes between two lists of fields, as (path, kind, path before a renaming).

    Null fits every type.  At one level a field gone and a field new with the
    same type are one renaming; a field that was only null may pair with any
    type, after the exact pairs.  Nothing below a changed field is listed.
    """
    old, new = _tree(before), _tree(after)
    changes: list[tuple[str, str, str | None]] = []
    stack = [""]
    while stack:
        prefix = stack.pop()
        left, right = old.get(prefix, {}), new.get(prefix, {})
        name = lambda key, prefix=prefix: f"{prefix}.{key}" if prefix else key
        gone, come = sorted(left.keys() - right.keys()), sorted(right.keys() - left.keys())
        for exact in (True, False):
            for key in list(come):
                for other in list(gone):
                    same = left[other] == right[key] if exact else not (left[other] and right[key])
                    if same and (exact is False or left[other]):
                        changes.append((name(key), "renamed", name(other)))
                        gone.remove(other)
                        come.remove(key)
                        break
        changes += [(name(key), "added", None) for key in come] + [(name(key), "removed", None) for key in gone]
        for key in left.keys() & right.keys():
            if left[key] and right[key] and not left[key] & right[key]:
                changes.append((name(key), "type_changed", None))
                continue
            if "object" in left[key] & right[key]:
                stack.append(name(key))
            if "array" in left[key] & right[key]:
                stack.append(name(key) + "[]")
    return sorted(changes, key=lambda c: c[:2])


def inventories(ingested: DataFrame, columns: list[str]) -> DataFrame:
    """``columns`` of each parsed file with ``_signature``, a hash of its fields, and ``_fields``, their list.

    Fields are told from the typed columns (those that ``ingest`` marked), from
    ``_notes`` and from the rescued paths.  The list comes out at least once
    for each signature, not with every file.
    """
    typed = {f.name: (f.metadata["path"], f.metadata["kind"]) for f in ingested.schema.fields if "path" in f.metadata and "kind" in f.metadata}
    kept = [ingested.schema[c] for c in columns]
    schema = T.StructType([*kept, T.StructField("_signature", T.StringType()), T.StructField("_fields", T.ArrayType(T.StringType()))])
    # Of a typed column only null or not matters.
    present = [F.col(f"`{c}`").isNotNull().alias(f"_has_{i}") for i, c in enumerate(typed)]
    rows = ingested.where("_parsed").select(*[F.col(f"`{c}`") for c in columns], *present, F.col("_rescued").alias("_r"), F.col("_notes").alias("_n"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plain = [(path, {PLAIN[kind]}) for path, kind in typed.values()]
        seen: set[str] = set()
        for batch in batches:
            signatures, lists = [], []
            held = list(zip(*[c.to_pylist() for c in batch.columns[len(kept) : -2]], strict=True)) or [()] * batch.num_rows
            for has, rescued, notes in zip(held, batch.column(batch.num_columns - 2).to_pylist(), batch.column(batch.num_columns - 1).to_pylist(), strict=True):
                types = {path: kind for (path, kind), there in zip(plain, has, strict=True) if there}
                for path, kinds in (json.loads(notes) if notes else {}).items():
                    types[path] = set(kinds.split("|"))
                for path, found in (json.loads(rescued) if rescued else {}).items():
                    types[path] = {json_type(x) for x in found}
                listed = field_types(types)
                signature = hashlib.sha1("\n".join(listed).encode("utf-8", "surrogatepass")).hexdigest()
                signatures.append(signature)
                lists.append(None if signature in seen else listed)
                seen.add(signature)
                if len(seen) > 1 << 17:
                    seen.clear()
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(kept)], pa.array(signatures, pa.string()), pa.array(lists, pa.list_(pa.string()))], names=[f.name for f in schema.fields])

    return rows.mapInArrow(run, schema)


def drift_changes(ingested: DataFrame, key: str, group: list[str], order: str) -> DataFrame:
    """``drift_report`` with the name that a renamed field had before: key, field_path, change_kind, renamed_from."""
    kept = cut(inventories(ingested.where(F.col(f"`{key}`").isNotNull()), [key, *group, order]))
    files = kept.drop("_fields").dropDuplicates([key])
    chain = previous_row(files, group, [order, key], ["_signature"])
    changed = chain.where(F.col("prev__signature").isNotNull() & (F.col("prev__signature") != F.col("_signature")))
    changed = changed.select(key, F.col("prev__signature").alias("_before"), F.col("_signature").alias("_after"))
    lists = kept.where("_fields is not null").groupBy("_signature").agg(F.first("_fields").alias("_fields"))
    pairs = changed.select("_before", "_after").distinct()
    pairs = pairs.join(lists.select(F.col("_signature").alias("_before"), F.col("_fields").alias("_old")), "_before")
    pairs = pairs.join(lists.select(F.col("_signature").alias("_after"), F.col("_fields").alias("_new")), "_after")
    change = "array<struct<field_path:string,change_kind:string,renamed_from:string>>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("field_path", pa.string()), ("change_kind", pa.string()), ("renamed_from", pa.string())]))
        plain = lambda p: _ESCAPED.sub(r"\1", p) if p else p
        for batch in batches:
            found = [
                [{"field_path": plain(p), "change_kind": k, "renamed_from": plain(f)} for p, k, f in compare(a, b)]
                for a, b in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)
            ]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, kind)], names=["_before", "_after", "_changes"])

    compared = pairs.select("_before", "_after", "_old", "_new").mapInArrow(run, f"_before string, _after string, _changes {change}")
    rows = changed.join(compared, ["_before", "_after"])
    return rows.select(key, F.explode("_changes").alias("c")).select(key, "c.*")


def drift_report(ingested: DataFrame, key: str, group: list[str], order: str) -> DataFrame:
    """Every change of fields between a file and the one before it.

    ``ingested`` comes from ``ingest``, before any promotion; files that did
    not parse and rows without a key are skipped; a key delivered again counts
    once.  Files are compared inside ``group`` in the order of ``order`` (then
    of ``key``); a null group value is a group of its own and a null order
    comes first.  Output: key, field_path, change_kind.

    Only 40-character signatures are sorted; field lists are joined back for
    the distinct pairs of signatures that differ, and compared once each.
    """
    return drift_changes(ingested, key, group, order).drop("renamed_from")


def proposals(changes: DataFrame, target: dict[str, tuple[str, str]]) -> DataFrame:
    """(column, path, files): other names of target fields that some renaming of ``drift_changes`` shows, for approval.

    A field renamed to the target's path, or from it, is proposed for its column.
    """
    spark = changes.sparkSession
    wanted = F.broadcast(spark.createDataFrame([(c, p) for c, (p, _) in target.items()], "column string, own string"))
    seen = changes.where("change_kind = 'renamed'").groupBy("renamed_from", "field_path").agg(F.count("*").alias("files"))
    both = seen.select(F.col("renamed_from").alias("own"), F.col("field_path").alias("path"), "files").unionByName(seen.select(F.col("field_path").alias("own"), F.col("renamed_from").alias("path"), "files"))
    return both.join(wanted, "own").groupBy("column", "path").agg(F.sum("files").alias("files"))
