"""Append-only journals, keyed documents and JSON lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def quoted(text: Column) -> Column:
    """A JSON string; null stays null."""
    listed = F.to_json(F.array(text))
    return F.when(text.isNotNull(), F.substring(listed, F.lit(2), F.length(listed) - 2))


def sealed(rows: DataFrame) -> DataFrame:
    """``rows`` with ``checksum``, the digest of all other columns."""
    return rows.withColumn("checksum", F.sha2(F.to_json(F.struct(*rows.columns)), 256))


def replay(snapshot: DataFrame, journal: DataFrame, key: str, seq: str, op: str) -> DataFrame:
    """The rows of ``snapshot`` after ``journal`` (from ``sealed``) was applied in order of ``seq``.

    A put replaces the row of its key, a delete removes it; only the last
    whole record of a key decides, so one aggregation does it, whatever the
    journal's length.  Records whose checksum does not fit (torn writes) are
    left out; records up to the snapshot's own ``seq`` of a key change
    nothing, so a journal may be replayed again.
    """
    columns = [c for c in journal.columns if c != "checksum"]
    whole = journal.where(F.col("checksum") == F.sha2(F.to_json(F.struct(*columns)), 256)).select(*columns)
    both = snapshot.select(*columns).unionByName(whole)
    last = both.where(F.col(key).isNotNull()).groupBy(key).agg(F.max_by(F.struct(*[c for c in columns if c != key]), F.col(seq)).alias("_r"))
    return last.select(key, "_r.*").where(F.col(op) == "put")


def digests(items: DataFrame, key: str, item: str) -> DataFrame:
    """(key, items, digest): how many items each document has, and the digest of their ordered lines."""
    listed = F.array_join(F.array_sort(F.collect_list(item)), "\n")
    return items.groupBy(key).agg(F.count("*").alias("items"), F.sha2(listed, 256).alias("digest"))


def json_lines(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, line_no, line, outcome): lines of a text, numbered from 1; ``ok`` for a JSON object, else ``error``. Blank lines are skipped."""
    lines = df.select(key, F.posexplode(F.split(F.col(text), "\n")).alias("_at", "line")).where(F.trim(F.regexp_replace("line", "[\\t\\r]", " ")) != "")
    whole = F.try_parse_json("line").isNotNull() & F.col("line").rlike(r"^\s*\{")
    return lines.select(key, (F.col("_at") + 1).alias("line_no"), "line", F.when(whole, "ok").otherwise("error").alias("outcome"))
