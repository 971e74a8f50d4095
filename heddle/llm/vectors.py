"""Decoding of stored vectors into fixed-width rows."""

from __future__ import annotations

import base64
import binascii
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def decode(text: str | None, dim: int) -> np.ndarray | None:
    """The unit vector stored in ``text``, or None where it is unusable.

    Stored forms are base64 of little-endian float32 and a JSON number array.
    Unusable are unreadable text, another length than ``dim``, members that
    are not finite numbers, and the zero vector.
    """
    if not text:
        return None
    text = text.strip()
    if text.startswith("["):
        try:
            items = json.loads(text)
        except ValueError:
            return None
        if len(items) != dim or any(isinstance(x, bool) or not isinstance(x, (int, float)) for x in items):
            return None
        vector = np.array(items, np.float64)
    else:
        try:
            raw = base64.b64decode(text, validate=True)
        except (binascii.Error, ValueError):
            return None
        if len(raw) != 4 * dim:
            return None
        vector = np.frombuffer(raw, "<f4").astype(np.float64)
    if not np.isfinite(vector).all():
        return None
    top = np.abs(vector).max()
    if top == 0:
        return None
    vector = vector / top
    return vector / np.sqrt(vector @ vector)


def read_vectors(df: DataFrame, key: str, body: str, dim: int = 64) -> DataFrame:
    """(id, vec): unit vectors as ``dim`` little-endian float32, unusable ones left out.

    ``body`` is the stored JSON of an entry with the field ``vector``.
    """
    text = F.get_json_object(F.col(body), "$.vector")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [decode(t, dim) for t in batch.column(1).to_pylist()]
            keep = pa.array([v is not None for v in found])
            data = [v.astype("<f4").tobytes() for v in found if v is not None]
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), pa.array(data, pa.binary())], names=["id", "vec"])

    rows = df.where(F.col(key).isNotNull()).select(F.col(key).cast("long").alias("id"), text.alias("text")).where("text is not null")
    return rows.mapInArrow(run, "id long, vec binary")


def matrix(column: pa.Array, dim: int) -> np.ndarray:
    """Rows of ``vec`` as a float32 matrix."""
    return np.frombuffer(b"".join(column.to_pylist()), "<f4").reshape(-1, dim)
