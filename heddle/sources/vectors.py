"""Vectors in the stored JSON of entries, by Spark expressions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The stored vector where it is written as an array of 64 numbers; the same in SQL.
VECTOR_SQL = "CASE WHEN json_valid(json_data) AND json_type(json_data, '$.vector') = 'ARRAY' AND json_array_length(json_data, '$.vector') = 64 THEN TRY_CAST(json_extract(json_data, '$.vector') AS DOUBLE[]) END"


def read_vector(df: DataFrame, key: str, body: str) -> DataFrame:
    """(key, vector) of stored vectors that are arrays of 64 numbers.

    Vectors in the binary form are read by the training operators; they give
    no row here.
    """
    text = F.get_json_object(body, "$.vector")
    vector = F.when(text.startswith("["), F.from_json(text, "array<double>"))
    rows = df.where(F.try_parse_json(body).isNotNull()).select(key, vector.alias("vector"))
    return rows.where((F.size("vector") == 64) & ~F.exists("vector", lambda x: x.isNull()))
