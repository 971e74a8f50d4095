"""Models that a caller brings: embedders, re-rankers, generators and token counters over Arrow batches.

A model is built on the worker by a function without arguments, once in a
task, so that weights never travel with the plan; it sees whole batches.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

Embedder = Callable[[Sequence[str]], Sequence[Sequence[float]]]
Reranker = Callable[[Sequence[str], Sequence[str]], Sequence[float]]
Generator = Callable[[Sequence[str]], Sequence[str]]
Counter = Callable[[Sequence[str]], Sequence[int]]


def _apply(df: DataFrame, inputs: list[str], name: str, kind: T.DataType, arrow: pa.DataType, build: Callable[[], Callable]) -> DataFrame:
    kept = [f for f in df.schema.fields if f.name != name]
    schema = T.StructType([*kept, T.StructField(name, kind)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = None
        for batch in batches:
            model = model or build()
            columns = [batch.column(batch.schema.get_field_index(c)).to_pylist() for c in inputs]
            whole = [i for i, row in enumerate(zip(*columns, strict=True)) if all(v is not None for v in row)]
            out: list = [None] * batch.num_rows
            if whole:
                for i, v in zip(whole, model(*[[c[i] for i in whole] for c in columns]), strict=True):
                    out[i] = v
            yield pa.RecordBatch.from_arrays([*[batch.column(batch.schema.get_field_index(f.name)) for f in kept], pa.array(out, arrow)], names=[f.name for f in schema.fields])

    return df.mapInArrow(run, schema)


def embed(df: DataFrame, text: str, build: Callable[[], Embedder], name: str = "vector") -> DataFrame:
    """``df`` with the model's vector of each text; null for null texts."""
    return _apply(df, [text], name, T.ArrayType(T.DoubleType()), pa.list_(pa.float64()), build)


def rerank(df: DataFrame, query: str, text: str, build: Callable[[], Reranker], name: str = "score") -> DataFrame:
    """``df`` with the model's score of each pair of query and text; null where either is null."""
    return _apply(df, [query, text], name, T.DoubleType(), pa.float64(), build)


def generate(df: DataFrame, prompt: str, build: Callable[[], Generator], name: str = "answer") -> DataFrame:
    """``df`` with the model's answer to each prompt; null for null prompts."""
    return _apply(df, [prompt], name, T.StringType(), pa.string(), build)


def count_tokens(df: DataFrame, text: str, build: Callable[[], Counter], name: str = "tokens") -> DataFrame:
    """``df`` with the tokens of each text by the caller's counter; null for null texts."""
    return _apply(df, [text], name, T.LongType(), pa.int64(), build)
