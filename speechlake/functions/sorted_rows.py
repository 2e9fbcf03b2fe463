"""Rows of a key one after the other: a task reads its keys' rows in order, so a fold holds a batch of them and its own state, not a table of all."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import pairwise
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

MOST = 10_000  # rows of a batch that is handed on


def by_key(rows: DataFrame, key: str, *order: str | Column) -> DataFrame:
    """All rows of a key in one partition, one key after the other, each in the given order. Spark sorts, and spills where it must."""
    return rows.repartition(key).sortWithinPartitions(key, *order)


def _edges(keys: list[Any]) -> list[int]:
    # a key that isn't a number (NaN) is equal to its like
    return [0, *(i for i in range(1, len(keys)) if keys[i] != keys[i - 1] and (keys[i] == keys[i] or keys[i - 1] == keys[i - 1])), len(keys)]


def stretches(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[bool, list[list[Any]]]]:
    """Batches of ``by_key``, the key first, as stretches of one key: (whether the key is a new one, a list of values for each column)."""
    last: list[Any] = []
    for batch in batches:
        columns = [c.to_pylist() for c in batch.columns]
        for a, b in pairwise(_edges(columns[0])) if len(columns[0]) else ():
            yield not last or len(_edges([last[0], columns[0][a]])) > 2, [c[a:b] for c in columns]
            last = [columns[0][a]]


def groups(batches: Iterable[pa.RecordBatch]) -> Iterator[list[list[Any]]]:
    """All values of a key: a list for each column."""
    held: list[list[Any]] = []
    for new, columns in stretches(batches):
        if new and held:
            yield held
        held = columns if new or not held else [a + b for a, b in zip(held, columns, strict=True)]
    if held:
        yield held


def arrow_schema(out: str) -> pa.Schema:
    """The columns that ``out`` (DDL) names; it needs a session, so it is made before a task runs."""
    return to_arrow_schema(T.StructType.fromDDL(out))


def arrow(rows: Iterable[tuple[Any, ...]], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Rows as batches."""
    held: list[tuple[Any, ...]] = []

    def batch() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)

    for row in rows:
        held.append(row)
        if len(held) >= MOST:
            yield batch()
            held = []
    if held:
        yield batch()
