"""Folds over sorted rows: a state that goes from row to row within a key."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import LongType, StructField, StructType


def folded(rows: DataFrame, keys: list[str], order: list[str], inputs: list[str], column: str, start: Callable[[], list], step: Callable[..., int]) -> DataFrame:
    """``rows`` with a column more: what ``step(state, *inputs)`` gives for each row in order, the state beginning anew at each key.

    Spark sorts a partition, and spills, and Python reads it batch by batch, so a key of any length takes the memory of
    its state and time in proportion to its rows.
    """
    placed = rows.repartition(*keys).sortWithinPartitions(*keys, *order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, state = None, start()
        for batch in batches:
            found = zip(*(batch.column(k).to_pylist() for k in keys), strict=True)
            given = zip(*(batch.column(i).to_pylist() for i in inputs), strict=True)
            out = []
            for key, values in zip(found, given, strict=True):
                if key != at:
                    at, state = key, start()
                out.append(step(state, *values))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.int64())], names=[*batch.schema.names, column])

    return placed.mapInArrow(run, StructType([*placed.schema, StructField(column, LongType())]))
