"""Folds over the ordered history of each key, in constant memory.

A fold whose step depends on the state so far cannot be split: the history of a
key goes through one task, in order, as it does in a stream.  Spark shuffles and
sorts the rows (spilling as it needs to); the task keeps the state of one key
and no rows.

The rows are dealt by a hash of their keys, not by the keys: a repartition by
columns that the rows are dealt by already (after a join on them) is left out,
and adaptive execution, which does not know what the fold relies on, may then
turn that join into a broadcast one and read its shuffle by map task.
"""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType


def folded_rows(rows: DataFrame, keys: tuple[str, ...], order: tuple[str, ...], columns: tuple[str, ...], start, step: Callable, end: Callable, out: str) -> DataFrame:
    """(keys, end(state)) of each key, state being start changed by step(state, *columns) for each of its rows in order; ``out`` names and types what end returns."""
    sorted_ = rows.select(*keys, *order, *columns).repartition(F.xxhash64(*keys)).sortWithinPartitions(*keys, *order)
    types = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    schema = StructType.fromDDL(", ".join(f"`{k}` {types[k]}" for k in keys) + f", {out}")
    arrow, n = to_arrow_schema(schema), len(keys)

    def run(batches):
        key, state = None, start
        for batch in batches:
            done = []
            for row in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if row[:n] != key:
                    if key is not None:
                        done.append((*key, *end(state)))
                    key, state = row[:n], start
                state = step(state, *row[n + len(order) :])
            if done:
                yield pa.RecordBatch.from_pylist([dict(zip(arrow.names, r, strict=True)) for r in done], schema=arrow)
        if key is not None:
            yield pa.RecordBatch.from_pylist([dict(zip(arrow.names, (*key, *end(state)), strict=True))], schema=arrow)

    return sorted_.mapInArrow(run, schema)
