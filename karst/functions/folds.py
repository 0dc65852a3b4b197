"""Ordered folds over rows of a key, one row at a time in memory."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import StructType

OUT_ROWS = 4096


def ordered_fold(df: DataFrame, keys: list[str], order: list[str], schema: StructType | str, start: Callable[[tuple], Any], step: Callable[[Any, dict], tuple[Any, Iterable[tuple]]], finish: Callable[[tuple, Any], Iterable[tuple]] = lambda _k, _s: ()) -> DataFrame:
    """Rows put out by ``step`` (state, row) -> (state, rows) along ``order`` within ``keys``, and by ``finish`` at the end of each key.

    For what depends on its predecessor and so can't be split within a key. Rows are sorted by the shuffle and stream
    through; a key is neither collected nor grouped, so a long one costs its time in one task but no memory.
    """
    spark = df.sparkSession
    kind = spark.createDataFrame([], schema).schema if isinstance(schema, str) else schema
    sorted_ = df.repartition(*keys).sortWithinPartitions(*keys, *order)
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(kind)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state, out = None, None, []

        def flush() -> pa.RecordBatch:
            b = pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], f.type) for i, f in enumerate(arrow)], schema=arrow)
            out.clear()
            return b

        for b in batches:
            for row in b.to_pylist():
                k = tuple(row[c] for c in keys)
                if k != key:
                    if key is not None:
                        out.extend(finish(key, state))
                    key, state = k, start(k)
                state, rows = step(state, row)
                out.extend(rows)
                if len(out) >= OUT_ROWS:
                    yield flush()
        if key is not None:
            out.extend(finish(key, state))
        if out:
            yield flush()

    return sorted_.mapInArrow(work, kind)
