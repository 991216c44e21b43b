"""Walks over the rows of a key in order, where what was taken before decides what comes next: one Arrow pass over a sorted
partition, without a frame for each key."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

#: Rows of a batch that a walk puts out.
ROWS = 10_000


def sorted_by(rows: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """Rows of a key in one partition, side by side and in order."""
    return rows.repartition(*key).sortWithinPartitions(*key, *order)


def walked(rows: DataFrame, key: list[str], order: list[str], walk: Callable[[list[tuple]], Iterator[tuple]], schema: str) -> DataFrame:
    """The rows that ``walk`` makes of each key's rows, given as tuples in order; ``key`` are the first columns of ``rows``."""
    form = to_arrow_schema(StructType.fromDDL(schema))

    def batch(out: list[tuple]) -> pa.RecordBatch:
        columns = zip(*out, strict=True) if out else [()] * len(form)
        return pa.record_batch([pa.array(list(c), f.type) for c, f in zip(columns, form, strict=True)], schema=form)

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        every = (row for b in source for row in zip(*(c.to_pylist() for c in b.columns), strict=True))
        for _, group in groupby(every, lambda row: row[: len(key)]):
            out += walk(list(group))
            if len(out) >= ROWS:
                yield batch(out)
                out = []
        yield batch(out)

    return sorted_by(rows, key, order).mapInArrow(run, schema)
