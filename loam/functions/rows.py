"""Python functions over rows, their results handed on in pieces."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Entries of results that a task's Python holds at a time. One of Spark's batches has up to
#: 10,000 rows, and so any number of entries.
PIECE = 20_000


def pieces(results: Iterator, kind: pa.DataType, weight: Callable = len, piece: int = PIECE) -> Iterator[pa.Array]:
    """Results (or None) as Arrow arrays, each of `piece` entries and one result at most."""
    held, size = [], 0
    for result in results:
        held.append(result)
        size += 1 + (weight(result) if result is not None else 0)
        if size >= piece:
            yield pa.array(held, kind)
            held, size = [], 0
    if held:
        yield pa.array(held, kind)


def by_rows(function: Callable, ddl: str, kind: pa.DataType, *columns, weight: Callable = len) -> Column:
    """function() of the columns' values, row by row. kind: the Arrow type of the DDL; weight:
    the entries of a result."""

    def of_one(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield from pieces((function(x.as_py()) for x in batch), kind, weight)

    def of_many(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
        for batch in batches:
            yield from pieces((function(*(x.as_py() for x in row)) for row in zip(*batch, strict=True)), kind, weight)

    return F.arrow_udf(of_one if len(columns) == 1 else of_many, ddl)(*columns)
