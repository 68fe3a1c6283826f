"""What the vector operators share: usable rows, and tasks that hold a block and read its askers as a stream.

Defined results: a row takes part if its id and its vector are there, the vector has a
component, all its components are there and finite, and it has as many of them as most rows
have (ties: the smaller number).  Rows that share an id are one: the one whose columns, in
the order given and the vector last, come first.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Component sums are bounded at this many columns taken at once.
FLOATS = 4_000_000


def usable(rows: DataFrame, id_: str, vector: str, *more: Column) -> DataFrame:
    """(id, more.., vector array<double>) of the rows that take part; more: named columns that must not be null."""
    parts = [F.col(f"`{id_}`").cast("long").alias("id"), *more, F.col(f"`{vector}`").cast("array<double>").alias("vector")]
    some = rows.select(*parts)
    names = some.columns
    finite = ~F.exists("vector", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    some = some.where((F.size("vector") > 0) & finite).dropna(subset=names)
    most = some.groupBy(F.size("vector").alias("dims")).count().orderBy(F.desc("count"), "dims").first()
    if most is None:
        return some
    some = some.where(F.size("vector") == most.dims)
    if some.groupBy("id").count().where("count > 1").isEmpty():
        return some
    rest = names[1:]
    return some.groupBy("id").agg(F.min(F.struct(*rest)).alias("row")).select("id", *[F.col("row")[c].alias(c) for c in rest])


def matrix(column: pa.Array) -> np.ndarray:
    """Rows of equally long vectors as a matrix."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def streamed(load: Callable[[list[pa.RecordBatch]], object], ask: Callable[[object, pa.RecordBatch], Iterator[pa.RecordBatch]], keys: int) -> Callable:
    """A function for mapInArrow over partitions sorted by their first columns (keys of a block), then by kind.

    Rows of kind 0 make the block: load gets all of them.  Rows of kind 1 ask it: ask gets the
    loaded block and some of them at a time, however many follow.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, parts, block = None, [], None
        for batch in batches:
            if not batch.num_rows:
                continue
            heads = np.stack([batch.column(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in range(keys + 1)], axis=1)
            edges = [0, *(np.flatnonzero((heads[1:] != heads[:-1]).any(axis=1)) + 1).tolist(), len(heads)]
            for a, b in zip(edges, edges[1:]):
                key, kind, rows = tuple(heads[a][:-1].tolist()), heads[a][-1], batch.slice(a, b - a)
                if key != at:
                    at, parts, block = key, [], None
                if kind == 0:
                    parts.append(rows)
                elif parts or block is not None:
                    if block is None:
                        block, parts = load(parts), []
                    yield from ask(block, rows)

    return run
