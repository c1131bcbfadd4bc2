"""Small helpers of the corpus operators."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The white space that separates words, and the words themselves.
SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"

#: A side of at most this many narrow rows is broadcast; larger ones are shuffled.
BROADCAST_ROWS = 100_000


def word_count(text: Column) -> Column:
    """Number of words; null counts as empty."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def small_side(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df``, marked for broadcast if a count shows at most ``rows`` rows. Give
    it a staged table of narrow rows, so that the count costs nothing."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def without(docs: DataFrame, dropped: DataFrame, on: list[str]) -> DataFrame:
    """Rows of ``docs`` whose keys (null equals null) are not in ``dropped``."""
    d = small_side(dropped.select([F.col(c).alias(f"__drop_{c}") for c in on]))
    same = [F.col(c).eqNullSafe(F.col(f"__drop_{c}")) for c in on]
    condition = same[0]
    for s in same[1:]:
        condition &= s
    return docs.join(d, condition, "left_anti")


def chunks(batches: Iterable[pa.RecordBatch], rows: int) -> Iterator[pa.Table]:
    """Arrow batches joined to tables of about ``rows`` rows."""
    held, count = [], 0
    for b in batches:
        held.append(b)
        count += b.num_rows
        if count >= rows:
            yield pa.Table.from_batches(held)
            held, count = [], 0
    if held and count:
        yield pa.Table.from_batches(held)


def fixed_total(
    rows: DataFrame, columns: list[str], size: int, fill: Callable[[np.ndarray, pa.RecordBatch], None],
    blocks: int = 64, combine: str = "add",
) -> np.ndarray:
    """One array of ``size`` 32-bit cells, filled in every task and added up (or
    combined by ``or``) over all tasks.

    The size is fixed, whatever the input: this is how a summary of all rows
    reaches the driver. The blocks of the array are combined in parallel.
    """
    width = size // blocks

    def partial(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells, seen = np.zeros(size, np.uint32), False
        for b in batches:
            seen = True
            fill(cells, b)
        if seen:
            for i in range(blocks):
                part = cells[i * width : (i + 1) * width]
                if part.any():
                    yield pa.RecordBatch.from_pydict({"block": pa.array([i], pa.int32()), "cells": pa.array([part.tobytes()], pa.binary())})

    def merged(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            for i, c in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                part = np.frombuffer(c, np.uint32)
                if i not in sums:
                    sums[i] = part.copy()
                elif combine == "add":
                    sums[i] += part
                else:
                    sums[i] |= part
        for i, s in sums.items():
            yield pa.RecordBatch.from_pydict({"block": pa.array([i], pa.int32()), "cells": pa.array([s.tobytes()], pa.binary())})

    schema = "block int, cells binary"
    total = np.zeros(size, np.uint32)
    parts = rows.select(*columns).mapInArrow(partial, schema).repartition(blocks, "block").mapInArrow(merged, schema)
    for r in parts.collect():
        total[r.block * width : (r.block + 1) * width] = np.frombuffer(r.cells, np.uint32)
    return total
