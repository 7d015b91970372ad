"""Count vectors of a fixed length, summed over all tasks, and bounded samples of labelled rows."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Counters in one piece of a vector.
PIECE = 1 << 14
SCHEMA = "slot string, piece int, counts binary"


def emit(vectors: dict[str | None, np.ndarray]) -> Iterator[pa.RecordBatch]:
    """A task's vectors in pieces."""
    rows = [(k, i, v[i * PIECE : (i + 1) * PIECE].astype(np.int64)) for k, v in vectors.items() for i in range(-(-len(v) // PIECE))]
    rows = [(k, i, x.tobytes()) for k, i, x in rows if x.any()]
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2] for r in rows], pa.binary())], names=["slot", "piece", "counts"])


def summed(df: DataFrame, count: Callable, length: int, few: bool = False) -> dict[str | None, np.ndarray]:
    """Runs ``count`` (mapInArrow, emitting by ``emit``) over ``df``; the sums by slot.

    Pieces are added up as they stream, so that a task holds one vector of each slot at most. What comes to the
    driver is slots x length counters, whatever the input. ``few``: ``df`` has few partitions whatever the input, so one step of adding does.
    """

    def add(batches):
        total: dict[tuple, np.ndarray] = {}
        for batch in batches:
            for slot, piece, counts in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                x = np.frombuffer(counts, np.int64)
                if (slot, piece) in total:
                    total[slot, piece] += x
                else:
                    total[slot, piece] = x.copy()
        if total:
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in total], pa.string()), pa.array([k[1] for k in total], pa.int32()), pa.array([v.tobytes() for v in total.values()], pa.binary())], names=["slot", "piece", "counts"])

    pieces = -(-length // PIECE)
    parts = df.mapInArrow(count, SCHEMA)
    if not few:
        # Two steps: spread over many tasks first, so that no task reads what every task of a large input emits.
        spread = parts.withColumn("salt", F.spark_partition_id() % 16).repartition(16 * pieces, "slot", "piece", "salt").select("slot", "piece", "counts")
        parts = spread.mapInArrow(add, SCHEMA)
    rows = parts.repartition(min(pieces, 16), "slot", "piece").mapInArrow(add, SCHEMA).collect()
    out: dict[str | None, np.ndarray] = {}
    for slot, piece, counts in rows:
        x = np.frombuffer(counts, np.int64)
        out.setdefault(slot, np.zeros(length, np.int64))[piece * PIECE : piece * PIECE + len(x)] = x
    return out


def bounded(rows: DataFrame, key: str, bound: int, seed: int = 7) -> DataFrame:
    """About ``bound`` of the rows at most, the same ones on each run: those whose keyed hash is below a threshold."""
    n = rows.count()
    if n <= bound:
        return rows
    return rows.where(F.xxhash64(F.col(key), F.lit(seed)).bitwiseAND((1 << 32) - 1) < (1 << 32) * bound // n)
