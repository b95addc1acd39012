"""Intermediate tables in the cluster's shared folder, and sums of arrays that tasks gather."""

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from codeloom.operators.lineage import materialize, shared_folder

CHUNK = 4096   # numbers of one row of a gathered array

__all__ = ["free_prefix", "gathered_rows", "give_back", "held_out", "materialize", "shared_folder", "summed"]


def free_prefix(columns: list[str]) -> str:
    """Underscores that no column's name begins with."""
    prefix = "__"
    while any(c.startswith(prefix) for c in columns):
        prefix += "_"
    return prefix


def give_back() -> None:
    """Freed memory back to the system: a worker process lives longer than its task, and the executor's memory is counted whole."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)   # glibc has it
    if trim is not None:
        trim(0)


def held_out(column: str):
    """Rows of the evaluation fold: crc32 of the id as text, modulo 5, is 0. A null id is not held out."""
    return F.coalesce(F.pmod(F.crc32(F.col(column).cast("string")), F.lit(5)) == 0, F.lit(False))


def gathered_rows(arrays: dict[int, np.ndarray]) -> Iterator[pa.RecordBatch]:
    """The non-empty chunks of a task's int64 arrays, as rows (key, chunk, counts)."""
    rows = [(key, i // CHUNK, part.tobytes()) for key, array in arrays.items()
            for i in range(0, len(array), CHUNK) if (part := array[i: i + CHUNK]).any()]
    yield pa.RecordBatch.from_arrays(
        [pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.int32()),
         pa.array([r[2] for r in rows], pa.binary())], ["key", "chunk", "counts"])


def summed(rows: DataFrame, keys: int, size: int) -> np.ndarray:
    """Rows of ``gathered_rows`` added up: ``keys`` arrays of ``size`` numbers.

    Each chunk is added as a stream in one task, so neither the number of tasks that gathered nor the size of the
    input is ever in memory; the driver gets ``keys * size`` numbers, which the caller bounds.
    """
    def add(batches):
        sums: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches:
            for key, chunk, counts in zip(*(c.to_pylist() for c in batch.columns)):
                part = np.frombuffer(counts, np.int64)
                if (key, chunk) in sums:
                    sums[key, chunk] += part
                else:
                    sums[key, chunk] = part.copy()
        yield pa.RecordBatch.from_arrays(
            [pa.array([k[0] for k in sums], pa.int32()), pa.array([k[1] for k in sums], pa.int32()),
             pa.array([v.tobytes() for v in sums.values()], pa.binary())], ["key", "chunk", "counts"])

    result = np.zeros((keys, size), np.int64)
    table = rows.repartition("key", "chunk").mapInArrow(add, "key int, chunk int, counts binary").toArrow()
    for key, chunk, counts in zip(*(c.to_pylist() for c in table.columns)):
        part = np.frombuffer(counts, np.int64)
        result[key, chunk * CHUNK: chunk * CHUNK + len(part)] += part
    return result
