"""Helpers shared by the operators of this subpackage.

The per-row work of these operators runs in ``mapInArrow`` functions. Spark
cuts Arrow batches by rows and by ``spark.sql.execution.arrow.maxBytesPerBatch``;
``byte_slices`` cuts them again so that what a task holds depends on bytes, not
on how many rows happened to share a batch.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

#: Bytes of text that one step of a task handles at once (a longer single text is handled alone).
SLICE_BYTES = 1 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def byte_slices(batch: pa.RecordBatch, column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Consecutive parts of ``batch`` whose ``column`` holds at most ``limit`` bytes (one row at least)."""
    if not batch.num_rows:
        return
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    ends = np.cumsum(sizes.astype(np.int64))
    start = 0
    while start < batch.num_rows:
        before = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, before + limit, side="right")))
        yield batch.slice(start, stop - start)
        start = stop


def sliced(fn: Callable[[pa.RecordBatch], pa.RecordBatch], column: str, limit: int = SLICE_BYTES):
    """A ``mapInArrow`` function that applies ``fn`` to parts of at most ``limit`` bytes of ``column``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in byte_slices(batch, column, limit):
                yield fn(part)
    return run


def texts_of(batch: pa.RecordBatch, column: str) -> list[str]:
    """Texts of a column; null counts as empty."""
    return [x or "" for x in batch.column(column).to_pylist()]


def bytes_of(batch: pa.RecordBatch, column: str) -> list[bytes]:
    """UTF-8 bytes of a string column; null counts as empty."""
    return [x or b"" for x in batch.column(column).cast(pa.binary()).to_pylist()]


def segment_sums(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Sums of consecutive segments of ``values`` that have ``counts`` items each (0 for none)."""
    ends = np.concatenate([[0], np.cumsum(values, dtype=np.int64)])
    stops = np.cumsum(counts)
    return ends[stops] - ends[stops - counts]


def ranges(starts: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """All numbers of the ranges [start, start + len), one after the other."""
    total = int(lens.sum())
    if not total:
        return np.zeros(0, np.int64)
    before = np.cumsum(lens) - lens
    return np.repeat(starts - before, lens) + np.arange(total, dtype=np.int64)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit numbers (xor-shift and multiply)."""
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))
