"""Arrow batch helpers: chunked maps, and bounded arrays summed or united over all partitions."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

SLICE = 1 << 16
CHUNK_BYTES = 16 << 20


def chunks(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    """Slices of at most `rows` rows, fewer where rows are long."""
    for batch in batches:
        step = max(1, min(rows, rows * CHUNK_BYTES // max(batch.nbytes, 1) if batch.nbytes > CHUNK_BYTES else rows))
        for at in range(0, batch.num_rows, step):
            yield batch.slice(at, step)


def both_set(a: np.ndarray, b: np.ndarray, _slice: int) -> np.ndarray:
    return a | b


def summed(a: np.ndarray, b: np.ndarray, _slice: int) -> np.ndarray:
    return a + b


def union_array(df: DataFrame, fill: Callable[[np.ndarray, pa.RecordBatch], None], slots: int, dtype: str, rows: int, join: Callable) -> np.ndarray:
    """An array of `slots` cells filled from every row of df: partial arrays per partition, joined slice by slice.

    The result is bounded by slots, not by the data; only it reaches the driver.
    """

    def partial(batches):
        cells = np.zeros(slots, dtype)
        for batch in chunks(batches, rows):
            fill(cells, batch)
        for k in range(0, slots, SLICE):
            part = cells[k : k + SLICE]
            if part.any():
                yield pa.RecordBatch.from_pydict({"slice": pa.array([k // SLICE], pa.int32()), "blob": pa.array([zlib.compress(part.tobytes(), 1)], pa.binary())})

    def merge(batches):
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, blob in zip(batch.column("slice").to_pylist(), batch.column("blob").to_pylist(), strict=True):
                part = np.frombuffer(zlib.decompress(blob), dtype)
                held[k] = join(held[k], part, k) if k in held else part
        for k, part in held.items():
            yield pa.RecordBatch.from_pydict({"slice": pa.array([k], pa.int32()), "blob": pa.array([zlib.compress(part.tobytes(), 1)], pa.binary())})

    schema = "slice int, blob binary"
    cells = np.zeros(slots, dtype)
    for row in df.mapInArrow(partial, schema).repartition("slice").mapInArrow(merge, schema).toLocalIterator():
        part = np.frombuffer(zlib.decompress(row["blob"]), dtype)
        cells[row["slice"] * SLICE : row["slice"] * SLICE + len(part)] = part
    return cells


class Bloom:
    """Membership filter over 64-bit hashes with a fixed number of bits. False positives only cost work."""

    SPREAD = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)

    def __init__(self, log2_bits: int) -> None:
        self.log2 = log2_bits
        self.slots = 1 << (log2_bits - 3)

    def _at(self, keys: np.ndarray) -> Iterator[np.ndarray]:
        with np.errstate(over="ignore"):
            for c in self.SPREAD:
                yield (keys * np.uint64(c)) >> np.uint64(64 - self.log2)

    def put(self, cells: np.ndarray, keys: np.ndarray) -> None:
        for at in self._at(keys):
            np.bitwise_or.at(cells, (at >> np.uint64(3)).astype(np.int64), (np.uint8(1) << (at & np.uint64(7)).astype(np.uint8)))

    def has(self, cells: np.ndarray, keys: np.ndarray) -> np.ndarray:
        ok = np.ones(len(keys), bool)
        for at in self._at(keys):
            ok &= (cells[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1
        return ok


def bits_for(rows: int, most: int = 27, least: int = 20) -> int:
    """log2 of the bits for a filter of so many rows, some 8 a row, at most 2^most (16 MB)."""
    return int(min(most, max(least, np.ceil(np.log2(max(rows, 1) * 8)))))
