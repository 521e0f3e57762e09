"""Sketches whose cells count to two: filled by partition, merged by segment, read everywhere.

A sketch has 2**bits cells.  A partition's sketch is written as the cells it counted once
and twice, segment by segment, so its size follows what it holds and not the sketch.  One
task merges a segment of all partitions.  Readers need only "two or more", one bit a cell.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

MAX_BITS = 30        # a merged sketch is at most 2**30 cells, 128 MB as bits, in every worker
SEGMENT_BITS = 20    # one task merges 2**20 cells at a time
FETCH_BYTES = 4 << 20    # of a merged sketch, fetched at a time
SEGMENTS = "segment int, once binary, twice binary"


def segments(once: np.ndarray, twice: np.ndarray, bits: int) -> Iterator[pa.RecordBatch]:
    """A partition's sketch from its sorted cells; ``twice`` is a part of ``once``."""
    size = 1 << min(bits, SEGMENT_BITS)
    edges = np.arange(0, (1 << bits) + 1, size).astype(np.uint64)
    a, b, inside = np.searchsorted(once, edges), np.searchsorted(twice, edges), np.uint64(size - 1)
    local = lambda x: (x & inside).astype("<u4").tobytes()
    rows = [(n, local(once[a[n]:a[n + 1]]), local(twice[b[n]:b[n + 1]])) for n in range(len(a) - 1) if a[n + 1] > a[n]]
    if rows:
        kinds = (pa.int32(), pa.binary(), pa.binary())
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), kinds)], ["segment", "once", "twice"])


def _merge(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for batch in batches:
            for n, once, twice in zip(*(c.to_pylist() for c in batch.columns)):
                a, b = held.setdefault(n, (np.zeros(size, bool), np.zeros(size, bool)))
                x = np.frombuffer(once, "<u4")
                b[x[a[x]]] = True
                b[np.frombuffer(twice, "<u4")] = True
                a[x] = True
        if held:
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(held), pa.int32()), pa.array([np.packbits(b).tobytes() for _, b in held.values()], pa.binary())],
                ["segment", "bits"])

    return run


def twice_bits(parts: DataFrame, bits: int) -> np.ndarray:
    """Merge partitions' segments; the packed bits say which cells counted two or more."""
    size = 1 << min(bits, SEGMENT_BITS)
    tasks = min((1 << bits) // size, 256)
    merged = parts.repartition(tasks, "segment").mapInArrow(_merge(size), "segment int, bits binary")
    out = np.zeros((1 << bits) // 8, np.uint8)
    # each partition is a job of its own when it is fetched
    for row in merged.repartition(-(-len(out) // FETCH_BYTES)).toLocalIterator():
        out[row["segment"] * size // 8:(row["segment"] + 1) * size // 8] = np.frombuffer(row["bits"], np.uint8)
    return out


def has(packed: np.ndarray, cells: np.ndarray) -> np.ndarray:
    return (packed[cells >> np.uint64(3)] >> (np.uint8(7) - (cells & np.uint64(7)).astype(np.uint8))) & 1 == 1
