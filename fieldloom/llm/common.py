"""Helpers shared by the operators: stored frames, Arrow columns, word positions and hashes."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldloom.session import shared_dir

# fixed values: the whitespace of the word rule [^\x20\x09-\x0D]+
SPACE_BYTES = b" \t\n\x0b\x0c\r"
SPACE_CLASS = "[\\x20\\x09-\\x0D]"


def stored(df: DataFrame, purpose: str) -> DataFrame:
    """Write a frame below the shared folder and read it back: the lineage is cut and
    every later reader, retry or lost executor sees the same rows."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/llm-{purpose}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def total_bytes(docs: DataFrame, text: str) -> int:
    """UTF-8 bytes of all texts: one scan of one column, used to size sketches."""
    return int(docs.agg(F.coalesce(F.sum(F.octet_length(F.col(text))), F.lit(0))).first()[0])


def power_of_two(at_least: int, low: int, high: int) -> int:
    """Exponent of the smallest power of two that is at least the value, within bounds."""
    return min(high, max(low, max(1, at_least - 1).bit_length()))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def raw(column: pa.Array) -> list[bytes | None]:
    """UTF-8 bytes of a string column."""
    return column.cast(pa.binary()).to_pylist()


def strings(values: list[bytes | None]) -> pa.Array:
    """A string column of UTF-8 bytes, not decoded again."""
    a = pa.array(values, pa.binary())
    return pa.StringArray.from_buffers(len(a), a.buffers()[1], a.buffers()[2], a.buffers()[0], a.null_count)


def blocks(texts: list[bytes], size: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about ``size`` bytes together; a longer text is alone."""
    start, held = 0, 0
    for n, text in enumerate(texts):
        if n > start and held + len(text) > size:
            yield start, n
            start, held = n, 0
        held += len(text) + 1
    if start < len(texts):
        yield start, len(texts)


def mix(h: np.ndarray) -> np.ndarray:
    """Spread 64-bit values evenly."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


_SPACE = np.zeros(256, bool)
_SPACE[list(SPACE_BYTES)] = True
_BASE = np.uint64(0x9E3779B97F4A7C15)
_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * _BASE)
_POWERS = {"n": 0}


def powers(n: int, base: np.uint64 = _BASE) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i < n, kept between calls."""
    if _POWERS["n"] < n:
        size = 1 << max(21, int(n).bit_length())
        inverse = np.uint64(pow(int(base), -1, 1 << 64))
        up, down = np.full(size, base), np.full(size, inverse)
        up[0] = down[0] = 1
        _POWERS.update(n=size, up=np.cumprod(up), down=np.cumprod(down))
    return _POWERS["up"][:n], _POWERS["down"][:n]


def span_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the spans of a sequence of 64-bit values; equal spans hash equal wherever they are."""
    up, down = powers(len(values) + 1)
    sums = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * up[: len(values)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def words(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words of texts put one after another: (bytes, starts, ends, text number of each word)."""
    joined = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    space = _SPACE[joined]
    edge = np.empty(len(joined), bool)
    edge[0] = not space[0]
    np.not_equal(space[1:], space[:-1], out=edge[1:])
    cut = np.flatnonzero(edge)
    starts, ends = cut[0::2], cut[1::2]
    after = np.cumsum(np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts)))
    return joined, starts, ends, np.searchsorted(after, starts, side="right")


def word_hashes(joined: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    return span_hashes(_BYTE[joined], starts, ends)
