"""SimHash near-dedup by segment popcounts.

A fingerprint is embedded as the bit counts of its 32 two-bit segments.  One differing bit
changes one count by one, so the Manhattan distance of two embeddings is at most the
Hamming distance of the fingerprints.  Of two fingerprints at distance 4 or less, one half
(16 segments) has Manhattan distance 2 or less, and then a lattice point lies within one
step of both halves.  Each distinct fingerprint is therefore entered in the grid cells
within one step of either half (about 50 cells); fingerprints that meet in a cell pass the
full lower bound and are then compared bit by bit.  No pair within the distance is missed.

Cells give spanning links, not all pairs: a cell's matches are reduced to at most one link
for each of its members.  A cell of more than ``TILE`` fingerprints is dealt over pairs of
tiles, so that no task holds it whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldloom.llm.common import raw, stored
from fieldloom.llm.components import components

SHINGLE = 4
MAX_BITS = 4         # the two halves prove the grid for distances up to 5; see above
TILE = 4096          # fingerprints of one cell that are compared within one task
_U = np.uint64
_PAIRS = _U(0x5555555555555555)


def fingerprint(text: bytes | None, size: int = SHINGLE) -> int:
    """SimHash of the word shingles, repeats included; 0 for a text without a word."""
    words = (text or b"").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    hash64 = xxhash.xxh64_intdigest
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    k = min(size, len(words))
    spans = zip(starts[: len(words) - k + 1].tolist(), ends[k - 1:].tolist())
    hashes = np.fromiter((hash64(joined[a:b], 42) for a, b in spans), np.uint64, len(words) - k + 1)
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 14):
        part = hashes[at:at + (1 << 14)].astype(">u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > len(hashes)).tobytes(), "big")


def _fingerprints(types: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = np.array([fingerprint(t) for t in raw(batch.column(1))], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(values, pa.int64())], schema=types)

    return run


def fingerprints(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, fp) of every row; fp holds the 64 bits as a long."""
    from pyspark.sql.pandas.types import to_arrow_type

    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = source.schema["id"].dataType
    types = pa.schema([("id", to_arrow_type(kind)), ("fp", pa.int64())])
    return source.mapInArrow(_fingerprints(types), f"id {kind.simpleString()}, fp long")


def popcounts(fp: np.ndarray) -> np.ndarray:
    """The embedding: bit counts of the 32 two-bit segments, two bits each."""
    return fp - ((fp >> _U(1)) & _PAIRS)


def manhattan(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Manhattan distance of two embeddings: segment by segment, |x - y| of values 0 to 2."""
    high = lambda x: (x >> _U(1)) & _PAIRS  # noqa: E731  the value is 2
    low = lambda x: x & _PAIRS  # noqa: E731  the value is 1
    differ_high, differ_low = high(a) ^ high(b), low(a) ^ low(b)
    # 0-2 differ in the high bit only (distance 2); any difference that has the low bit is 1
    return np.bitwise_count(differ_low) + np.bitwise_count(differ_high & ~differ_low) * 2


def grid_cells(fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index, cell) of all cells that the fingerprints are entered in."""
    counts = popcounts(fp)
    index, cells = [], []
    every = np.arange(len(fp))
    for half in range(2):
        code = (counts >> _U(32 * half)) & _U(0xFFFFFFFF)
        mark = _U(half << 32)
        index.append(every)
        cells.append(code | mark)
        for s in range(16):
            one = _U(1 << (2 * s))
            value = (code >> _U(2 * s)) & _U(3)
            for ok, moved in ((value < 2, code + one), (value > 0, code - one)):
                at = np.flatnonzero(ok)
                index.append(at)
                cells.append(moved[at] | mark)
    return np.concatenate(index), np.concatenate(cells)


def _enter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        fp = batch.column(0).to_numpy(zero_copy_only=False)
        for at in range(0, len(fp), 20_000):
            part = fp[at:at + 20_000]
            index, cells = grid_cells(part.view(np.uint64))
            yield pa.RecordBatch.from_arrays([pa.array(cells.view(np.int64)), pa.array(part[index])], ["cell", "fp"])


def _close(a: np.ndarray, b: np.ndarray, most: int) -> np.ndarray:
    near = manhattan(popcounts(a), popcounts(b)) <= most
    near[near] = np.bitwise_count(a[near] ^ b[near]) <= most
    return near


def _spanning(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The same components in at most one link less than there are nodes."""
    nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    root, a, b = np.arange(len(nodes)), at[: len(u)], at[len(u):]
    while True:
        x, y = root[a], root[b]
        apart = x != y
        if not apart.any():
            own = np.flatnonzero(root != np.arange(len(nodes)))
            return nodes[own], nodes[root[own]]
        np.minimum.at(root, np.maximum(x, y)[apart], np.minimum(x, y)[apart])
        while (root != root[root]).any():
            root = root[root]


def _links(most: int, batch_rows: int = 1 << 16):
    """Spanning links of the cells of a partition; its rows are sorted by cell and tile."""

    def solve(key: np.ndarray, side: np.ndarray, fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Links between rows of equal key; where a row has side 1, only with side 0."""
        u, v = [], []
        run_start = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        longest = int(np.diff(np.append(run_start, len(key))).max())
        alive = np.arange(len(key))
        for step in range(1, longest):
            alive = alive[alive < len(key) - step]
            alive = alive[key[alive + step] == key[alive]]
            if not len(alive):
                break
            a, b = fp[alive], fp[alive + step]
            ok = (side[alive] != side[alive + step]) | (side[alive] < 0)
            near = np.zeros(len(alive), bool)
            near[ok] = _close(a[ok], b[ok], most)
            if near.any():
                u.append(a[near])
                v.append(b[near])
                if sum(map(len, u)) > 1 << 20:
                    x, y = _spanning(np.concatenate(u), np.concatenate(v))
                    u, v = [x], [y]
        if not u:
            return np.zeros(0, np.uint64), np.zeros(0, np.uint64)
        return _spanning(np.concatenate(u), np.concatenate(v))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: list[np.ndarray] | None = None

        def emit(rows: list[np.ndarray]):
            u, v = solve(rows[0], rows[1], rows[2].view(np.uint64))
            if len(u):
                yield pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(v.view(np.int64))], ["u", "v"])

        for batch in batches:
            if not batch.num_rows:
                continue
            cell, tile, side, fp = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
            # a key of cell and tile pair; equal keys are neighbours
            key = np.stack([cell, tile.astype(np.int64)], axis=1)
            rows = [key, side, fp] if rest is None else [np.concatenate([r, x]) for r, x in zip(rest, [key, side, fp])]
            if len(rows[0]) < batch_rows:
                rest = rows
                continue
            last = np.flatnonzero((rows[0][1:] != rows[0][:-1]).any(axis=1))
            cut = int(last[-1]) + 1 if len(last) else 0
            rest = [r[cut:] for r in rows]
            if cut:
                yield from emit(_numbered([r[:cut] for r in rows]))
        if rest is not None and len(rest[0]):
            yield from emit(_numbered(rest))

    return run


def _numbered(rows: list[np.ndarray]) -> list[np.ndarray]:
    key = rows[0]
    new = np.concatenate([[True], (key[1:] != key[:-1]).any(axis=1)])
    return [np.cumsum(new), rows[1], rows[2]]


def links(classes: DataFrame, most: int = MAX_BITS, tile: int = TILE) -> DataFrame:
    """Spanning links (u, v) of distinct fingerprints that differ in at most ``most`` bits."""
    if most > 5:
        raise ValueError("the grid is proven for 5 differing bits at most")
    entered = classes.select("fp").mapInArrow(_enter, "cell long, fp long")
    # the counts are combined before they are shuffled; the large cells are written, so that Spark knows
    # their size and broadcasts them only if they are few
    sizes = entered.groupBy("cell").agg(F.count("*").alias("n")).where(F.col("n") > tile)
    large = stored(sizes.select("cell", F.ceil(F.col("n") / tile).cast("int").alias("tiles")), "large-cells")
    dealt = entered.join(large, "cell", "left").select(
        "cell", "fp", F.coalesce("tiles", F.lit(1)).alias("tiles"),
        F.pmod(F.xxhash64("fp"), F.coalesce("tiles", F.lit(1))).cast("int").alias("own"))
    # tile pair (i, j), i <= j, as one number; within one tile any two rows pair (side -1), else only rows of both sides
    pairs = F.when(F.col("tiles") == 1, F.array(F.struct(F.lit(0).alias("tile"), F.lit(-1).cast("byte").alias("side")))).otherwise(
        F.transform(F.sequence(F.lit(0), F.col("tiles") - 1), lambda t: F.struct(
            (F.least(t, F.col("own")) * F.col("tiles") + F.greatest(t, F.col("own"))).cast("int").alias("tile"),
            F.when(t == F.col("own"), F.lit(-1)).when(F.col("own") < t, F.lit(0)).otherwise(F.lit(1)).cast("byte").alias("side"))))
    rows = dealt.select("cell", F.inline(pairs), "fp").select("cell", "tile", "side", "fp")
    return rows.repartition("cell", "tile").sortWithinPartitions("cell", "tile").mapInArrow(_links(most), "u long, v long")


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", most: int = MAX_BITS,
) -> DataFrame:
    """One row for each input row: id, fp (64 bits as a long) and component_id.

    A-Z is lower-cased, words are split at ASCII whitespace, shingles are 4 words (a shorter
    text is one shingle).  Null, empty and blank texts have fingerprint zero, linked like any
    other.  component_id is the smallest id of the documents reachable over links; a null id
    never is, unless its component has no other.  Repeated rows share their class.  Other
    columns are not read.  An empty table gives no rows.
    """
    own = stored(fingerprints(docs, id_col, text_col), "fingerprints")
    classes = stored(own.groupBy("fp").agg(F.min("id").alias("least")), "classes")
    roots = stored(components(links(classes, most)), "roots")
    linked = classes.join(roots, classes.fp == roots.node, "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    named = linked.groupBy("root").agg(F.min("least").alias("component_id"))
    by_class = linked.join(named, "root").select(F.col("fp").alias("class_fp"), "component_id")
    return own.join(by_class, own.fp == by_class.class_fp).select(F.col("id").alias(id_col), "fp", "component_id")
