"""Line dedup with two Bloom filters: hashes seen once and hashes seen twice.

Every input partition fills its own pair of filters; pairs are merged segment by
segment: ``twice = twice_a | twice_b | (once_a & once_b)``.  Only lines whose hash the
merged "twice" filter holds, the suspected repeats, are shuffled with their text for
exact confirmation and for the choice of the document that keeps them.

The filters have a size that follows the bytes of the texts up to ``sketches.MAX_BITS``; beyond
it more lines are suspected and confirmed exactly, and none is lost.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldloom.llm import sketches
from fieldloom.llm.common import SPACE_BYTES, power_of_two, raw, stored, strings, total_bytes

PROBES = 2


def line_key(line: bytes) -> bytes:
    """The line without whitespace at both ends, A-Z in lower case."""
    return line.strip(SPACE_BYTES).lower()


def keys_of(text: bytes | None, min_chars: int) -> set[bytes]:
    """Distinct keys of a text that have at least ``min_chars`` code points."""
    keys = {line_key(x) for x in (text or b"").split(b"\n") if len(x) >= min_chars}
    return {k for k in keys if len(k) >= min_chars and len(k.decode("utf-8", "replace")) >= min_chars}


def probes(keys: list[bytes], bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the keys, and the filter cells of each (one row for each key)."""
    h = np.fromiter((xxhash.xxh64_intdigest(k, 7) for k in keys), np.uint64, len(keys))
    step = (h >> np.uint64(32)) | np.uint64(1)
    cells = [(h + np.uint64(i) * step) & np.uint64((1 << bits) - 1) for i in range(PROBES)]
    return h, np.stack(cells, axis=1) if len(keys) else np.zeros((0, PROBES), np.uint64)


def _fill(bits: int, min_chars: int):
    """A partition's pair of filters, as the set cells of each segment."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, cells = [], []
        for batch in batches:
            for text in raw(batch.column(0)):
                h, c = probes(list(keys_of(text, min_chars)), bits)
                hashes.append(h)
                cells.append(c)
        if hashes:
            h, first, seen = np.unique(np.concatenate(hashes), return_index=True, return_counts=True)
            cells = np.concatenate(cells)[first]
            yield from sketches.segments(np.unique(cells), np.unique(cells[seen > 1]), bits)

    return run


def _suspects(shared, bits: int, min_chars: int, types: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        twice = shared.value
        for batch in batches:
            ids, keys = [], []
            for n, text in enumerate(raw(batch.column(1))):
                own = list(keys_of(text, min_chars))
                _, cells = probes(own, bits)
                for i in np.flatnonzero(sketches.has(twice, cells).all(axis=1)):
                    ids.append(n)
                    keys.append(own[i])
            rows = pa.array(ids, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(rows), batch.column(2).take(rows), strings(keys)], schema=types)

    return run


def _rewrite(names: list[str]):
    """Drop the listed keys' lines; the columns before the last two pass through."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, totals, dropped = [], [], []
            gone = batch.column(batch.num_columns - 1)
            for text, drop in zip(raw(batch.column(batch.num_columns - 2)), gone.cast(pa.list_(pa.binary())).to_pylist()):
                lines = (text or b"").split(b"\n")
                drop = set(drop or ())
                kept = [x for x in lines if line_key(x) not in drop] if drop else lines
                texts.append(b"\n".join(kept))
                totals.append(len(lines))
                dropped.append(len(lines) - len(kept))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-2], strings(texts), pa.array(totals, pa.int64()), pa.array(dropped, pa.int64())], names)

    return run


def line_dedup(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = (),
    min_chars: int = 40, min_docs: int = 2, keep: str = "largest",
) -> DataFrame:
    """Drop lines that repeat across documents, except in the document that keeps them.

    A line's key is the line stripped of ASCII whitespace, A-Z lower-cased.  Keys of at
    least ``min_chars`` code points found in at least ``min_docs`` documents lose all their
    lines but those of the ``keep`` ("largest" or "smallest") id.  Returns id, the carried
    columns, text, n_lines and n_dropped; other input columns are not read, whatever their
    names.  A null or empty text is one empty line.  Rows that share an id are one document
    in the counts and each is rewritten; rows with a null id count as one document that
    never keeps a line another document holds.  An empty table gives no rows.
    """
    bits = power_of_two(total_bytes(docs, text_col) // 16, 12, sketches.MAX_BITS)
    parts = docs.select(text_col).mapInArrow(_fill(bits, min_chars), sketches.SEGMENTS)
    shared = docs.sparkSession.sparkContext.broadcast(sketches.twice_bits(parts, bits))
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.xxhash64(F.col(text_col)).alias("text_hash"))
    kind = source.schema["id"].dataType
    from pyspark.sql.pandas.types import to_arrow_type

    types = pa.schema([("id", to_arrow_type(kind)), ("text_hash", pa.int64()), ("key", pa.string())])
    pairs = stored(source.mapInArrow(_suspects(shared, bits, min_chars, types), f"id {kind.simpleString()}, text_hash long, key string"), "lines")
    best = F.max("id") if keep == "largest" else F.min("id")
    # one row for each key and document first, so that a line of a third of all documents is counted in many tasks
    confirmed = (
        pairs.groupBy("key", "id").agg(F.lit(1).alias("one"))
        .groupBy("key").agg(F.count("one").alias("n"), best.alias("keeper")).where(F.col("n") >= min_docs)
    )
    # written, so that the join below stands alone: a small side is broadcast, and a hot key's partition can be split
    confirmed = stored(confirmed, "repeated-lines")
    # of one id and text, so that no row holds the lines of many texts
    drops = (
        pairs.join(confirmed, "key").where(~F.col("id").eqNullSafe(F.col("keeper")))
        .groupBy(F.col("id").alias("drop_id"), F.col("text_hash").alias("drop_hash")).agg(F.collect_set("key").alias("drops"))
    )
    own = docs.select(
        F.col(id_col).alias("c0"), *[F.col(c).alias(f"c{n + 1}") for n, c in enumerate(carry)], F.col(text_col).alias("text"))
    joined = own.join(drops, own.c0.eqNullSafe(drops.drop_id) & (F.xxhash64(own.text) == drops.drop_hash), "left").drop("drop_id", "drop_hash")
    fields = [f"c{n} {own.schema[f'c{n}'].dataType.simpleString()}" for n in range(len(carry) + 1)]
    names = [f"c{n}" for n in range(len(carry) + 1)] + ["text", "n_lines", "n_dropped"]
    out = joined.mapInArrow(_rewrite(names), ", ".join([*fields, "text string", "n_lines long", "n_dropped long"]))
    return out.toDF(id_col, *carry, text_col, "n_lines", "n_dropped")
