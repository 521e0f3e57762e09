"""Substring dedup: words covered by a window of words that starts anywhere else go.

First pass: every partition counts into a count-min sketch, and the sketches are merged.  A
window is counted by its anchor, the eight-word gram in it with the least hash: equal
windows hold equal anchors at equal offsets, so an anchor's count is never below the count
of a window that holds it, and one count serves about fourteen windows.  Second pass: only
windows whose anchor is estimated repeated are shuffled, as hashes grouped by anchor, and
grouped exactly.  What comes back are the estimated windows that were not repeated after
all; a last pass removes the others' words.  The estimate loses no window.

A short phrase that very many texts hold between different words is the anchor of as many
different windows.  Anchors of more than ``HOT_WINDOWS`` windows are counted first; their windows
go one by one, by anchor and window, so that equal ones still meet and the rest is spread.

Windows are equal when their anchors' and their own 64-bit hashes are.  A segment, the
windows of one anchor, that occurs again in the same batch is sent once, so a passage of
a third of all documents reaches its task once for each batch.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldloom.llm import sketches
from fieldloom.llm.common import blocks, mix, power_of_two, raw, span_hashes, stored, strings, total_bytes, word_hashes, words

WINDOW = 35
GRAM = 8
DEPTH = 2            # rows of the count-min sketch
BUCKET_BYTES = 8 << 20   # bytes of text for each bucket of the exact pass
HOT_WINDOWS = 1 << 17    # windows of one anchor that are dealt window by window
_U = np.uint64


@dataclass
class Windows:
    """All windows of a block of texts; positions count words of the block."""

    n_words: int
    owner: np.ndarray        # text of each word
    first: np.ndarray        # first word of each text
    starts: np.ndarray       # start word of each window
    anchors: np.ndarray      # anchor word of each window
    grams: np.ndarray        # gram hash of each word
    hashes: np.ndarray       # hash of each window


def _sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    held, out = 1, x
    while held * 2 <= width:
        out = np.minimum(out[:-held], out[held:])
        held *= 2
    return np.minimum(out[: len(x) - width + 1], out[width - held:][: len(x) - width + 1])


def find_windows(texts: list[bytes], window: int = WINDOW, gram: int = GRAM) -> Windows:
    joined, starts, ends, owner = words(texts)
    n = len(starts)
    first = np.searchsorted(owner, np.arange(len(texts) + 1))
    none = np.zeros(0, np.int64)
    if n < window:
        return Windows(n, owner, first, none, none, none.view(_U), none.view(_U))
    values = word_hashes(joined, starts, ends)
    at = np.arange(n)
    grams = span_hashes(values, at[: n - gram + 1], at[gram - 1:] + 1)
    # the upper half of the hash decides, then the position: the leftmost of equal grams
    keyed = (grams >> _U(32) << _U(32)) | at[: n - gram + 1].astype(_U)
    least = _sliding_min(keyed, window - gram + 1)
    whole = np.flatnonzero(owner[: n - window + 1] == owner[window - 1:])
    hashes = span_hashes(values, whole, whole + window)
    return Windows(n, owner, first, whole, (least[whole] & _U(0xFFFFFFFF)).astype(np.int64), grams, hashes)


def cells(hashes: np.ndarray, bits: int) -> np.ndarray:
    """Count-min cells, one row of the result for each row of the sketch; 2**bits in all."""
    width = bits - DEPTH.bit_length() + 1
    return np.stack([(mix(hashes + _U(r + 1) * _U(0x632BE59BD9B4E019)) >> _U(64 - width)) + _U(r << width) for r in range(DEPTH)])


def _fill(bits: int, window: int, gram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = []
        for batch in batches:
            texts = [t or b"" for t in raw(batch.column(0))]
            for a, b in blocks(texts):
                w = find_windows(texts[a:b], window, gram)
                held.append(w.grams[np.unique(w.anchors)])
        found, n = np.unique(cells(np.concatenate(held), bits) if held else np.zeros(0, _U), return_counts=True)
        yield from sketches.segments(found, found[n > 1], bits)

    return run


def _estimated(w: Windows, packed: np.ndarray, bits: int) -> np.ndarray:
    """Which windows the sketch estimates repeated."""
    places, at = np.unique(w.anchors, return_inverse=True)
    return sketches.has(packed, cells(w.grams[places], bits)).all(axis=0)[at] if len(places) else np.zeros(0, bool)


def _often(shared, bits: int, window: int, gram: int, floor: int):
    """Anchors that a partition's estimated windows have ``floor`` times or more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        for batch in batches:
            texts = [t or b"" for t in raw(batch.column(0))]
            found = []
            for a, b in blocks(texts):
                w = find_windows(texts[a:b], window, gram)
                found.append(w.grams[w.anchors[_estimated(w, shared.value, bits)]])
            new, count = np.unique(np.concatenate([np.zeros(0, np.uint64), *found]), return_counts=True)
            held, at = np.unique(np.concatenate([held, new]), return_inverse=True)
            n = np.bincount(at, np.concatenate([n, count]), minlength=len(held)).astype(np.int64)
        on = n >= floor
        yield pa.RecordBatch.from_arrays([pa.array(held[on].view(np.int64)), pa.array(n[on])], ["anchor", "n"])

    return run


def hot_anchors(docs: DataFrame, text_col: str, shared, bits: int, window: int, gram: int, most: int) -> np.ndarray:
    """Sorted anchors of more than ``most`` windows, and perhaps of half as many; at most all windows by half of ``most``.

    A partition names an anchor from a share of the limit on, so what all leave out is half of it at most.
    """
    parts = docs.select(text_col)
    floor = max(1, most // (2 * max(1, parts.rdd.getNumPartitions())))
    named = parts.mapInArrow(_often(shared, bits, window, gram, floor), "anchor long, n long").groupBy("anchor").agg(F.sum("n").alias("n"))
    return np.sort(np.array([r["anchor"] for r in named.where(F.col("n") > most // 2).collect()], np.int64).view(_U))


def _send(shared, hot, bits: int, buckets: int, window: int, gram: int, types: pa.Schema):
    """Segments of windows that are estimated repeated, packed by bucket of their anchor."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packed = shared.value
        for batch in batches:
            texts = [t or b"" for t in raw(batch.column(1))]
            parts = []
            for a, b in blocks(texts):
                w = find_windows(texts[a:b], window, gram)
                at = np.flatnonzero(_estimated(w, packed, bits))
                if not len(at):
                    continue
                anchors, starts = w.anchors[at], w.starts[at]
                loose = np.isin(w.grams[anchors], hot.value)
                cut = np.flatnonzero(np.concatenate([[True], (anchors[1:] != anchors[:-1]) | (starts[1:] != starts[:-1] + 1) | loose[1:]]))
                size = np.diff(np.append(cut, len(at)))
                own = w.owner[starts[cut]]
                anchor = w.grams[anchors[cut]]
                dealt = np.where(loose[cut], mix(anchor + w.hashes[at][cut]), anchor)
                parts.append((anchor, own + a, starts[cut] - w.first[own], size, dealt, w.hashes[at]))
            if not parts:
                continue
            anchor, row, start, size, dealt, hashes = (np.concatenate(x) for x in zip(*parts))
            offset = np.concatenate([[0], np.cumsum(size)])
            # segments that are equal within the batch are sent once, with weight two
            whole = span_hashes(hashes, offset[:-1], offset[1:])
            _, kept, same = np.unique(np.stack([anchor, whole], axis=1), axis=0, return_index=True, return_counts=True)
            bucket = (dealt[kept] % _U(buckets)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            kept, same, bucket = kept[order], same[order], bucket[order]
            edges = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]]))
            lists = lambda x, t: pa.ListArray.from_arrays(pa.array(np.append(edges, len(kept)), pa.int32()), pa.array(x).cast(t))
            length = size[kept]
            flat = np.repeat(offset[kept] - np.concatenate([[0], np.cumsum(length)[:-1]]), length) + np.arange(length.sum())
            inner = np.append(np.concatenate([[0], np.cumsum(length)])[edges], length.sum())
            ids = batch.column(0).take(pa.array(row[kept]))
            hash_of = batch.column(2).take(pa.array(row[kept]))
            yield pa.RecordBatch.from_arrays([
                pa.array(bucket[edges], pa.int32()),
                pa.ListArray.from_arrays(pa.array(np.append(edges, len(kept)), pa.int32()), ids),
                pa.ListArray.from_arrays(pa.array(np.append(edges, len(kept)), pa.int32()), hash_of),
                lists(anchor[kept].view(np.int64), pa.int64()), lists(start[kept], pa.int32()), lists(length, pa.int32()),
                lists(np.minimum(same, 2), pa.int8()),
                pa.ListArray.from_arrays(pa.array(inner, pa.int32()), pa.array(hashes[flat].view(np.int64))),
            ], schema=types)

    return run


def _alone(types: pa.Schema):
    """Of one bucket, the runs of windows that occur once."""

    def run(table: pa.Table) -> pa.Table:
        column = lambda n: table.column(n).combine_chunks().flatten()
        number = lambda n: column(n).to_numpy(zero_copy_only=False)
        anchor, start, size, weight, hashes = (number(n) for n in ("anchor", "start", "size", "weight", "hash"))
        segment = np.repeat(np.arange(len(size)), size)
        order = np.lexsort((hashes, anchor[segment]))
        a, h = anchor[segment][order], hashes[order]
        group = np.cumsum(np.concatenate([[True], (a[1:] != a[:-1]) | (h[1:] != h[:-1])])) - 1
        times = np.bincount(group, weight[segment][order])
        single = np.empty(len(order), bool)
        single[order] = times[group] < 2
        place = np.arange(len(segment)) - np.repeat(np.cumsum(size) - size, size)
        new = single & ~np.concatenate([[False], single[:-1] & (segment[1:] == segment[:-1])])
        end = single & ~np.concatenate([single[1:] & (segment[1:] == segment[:-1]), [False]])
        own = segment[new]
        return pa.Table.from_arrays([
            column("id").take(pa.array(own)), column("text_hash").take(pa.array(own)),
            pa.array(start[own] + place[new], pa.int32()), pa.array(start[own] + place[end] + 1, pa.int32())], schema=types)

    return run


def _remove(shared, bits: int, window: int, gram: int, names: list[str]):
    """Remove covered words; the last column lists the runs of windows that are not repeated."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packed = shared.value
        for batch in batches:
            texts = [t or b"" for t in raw(batch.column(batch.num_columns - 2))]
            alone = batch.column(batch.num_columns - 1).to_pylist()
            kept, totals, removed = [], [], []
            for a, b in blocks(texts):
                w = find_windows(texts[a:b], window, gram)
                again = np.zeros(w.n_words + 1, bool)
                again[w.starts[_estimated(w, packed, bits)]] = True
                for n in range(a, b):
                    for r in alone[n] or ():
                        again[w.first[n - a] + r["start"]:w.first[n - a] + r["stop"]] = False
                at = np.flatnonzero(again)
                edge = np.zeros(w.n_words + window + 1, np.int64)
                np.add.at(edge, at, 1)
                np.add.at(edge, at + window, -1)
                gone = np.cumsum(edge)[: w.n_words] > 0
                for n in range(a, b):
                    own, mask = texts[n].split(), gone[w.first[n - a]:w.first[n - a + 1]]
                    count = int(mask.sum())
                    kept.append(b" ".join([x for x, g in zip(own, mask.tolist()) if not g] if count else own))
                    totals.append(len(own))
                    removed.append(count)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-2], strings(kept), pa.array(totals, pa.int64()), pa.array(removed, pa.int64())], names)

    return run


def substring_dedup(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = (),
    window: int = WINDOW, gram: int = GRAM, hot_windows: int = HOT_WINDOWS,
) -> DataFrame:
    """Remove each word covered by a window of ``window`` words that also starts anywhere else.

    Windows are judged on the input, within and across documents; words are split at ASCII
    whitespace and kept words are joined by one space.  Returns id, the carried columns,
    text, n_words and n_removed.  A null or empty text has no words and becomes empty; a text
    shorter than the window is kept.  Repeated rows are occurrences of their own, so both lose
    their windows; rows of one id with different texts are judged apart; null ids are
    allowed.  Other columns are not read.  An empty table gives no rows.
    """
    from pyspark.sql.pandas.types import to_arrow_type

    spark = docs.sparkSession
    size = total_bytes(docs, text_col)
    bits = power_of_two(size // 16, 12, sketches.MAX_BITS - 1) + 1
    buckets = max(1, -(-size // BUCKET_BYTES))
    parts = docs.select(text_col).mapInArrow(_fill(bits, window, gram), sketches.SEGMENTS)
    shared = spark.sparkContext.broadcast(sketches.twice_bits(parts, bits))
    hot = spark.sparkContext.broadcast(hot_anchors(docs, text_col, shared, bits, window, gram, hot_windows))
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.xxhash64(F.col(text_col)).alias("text_hash"))
    kind = source.schema["id"].dataType
    of = to_arrow_type(kind)
    lists = [("id", of), ("text_hash", pa.int64()), ("anchor", pa.int64()), ("start", pa.int32()), ("size", pa.int32()), ("weight", pa.int8()),
             ("hash", pa.int64())]
    sent_types = pa.schema([("bucket", pa.int32()), *[(n, pa.list_(t)) for n, t in lists]])
    k = kind.simpleString()
    sent = source.mapInArrow(
        _send(shared, hot, bits, buckets, window, gram, sent_types),
        f"bucket int, id array<{k}>, text_hash array<bigint>, anchor array<bigint>, start array<int>, size array<int>, "
        "weight array<tinyint>, hash array<bigint>")
    run_types = pa.schema([("id", of), ("text_hash", pa.int64()), ("start", pa.int32()), ("stop", pa.int32())])
    runs = stored(sent.groupBy("bucket").applyInArrow(_alone(run_types), f"id {k}, text_hash long, start int, stop int"), "single-windows")
    alone = runs.groupBy(F.col("id").alias("run_id"), "text_hash").agg(F.collect_list(F.struct("start", "stop")).alias("alone"))
    own = docs.select(
        F.col(id_col).alias("c0"), *[F.col(c).alias(f"c{n + 1}") for n, c in enumerate(carry)], F.col(text_col).alias("text"))
    joined = own.join(alone, own.c0.eqNullSafe(alone.run_id) & (F.xxhash64(own.text) == alone.text_hash), "left").drop("run_id", "text_hash")
    names = [f"c{n}" for n in range(len(carry) + 1)]
    fields = [f"{n} {own.schema[n].dataType.simpleString()}" for n in names]
    out = joined.mapInArrow(
        _remove(shared, bits, window, gram, [*names, "text", "n_words", "n_removed"]),
        ", ".join([*fields, "text string", "n_words long", "n_removed long"]))
    return out.toDF(id_col, *carry, text_col, "n_words", "n_removed")
