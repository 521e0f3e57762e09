"""Benchmark decontamination by the q-gram lemma.

A text region that equals a benchmark item up to k edits shares at least
``len - q + 1 - k * q`` of the item's q-grams, on diagonals (text position minus item
position) that span k at most.  Hits are counted in overlapping bands of diagonals; bands
that meet the bound are verified by an alignment inside the band.  No region within the
edit budget is missed.  Items under ``MIN_ITEM_BYTES`` have a budget of a few edits that chance
would meet, so they are searched exactly, at word borders, by one automaton for a block.

The benchmark is the stated query set: it is read in blocks of bounded size and every block
goes over all documents.  Texts and items are compared in lower case with runs of whitespace
as one space; positions and edits count UTF-8 bytes of that form.
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldloom.llm.common import blocks

Q = 8                     # a q-gram fills one 64-bit number
EDIT_RATE = 0.1
MIN_ITEM_BYTES = 32       # shorter items cannot be told from chance with edits: they are searched exactly
BLOCK_BYTES = 4 << 20     # benchmark text that is sent to the workers at once
TABLE_BITS = 22
_U = np.uint64
_SPREAD = _U(0x9E3779B97F4A7C15)


def normal(text: str | None) -> bytes:
    return " ".join((text or "").lower().split()).encode("utf-8", "replace")


def grams(joined: bytes) -> np.ndarray:
    """The q-gram at each byte, as one number."""
    n = max(0, len(joined) - Q + 1)
    return np.ndarray((n,), "<u8", joined, strides=(1,)).copy() if n else np.zeros(0, _U)


class Index:
    """q-grams of a block of items: grams, their places, and each item's budget."""

    def __init__(self, items: list[tuple[object, bytes]], rate: float):
        self.ids = [i for i, _ in items]
        self.texts = [t for _, t in items]
        size = np.array([len(t) for t in self.texts], np.int64)
        self.edits = np.minimum((size * rate).astype(np.int64), (size - Q) // Q)
        self.least = size - Q + 1 - self.edits * Q
        self.step = self.edits + 1   # bands of an item start so far apart and are twice as wide
        codes = np.concatenate([grams(t) for t in self.texts])
        item = np.repeat(np.arange(len(items)), np.maximum(size - Q + 1, 0))
        place = np.concatenate([np.arange(max(0, s - Q + 1)) for s in size])
        order = np.argsort(codes, kind="stable")
        self.codes, first = np.unique(codes[order], return_index=True)
        self.item, self.place, self.ends = item[order], place[order], np.append(first, len(codes))
        self.table = np.zeros(1 << TABLE_BITS, bool)
        self.table[(self.codes * _SPREAD) >> _U(64 - TABLE_BITS)] = True

    def hits(self, joined: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text position, item, item position) of every shared q-gram."""
        codes = grams(joined)
        at = np.flatnonzero(self.table[(codes * _SPREAD) >> _U(64 - TABLE_BITS)])
        found = np.minimum(np.searchsorted(self.codes, codes[at]), len(self.codes) - 1)
        same = self.codes[found] == codes[at]
        at, found = at[same], found[same]
        times = self.ends[found + 1] - self.ends[found]
        entry = np.repeat(self.ends[found] - (np.cumsum(times) - times), times) + np.arange(times.sum())
        return np.repeat(at, times), self.item[entry], self.place[entry]

    def candidates(self, texts: list[bytes]) -> Iterator[tuple[int, int, int]]:
        """(text, item, first diagonal) of the bands that meet their item's bound."""
        joined = b"\xff".join(texts)
        starts = np.cumsum([0] + [len(t) + 1 for t in texts])
        p, item, g = self.hits(joined)
        if not len(p):
            return
        text = np.searchsorted(starts, p, side="right") - 1
        lead = max(map(len, self.texts))
        band = (p - starts[text] - g + lead) // self.step[item]
        span = (max(map(len, texts)) + lead) // int(self.step.min()) + 2
        key = (text * len(self.ids) + item) * span + band + 1
        key, item, g = np.concatenate([key, key - 1]), np.concatenate([item, item]), np.concatenate([g, g])
        # a count by hashed key first: no count is below the true one, and few hits are left to sort
        hashed = (key.astype(_U) * _SPREAD) >> _U(64 - 20)
        enough = np.bincount(hashed.view(np.int64), minlength=1 << 20)[hashed] >= self.least[item]
        # then exactly; each of an item's q-grams counts once in a band
        key = np.unique(key[enough] * lead + g[enough]) // lead
        key, n = np.unique(key, return_counts=True)
        owner = key // span
        good = n >= self.least[owner % len(self.ids)]
        for k, o in zip(key[good].tolist(), owner[good].tolist()):
            yield o // len(self.ids), o % len(self.ids), (k % span - 1) * int(self.step[o % len(self.ids)]) - lead


def align(item: bytes, text: bytes, low: int, width: int) -> tuple[int, int]:
    """(edits, end) of the best alignment of the whole item that stays on ``width`` diagonals from ``low`` on."""
    n = len(item)
    padded = np.full(n + width, 255, np.uint8)
    a, b = max(0, low), min(len(text), low + n + width)
    if b > a:
        padded[a - low:b - low] = np.frombuffer(text, np.uint8, b - a, a)
    order = np.arange(width, dtype=np.int32)
    cost = np.zeros(width, np.int32)
    for i, c in enumerate(item):
        step = cost + (padded[i:i + width] != c)
        step[:-1] = np.minimum(step[:-1], cost[1:] + 1)
        cost = np.minimum.accumulate(step - order) + order
    best = int(cost.argmin())
    return int(cost[best]), low + n + best


def verify(item: bytes, text: bytes, low: int, width: int, most: int) -> tuple[int, int, int] | None:
    """(edits, start, stop) of the item in the band, or None if it needs more than ``most`` edits."""
    exact = text.find(item, max(0, low), max(0, low + width + len(item)))
    if exact >= 0:
        return 0, exact, exact + len(item)
    edits, stop = align(item, text, low, width)
    if edits > most:
        return None
    stop = min(stop, len(text))
    # the same alignment backwards from its end gives the start
    _, back = align(item[::-1], text[:stop][::-1], -edits, 2 * edits + 1)
    return edits, max(0, stop - back), stop


# fixed values: first and last code point of the scripts that put no space between words
SPACELESS = [(0x0E00, 0x0EFF), (0x1000, 0x109F), (0x1780, 0x17FF), (0x2E80, 0x9FFF), (0xF900, 0xFAFF), (0x20000, 0x3FFFF)]


def _inside_word(text: str, at: int) -> bool:
    """Whether a word goes on over this place: both sides are letters or digits of scripts with spaces."""
    sides = text[max(0, at - 1):at], text[at:at + 1]
    return all(c.isalnum() and not any(a <= ord(c) <= b for a, b in SPACELESS) for c in sides if c) and all(sides)


class Short:
    """Exact search for the short items of a block."""

    def __init__(self, items: list[tuple[object, bytes]]):
        self.items = items
        by_text: dict[str, list[int]] = {}
        for n, (_, text) in enumerate(items):
            by_text.setdefault(text.decode("utf-8", "replace"), []).append(n)
        self.machine = ahocorasick.Automaton()
        for text, of in by_text.items():
            self.machine.add_word(text, (len(text), of))
        self.machine.make_automaton()

    def find(self, normalised: bytes) -> dict[int, tuple[int, int, int]]:
        """(edits, start, stop) in bytes of the first place of each item."""
        text, out = normalised.decode("utf-8", "replace"), {}
        for last, (length, of) in self.machine.iter(text):
            start, stop = last + 1 - length, last + 1
            if of[0] not in out and not _inside_word(text, start) and not _inside_word(text, stop):
                first = len(text[:start].encode())
                out.update(dict.fromkeys(of, (0, first, first + len(text[start:stop].encode()))))
        return out


def _search_short(shared, types: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        short = None
        for batch in batches:
            short = short or Short(shared.value)
            rows = [(n, i, *hit) for n, t in enumerate(batch.column(1).to_pylist()) for i, hit in sorted(short.find(normal(t)).items())]
            yield pa.RecordBatch.from_arrays([
                batch.column(0).take(pa.array([r[0] for r in rows], pa.int64())),
                pa.array([short.items[r[1]][0] for r in rows], types.field(1).type),
                *[pa.array([r[2 + j] for r in rows], pa.int64()) for j in range(3)]], schema=types)

    return run


def _search(shared, types: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = shared.value
        for batch in batches:
            texts = [normal(t) for t in batch.column(1).to_pylist()]
            found: dict[tuple[int, int], tuple[int, int, int]] = {}
            for a, b in blocks(texts, 1 << 18):
                for n, item, low in index.candidates(texts[a:b]):
                    held = found.get((a + n, item))
                    if held and held[0] == 0:
                        continue
                    hit = verify(index.texts[item], texts[a + n], low, 2 * int(index.step[item]), int(index.edits[item]))
                    if hit and (held is None or hit < held):
                        found[a + n, item] = hit
            rows = sorted(found)
            yield pa.RecordBatch.from_arrays([
                batch.column(0).take(pa.array([r for r, _ in rows], pa.int64())),
                pa.array([index.ids[i] for _, i in rows], types.field(1).type),
                *[pa.array([found[r][j] for r in rows], pa.int64()) for j in range(3)]], schema=types)

    return run


def leaks(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
    item_col: str = "item_id", item_text_col: str = "text", rate: float = EDIT_RATE, block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """One row for each document row and item it holds: id, item, edits, start and stop.

    An item is held if a region of the text is within ``rate`` times its length in edits; the
    best region is given.  An item under ``MIN_ITEM_BYTES`` is held if it stands in the text
    between word borders, and its first place is given.  Null and blank items are not searched;
    null and empty texts hold none.  Repeated rows give repeated results, items with equal
    texts are all reported.  Other columns are not read.  An empty table or benchmark gives
    no rows.
    """
    from pyspark.sql.pandas.types import to_arrow_type

    spark = docs.sparkSession
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    items = benchmark.select(F.col(item_col).alias("item"), F.col(item_text_col).alias("text"))
    kinds = source.schema["id"].dataType, items.schema["item"].dataType
    types = pa.schema([("id", to_arrow_type(kinds[0])), ("item", to_arrow_type(kinds[1])), ("edits", pa.int64()), ("start", pa.int64()),
                       ("stop", pa.int64())])
    schema = f"id {kinds[0].simpleString()}, item {kinds[1].simpleString()}, edits long, start long, stop long"
    out = spark.createDataFrame([], schema)

    def over(block: list[tuple[object, bytes]]) -> DataFrame:
        return source.mapInArrow(_search(spark.sparkContext.broadcast(Index(block, rate)), types), schema)

    def exactly(block: list[tuple[object, bytes]]) -> DataFrame:
        return source.mapInArrow(_search_short(spark.sparkContext.broadcast(block), types), schema)

    held, size, short, short_size = [], 0, [], 0
    for row in items.where(F.col("text").isNotNull()).toLocalIterator():
        text = normal(row["text"])
        if len(text) < MIN_ITEM_BYTES:
            if short and short_size + len(text) > block_bytes:
                out, short, short_size = out.unionAll(exactly(short)), [], 0
            if text:
                short.append((row["item"], text))
                short_size += len(text)
            continue
        if held and size + len(text) > block_bytes:
            out, held, size = out.unionAll(over(held)), [], 0
        held.append((row["item"], text))
        size += len(text)
    out = out.unionAll(over(held)) if held else out
    out = out.unionAll(exactly(short)) if short else out
    return out.toDF(id_col, item_col, "edits", "start", "stop")
