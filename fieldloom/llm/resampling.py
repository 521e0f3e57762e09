"""Importance resampling toward a target distribution of hashed word runs.

A text's features are its runs of one to ``max_n`` words, hashed into buckets by CRC-32.
An Aho-Corasick dictionary holds distinct words between delimiters, each with the CRC and
length of its bytes as payload.  One scan of a block of texts emits the payloads in order;
words that the dictionary lacks get theirs from their bytes, so the dictionary decides only
how fast a word is read.  The payload of a longer run is composed from its neighbours':
CRC-32 is linear, and crc(xy) follows from crc(x), crc(y) and the length of y alone.

Both corpora are counted whole, partition by partition, into tables of ``buckets`` cells.
The gains of the buckets, as many rows as there are buckets, go back to the tasks, which score
every document.  A Gumbel draw from the id turns weights into a sample without replacement.
"""

from __future__ import annotations

import itertools
import zlib
from collections import Counter
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldloom.llm.common import blocks, raw, stored, total_bytes
from fieldloom.operators.ranking import number_rows

BUCKETS = 10_000
MAX_N = 1
PERCENT = 10
MIN_WORDS = 20
SEED = 2024
DICTIONARY_WORDS = 50_000     # words of the dictionary; any other word is read from its bytes
DICTIONARY_BYTES = 8 << 20    # text of each corpus, taken by hash, that the dictionary is learned from
PIECE_BYTES = 2_000
BLOCK_BYTES = 1 << 20

# fixed values: word bytes are 0-9, a-z and all bytes above 127; A-Z becomes a-z; other bytes delimit
_TO_WORD_BYTES = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b > 127 else 32 for b in range(256))
_POLYNOMIAL = 0xEDB88320


def _times(a: int, b: int) -> int:
    """Product of two polynomials over GF(2) modulo CRC-32's, highest power in bit 0."""
    out = 0
    for k in range(31, -1, -1):
        if b >> k & 1:
            out ^= a
        a = a >> 1 ^ (_POLYNOMIAL if a & 1 else 0)
    return out


def _shift_tables() -> list[list[np.ndarray]]:
    """For each k, tables by byte of the linear map that appends 2**k zero bytes to a CRC."""
    factor = 1 << 31 >> 8    # x**8
    out = []
    for _ in range(32):
        rows = [_times(factor, 1 << bit) for bit in range(32)]
        maps = []
        for byte in range(4):
            t = np.zeros(256, np.uint32)
            for bit in range(8):
                t[np.arange(256) >> bit & 1 == 1] ^= np.uint32(rows[8 * byte + bit])
            maps.append(t)
        out.append(maps)
        factor = _times(factor, factor)
    return out


_SHIFTS = _shift_tables()


def compose(left: np.ndarray, right: np.ndarray, right_len: np.ndarray) -> np.ndarray:
    """CRC-32 of two byte strings put together, from theirs and the second one's length."""
    out = left.astype(np.uint32)
    for k in range(int(right_len.max(initial=0)).bit_length()):
        on = np.flatnonzero(right_len >> k & 1)
        x = out[on]
        a, b, c, d = _SHIFTS[k]
        out[on] = a[x & 255] ^ b[x >> 8 & 255] ^ c[x >> 16 & 255] ^ d[x >> 24]
    return out ^ right


def build(words: list[str]) -> tuple[ahocorasick.Automaton | None, np.ndarray, np.ndarray]:
    """Automaton of the words between delimiters (one character a byte), and their payloads."""
    if not words:
        return None, np.zeros(0, np.uint32), np.zeros(0, np.int64)
    machine = ahocorasick.Automaton(ahocorasick.STORE_INTS)
    for n, w in enumerate(words):
        machine.add_word(f" {w} ", n)
    machine.make_automaton()
    said = [w.encode("latin-1") for w in words]
    return machine, np.array([zlib.crc32(w) for w in said], np.uint32), np.array([len(w) for w in said], np.int64)


def scan(texts: list[bytes], machine, crcs: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(CRC, length, text number) of every word of the texts, in order."""
    joined = b" " + b" ".join(texts) + b" "
    joined = joined.translate(_TO_WORD_BYTES)
    here = np.frombuffer(joined, np.uint8) != 32
    edge = np.flatnonzero(here[1:] != here[:-1]) + 1
    starts, ends = edge[0::2], edge[1::2]
    crc, length, found = np.zeros(len(starts), np.uint32), ends - starts, np.zeros(len(starts), bool)
    if machine is not None and len(starts):
        hits = np.fromiter(itertools.chain.from_iterable(machine.iter(joined.decode("latin-1"))), np.int64).reshape(-1, 2)
        # a hit ends at the delimiter behind its word
        at = np.searchsorted(ends, hits[:, 0])
        crc[at], length[at], found[at] = crcs[hits[:, 1]], lengths[hits[:, 1]], True
    rest = np.flatnonzero(~found)
    crc[rest] = [zlib.crc32(joined[a:b]) for a, b in zip(starts[rest].tolist(), ends[rest].tolist())]
    after = np.cumsum(np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts))) + 1
    return crc, length, np.searchsorted(after, starts, side="right")


def features(crc: np.ndarray, length: np.ndarray, owner: np.ndarray, max_n: int) -> tuple[np.ndarray, np.ndarray]:
    """(CRC, text number) of all runs of one to ``max_n`` words that stay in one text."""
    space, one = np.full(len(crc), zlib.crc32(b" "), np.uint32), np.ones(len(crc), np.int64)
    out, run = [(crc, owner)], crc
    for n in range(1, max_n):
        if len(crc) <= n:
            break
        # each run of n words takes one more word behind it
        run = compose(compose(run[:-1], space[n:], one[n:]), crc[n:], length[n:])
        inside = owner[n:] == owner[:-n]
        out.append((run[inside], owner[n:][inside]))
    return np.concatenate([c for c, _ in out]), np.concatenate([o for _, o in out])


def _sampled(share: float):
    """Words and their counts in pieces of whole texts, some hashed into a share of all."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[str] = Counter()
        for batch in batches:
            for text in raw(batch.column(0)):
                for at in range(0, len(text or b""), PIECE_BYTES):
                    piece = text[at:at + PIECE_BYTES]
                    if zlib.crc32(piece) < share * (1 << 32):
                        # the first and last word may be cut; as entries they are only useless
                        seen.update(w.decode("latin-1") for w in piece.translate(_TO_WORD_BYTES).split(b" ") if 0 < len(w) <= 64)
        yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], ["w", "n"])

    return run


def _dictionary(corpora: list[DataFrame], words: int, size: int) -> list[str]:
    """The most frequent words of a bounded share of each corpus, as characters of one byte."""
    common: set[str] = set()
    for texts in corpora:
        counted = texts.mapInArrow(_sampled(size / max(total_bytes(texts, "text"), 1)), "w string, n long").groupBy("w").agg(F.sum("n").alias("n"))
        # a bounded head of a bounded share: speed only, words outside are read from their bytes
        common |= {r["w"] for r in counted.orderBy(F.desc("n"), "w").limit(words // len(corpora)).collect()}
    return sorted(common)


_BUILT: dict = {"words": None, "dictionary": None}


def built(words: list[str]) -> tuple[ahocorasick.Automaton | None, np.ndarray, np.ndarray]:
    """The dictionary of a list of words, made once in a worker process and kept for its next tasks."""
    if _BUILT["words"] is not words:
        _BUILT.update(words=words, dictionary=build(words))
    return _BUILT["dictionary"]


def _reader(shared, max_n: int):
    """A function of a block of texts that gives (features' CRC, text number, words of each text)."""

    def read(texts: list[bytes]):
        crc, length, owner = scan(texts, *built(shared.value))
        runs, of = features(crc, length, owner, max_n)
        return runs, of, np.bincount(owner, minlength=len(texts))

    return read


def _count(shared, buckets: int, max_n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        read, cells = _reader(shared, max_n), np.zeros(buckets, np.int64)
        for batch in batches:
            texts = [t or b"" for t in raw(batch.column(0))]
            for a, b in blocks(texts, BLOCK_BYTES):
                runs, _, _ = read(texts[a:b])
                cells += np.bincount(runs % np.uint32(buckets), minlength=buckets)
        held = np.flatnonzero(cells)
        yield pa.RecordBatch.from_arrays([pa.array(held, pa.int64()), pa.array(cells[held])], ["bucket", "n"])

    return run


def _weigh(shared, gains, buckets: int, max_n: int, types: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        read = _reader(shared, max_n)
        for batch in batches:
            texts = [t or b"" for t in raw(batch.column(1))]
            for a, b in blocks(texts, BLOCK_BYTES):
                runs, of, n_words = read(texts[a:b])
                n = np.bincount(of, minlength=b - a)
                order = np.argsort(of, kind="stable")
                sums = np.concatenate([[0], np.cumsum(gains.value[(runs % np.uint32(buckets))[order]])])
                ends = np.cumsum(n)
                total = sums[ends] - sums[ends - n]
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).slice(a, b - a), pa.array(n_words.astype(np.int64)), pa.array(n.astype(np.int64)),
                    pa.array(np.where(n > 0, total // np.maximum(n, 1), 0).astype(np.int64))], schema=types)

    return run


def resample(
    docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", target_text: str = "text",
    percent: int = PERCENT, min_words: int = MIN_WORDS, buckets: int = BUCKETS, max_n: int = MAX_N, seed: int = SEED,
    dictionary_words: int = DICTIONARY_WORDS,
) -> DataFrame:
    """One row for each input row: id, n_words, n_features, weight, score and rank.

    weight is the floored mean of the gains of a document's features (0 without any), score adds
    the Gumbel noise of the id, rank numbers the drawn documents from 1 by falling score, then
    smaller id; of all documents with at least ``min_words`` words, ``percent`` of a hundred are
    drawn, and others have a null rank.  A null text has no words.  Repeated rows count and are
    drawn each on its own, in any order among themselves; a null id draws as an empty one and
    ranks behind equal scores.  Other columns are not read.  An empty table gives no rows; an
    empty target leaves gains that hang on the documents alone.
    """
    from pyspark.sql.pandas.types import to_arrow_type

    spark = docs.sparkSession
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    wanted = target.select(F.col(target_text).alias("text"))
    shared = spark.sparkContext.broadcast(_dictionary([source.select("text"), wanted], dictionary_words, DICTIONARY_BYTES))
    counted = lambda df, name: df.mapInArrow(_count(shared, buckets, max_n), "bucket long, n long").groupBy("bucket").agg(
        F.sum("n").cast("double").alias(name))
    cells = stored(counted(source.select("text"), "s").join(counted(wanted, "t"), "bucket", "full"), "resample-cells")
    sizes = cells.agg(F.coalesce(F.sum("s"), F.lit(0.0)), F.coalesce(F.sum("t"), F.lit(0.0))).first()
    over, under = (F.coalesce(c, F.lit(0.0)) + 1 for c in ("t", "s"))
    gain = F.floor(F.lit(1000.0) * F.log(over * F.lit(sizes[0] + buckets) / (under * F.lit(sizes[1] + buckets))))
    # one row for each bucket: as many as the parameter says
    every = spark.range(buckets).select(F.col("id").alias("bucket")).join(cells, "bucket", "left").select("bucket", gain.alias("gain"))
    gains = np.zeros(buckets, np.int64)
    for row in every.collect():
        gains[row["bucket"]] = row["gain"]
    kind = source.schema["id"].dataType
    types = pa.schema([("id", to_arrow_type(kind)), ("n_words", pa.int64()), ("n_features", pa.int64()), ("weight", pa.int64())])
    weighed = source.mapInArrow(
        _weigh(shared, spark.sparkContext.broadcast(gains), buckets, max_n, types),
        f"id {kind.simpleString()}, n_words long, n_features long, weight long")
    said = F.sha2(F.encode(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit(""))), "utf-8"), 256)
    h = F.conv(F.substring(said, 1, 8), 16, 10).cast("double")
    gumbel = F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / F.lit(4294967296.0))))
    # written with a number of the row's own, which keeps repeated rows apart in every later sort
    scored = stored(weighed.select("*", (F.col("weight") + gumbel).alias("score"), F.monotonically_increasing_id().alias("row")), "resample-scores")
    able = scored.where(F.col("n_words") >= min_words)
    # scores are thousandths of a logarithm: some ten thousand different ones at any size
    by_score = stored(able.groupBy("score").agg(F.count("*").alias("n")), "resample-levels")
    drawn = by_score.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0] * percent // 100
    left, cut = drawn, None
    for row in by_score.orderBy(F.desc("score")).collect():
        if left <= 0:
            break
        left, cut = left - row["n"], row["score"]
    rank = F.lit(None).cast("long").alias("rank")
    columns = ["id", "n_words", "n_features", "weight", "score"]
    if cut is None:
        return scored.select(*columns, rank).withColumnRenamed("id", id_col)
    taken = (F.col("n_words") >= min_words) & (F.col("score") >= cut)
    order = [F.desc("score"), F.asc_nulls_last("id"), F.asc("row")]
    numbered = number_rows(scored.where(taken).select(*columns, "row"), order, "at")
    ranked = numbered.select(*columns, F.when(F.col("at") <= drawn, F.col("at")).cast("long").alias("rank"))
    return ranked.unionByName(scored.where(~taken).select(*columns, rank)).withColumnRenamed("id", id_col)
