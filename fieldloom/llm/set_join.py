"""N-gram Jaccard join by set relations: skipping in the index lists, and between answers.

A text's set is its distinct word shingles in one order for all sets: by how often a shingle's
cell of a counting sketch was hit in all texts, then by hash.  Sets at the least similarity
share a shingle among the first fifth of both (the prefix), so an index list holds, for a
shingle, the sets that have it in their prefix, with the place it has there.  Equal sets are
one class, and only shingles that two classes may share enter the index.

Relations in a list.  Its rows stand in blocks by place.  A set looks in a block only at the
sizes that can still reach the similarity from both places, found by binary search, and it
skips a block, and all behind it, once no size can.  Sets that meet in a list, at first or
second hand, are joined to the one with the least key, so a list gives no more links than it has
rows, and lists of the same sets give the same ones; the components of these links are groups
that no similar pair leaves.  The lists are dealt and sorted once and not kept: what is left of
them is the links, with how many lists of a task gave each.

Relations between sets.  Most sets of a large group are highly similar to one hub, the set that
most of their lists join them to: each is compared with one, first by bitmaps, and who is similar
is in its component.  What is left of a
group is compared across components only, so tiles of its largest component never meet each
other: first by bitmaps whose difference is a lower bound of the sets', which leave smaller
groups, then by the sets.  Only sets that a bitmap leaves with another are made whole and
shuffled.  In a task, a set's overlaps with all others are derived from those of the most similar
set computed before: only the shingles in which the two differ are looked up.  Sets whose
others are all in their component need no answer.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldloom.llm import sketches
from fieldloom.llm.common import blocks, mix, power_of_two, raw, span_hashes, stored, word_hashes, words
from fieldloom.llm.components import components

SHINGLE = 5
COUNT_BITS = 18       # cells of the sketch that orders shingles; a segment of it is merged by one task
SEGMENT_BITS = 14
TILE = 1 << 22        # shingles of a hub's rows, or of one side of a group, in one task
ROW_COST = 256        # shingles that a set counts for besides its own, so that a tile has few rows
LEADERS = 64          # sets of a tile whose answers are kept for others
_U = np.uint64


def shingle_sets(texts: list[bytes], size: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text; A-Z is lower-cased, a shorter text is one shingle."""
    joined, starts, ends, owner = words([t.lower() for t in texts])
    first = np.searchsorted(owner, np.arange(len(texts) + 1))
    values = word_hashes(joined, starts, ends)
    count = np.diff(first)
    span = np.minimum(size, count)
    n = np.where(count > 0, count - span + 1, 0)
    offset = np.concatenate([[0], np.cumsum(n)])
    at = np.repeat(first[:-1] - offset[:-1], n) + np.arange(offset[-1])
    hashes = span_hashes(values, at, at + np.repeat(span, n))
    return [np.unique(hashes[a:b]) for a, b in zip(offset[:-1].tolist(), offset[1:].tolist())]


def set_key(one: np.ndarray) -> int:
    """One number for a set of shingles."""
    return int((mix(mix(one).sum(dtype=np.uint64, keepdims=True) + _U(len(one)))).view(np.int64)[0])


def _binaries(parts: list[np.ndarray | None]) -> pa.Array:
    return pa.array([None if p is None else p.tobytes() for p in parts], pa.binary())


def _classes(size: int, types: pa.Schema):
    """Key and size of each text's set, and at the end the partition's shingles counted by cell."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells, like = np.zeros(1 << COUNT_BITS, np.int64), None
        for batch in batches:
            like = batch.column(0).type
            texts = [t or b"" for t in raw(batch.column(1))]
            for a, b in blocks(texts):
                sets = shingle_sets(texts[a:b], size)
                every = np.concatenate(sets)
                cells += np.bincount((every >> _U(64 - COUNT_BITS)).astype(np.int64), minlength=len(cells))
                n = len(sets)
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).slice(a, n), batch.column(2).slice(a, n), pa.array([set_key(s) for s in sets], pa.int64()),
                    pa.array([len(s) for s in sets], pa.int64()), pa.nulls(n, pa.int32()), pa.nulls(n, pa.binary())], schema=types)
        if like is not None:
            parts = cells.reshape(-1, 1 << SEGMENT_BITS)
            n = len(parts)
            yield pa.RecordBatch.from_arrays([
                pa.nulls(n, like), pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64()),
                pa.array(np.arange(n), pa.int32()), _binaries(list(parts))], schema=types)

    return run


def _add_segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[int, np.ndarray] = {}
    for batch in batches:
        for n, cells in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            held[n] = held.get(n, 0) + np.frombuffer(cells, np.int64)
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.int32()), _binaries(list(held.values()))], ["segment", "cells"])


def shingle_levels(own: DataFrame) -> np.ndarray:
    """How common the shingles of each cell are over all texts, as quarters of a power of two."""
    parts = own.where("segment is not null").select("segment", "cells")
    merged = parts.repartition(1 << (COUNT_BITS - SEGMENT_BITS), "segment").mapInArrow(_add_segments, "segment int, cells binary")
    total = np.zeros(1 << COUNT_BITS, np.int64)
    for row in merged.collect():
        at = row["segment"] << SEGMENT_BITS
        total[at:at + (1 << SEGMENT_BITS)] = np.frombuffer(row["cells"], np.int64)
    return np.floor(4 * np.log2(1 + total)).astype(np.uint64)


def in_order(one: np.ndarray, levels: np.ndarray) -> np.ndarray:
    """A set's shingles, seldom ones first."""
    level = levels[(one >> _U(64 - COUNT_BITS)).astype(np.int64)]
    return one[np.argsort((level << _U(56)) | (one >> _U(8)), kind="stable")]


def _chosen_sets(size: int, shared, bits: int):
    """A function of a batch (text, row hash) that gives the sets of the rows that the sketch may hold."""

    def read(batch: pa.RecordBatch) -> Iterator[list[np.ndarray]]:
        held = sketches.has(shared.value, batch.column(1).to_numpy().view(np.uint64) >> _U(64 - bits))
        texts = [t or b"" for t in raw(batch.column(0).filter(pa.array(held)))]
        for a, b in blocks(texts):
            yield [s for s in shingle_sets(texts[a:b], size) if len(s)]

    return read


def _prefixes(size: int, shared, bits: int, levels):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        read = _chosen_sets(size, shared, bits)
        for batch in batches:
            for sets in read(batch):
                yield pa.RecordBatch.from_arrays([
                    pa.array([set_key(s) for s in sets], pa.int64()), pa.array([len(s) for s in sets], pa.int64()),
                    _binaries([in_order(s, levels.value)[:len(s) // 5 + 1] for s in sets]), _binaries([parity(s) for s in sets])],
                    ["key", "n", "prefix", "parity"])

    return run


def _member_sets(size: int, shared, bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        read = _chosen_sets(size, shared, bits)
        for batch in batches:
            for sets in read(batch):
                yield pa.RecordBatch.from_arrays([pa.array([set_key(s) for s in sets], pa.int64()), _binaries([packed(s) for s in sets])], ["key", "set"])

    return run


def parity(one: np.ndarray) -> np.ndarray:
    """One bit for each shingle or two: whether an odd number of a set's shingles fall on it.

    Two sets differ in at least as many shingles as these bits differ; a wider one is folded to
    the width of the other by an exclusive or of its halves.
    """
    width = 1 << max(6, int(len(one) - 1).bit_length())
    return np.packbits(np.bincount((one & _U(width - 1)).astype(np.int64), minlength=width) & 1)


def packed(one: np.ndarray) -> np.ndarray:
    """A sorted set's shingles by their first six bytes, which sort alike."""
    return np.ascontiguousarray(one.astype(">u8").view(np.uint8).reshape(-1, 8)[:, :6])


def unpacked(data: bytes) -> np.ndarray:
    wide = np.zeros((len(data) // 6, 8), np.uint8)
    wide[:, :6] = np.frombuffer(data, np.uint8).reshape(-1, 6)
    return wide.view(">u8").reshape(-1).astype(np.uint64)


def _fill(bits: int):
    """A partition's prefix shingles as a sketch of cells hit once and twice."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        once = twice = np.zeros(0, np.uint64)
        for batch in batches:
            cells = np.frombuffer(b"".join(batch.column(0).to_pylist()), np.uint64) >> _U(64 - bits)
            new, n = np.unique(cells, return_counts=True)
            twice = np.union1d(np.union1d(twice, new[n > 1]), np.intersect1d(once, new, assume_unique=True))
            once = np.union1d(once, new)
        yield from sketches.segments(once, twice, bits)

    return run


def _entries(shared, bits: int):
    """Index rows of the prefix shingles that more than one class may have."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key, n = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            prefixes = batch.column(2).to_pylist()
            count = np.array([len(p) // 8 for p in prefixes], np.int64)
            token = np.frombuffer(b"".join(prefixes), np.uint64)
            of = np.repeat(np.arange(len(count)), count)
            place = np.arange(len(token)) - np.repeat(np.cumsum(count) - count, count)
            held = sketches.has(shared.value, token >> _U(64 - bits))
            yield pa.RecordBatch.from_arrays([
                pa.array(token[held].view(np.int64)), pa.array(key[of[held]]), pa.array(n[of[held]]), pa.array(place[held])],
                ["token", "key", "n", "place"])

    return run


def block_ranges(group, place, n) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(row, first, count): the rows of one block behind each row that places and sizes leave.

    Rows are sorted by group, place and size.
    """
    new = np.concatenate([[True], (group[1:] != group[:-1]) | (place[1:] != place[:-1])])
    block = np.cumsum(new) - 1
    first = np.flatnonzero(new)
    block_group, block_place = group[first], place[first]
    sorted_by = block.astype(np.int64) << 32 | n
    most = (5 * n - 9 * place) // 4
    alive, ahead = np.arange(len(group)), 0
    while len(alive):
        target = block[alive] + ahead
        inside = target < len(first)
        alive, target = alive[inside], target[inside]
        # another group's block, or one from which no size can reach the similarity: all behind it are skipped
        least = -((-(4 * n[alive] + 9 * block_place[target])) // 5)
        on = (block_group[target] == group[alive]) & (least <= most[alive])
        alive, target, least = alive[on], target[on], least[on]
        if not len(alive):
            return
        low = np.searchsorted(sorted_by, target << 32 | least)
        high = np.searchsorted(sorted_by, target << 32 | most[alive], side="right")
        if ahead == 0:
            low = np.maximum(low, alive + 1)
        yield alive, low, np.maximum(high - low, 0)
        ahead += 1


def meeting(group, place, n) -> np.ndarray:
    """For each row the first row of those it meets, at first or second hand, in its list."""
    label = np.arange(len(group))
    joined = np.zeros(len(group) + 1, np.int64)
    left, right = [], []
    for alive, low, count in block_ranges(group, place, n):
        on = count > 0
        left.append(alive[on])
        right.append(low[on])
        # the rows of a range are neighbours: each is joined to the one before it
        np.add.at(joined, low[on] + 1, 1)
        np.add.at(joined, low[on] + count[on], -1)
    chained = np.flatnonzero(np.cumsum(joined)[:-1] > 0)
    a, b = np.concatenate([*left, chained]).astype(np.int64), np.concatenate([*right, chained - 1]).astype(np.int64)
    while True:
        least = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, label[a], least)
        np.minimum.at(new, label[b], least)
        np.minimum.at(new, a, least)
        np.minimum.at(new, b, least)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def list_links(token, place, n, key) -> list[np.ndarray]:
    """Links (u, v, nu, nv, c) of some whole lists, sorted by token, place, size and key: u has the least key of the rows that v meets,
    at first or second hand, in c lists where their places and sizes leave them.
    """
    # equal rows of the input enter once
    new = np.concatenate([[True], (token[1:] != token[:-1]) | (key[1:] != key[:-1])])
    token, place, n, key = token[new], place[new], n[new], key[new]
    first = meeting(np.cumsum(np.concatenate([[True], token[1:] != token[:-1]])), place, n)
    order = np.lexsort((key, first))
    lead = np.flatnonzero(np.concatenate([[True], first[order][1:] != first[order][:-1]]))
    u, v = np.repeat(order[lead], np.diff(np.append(lead, len(order)))), order
    u, v = u[u != v], v[u != v]
    reach = 9 * np.minimum(n[u] - place[u], n[v] - place[v]) >= 4 * (n[u] + n[v])
    order = np.lexsort((key[v], key[u]))
    u, v, reach = u[order], v[order], reach[order]
    new = np.concatenate([np.ones(min(1, len(u)), bool), (key[u][1:] != key[u][:-1]) | (key[v][1:] != key[v][:-1])])
    c = np.bincount(np.cumsum(new) - 1, reach, minlength=int(new.sum())).astype(np.int64)
    return [key[u[new]], key[v[new]], n[u[new]], n[v[new]], c]


def _meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The links of the lists of a sorted partition; some whole lists at a time."""

    def solve(rows: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in list_links(*rows)], ["u", "v", "nu", "nv", "c"])

    rest: list[np.ndarray] | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        rows = [c.to_numpy(zero_copy_only=False).astype(np.int64) for c in batch.columns]
        rest = rows if rest is None else [np.concatenate(x) for x in zip(rest, rows)]
        if len(rest[0]) < 1 << 17:
            continue
        last = np.flatnonzero(rest[0][1:] != rest[0][:-1])
        cut = int(last[-1]) + 1 if len(last) else 0
        if cut:
            yield from solve([r[:cut] for r in rest])
            rest = [r[cut:] for r in rest]
    if rest is not None and len(rest[0]):
        yield from solve(rest)


def _overlaps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The overlap of each row's set with the hub's, which stands before its rows."""
    hub, own, last = None, np.zeros(0, np.uint64), None
    for batch in batches:
        u, chunk, is_hub, key = (batch.column(n).to_pylist() for n in range(4))
        out_u, out_v, out_n = [], [], []
        for k, data in enumerate(batch.column(4)):
            one = unpacked(data.as_buffer())
            if is_hub[k] == 0:
                hub, own, last = (u[k], chunk[k]), one, None
            elif hub == (u[k], chunk[k]) and key[k] != last:
                last = key[k]
                at = np.searchsorted(own, one)
                at[at == len(own)] = 0
                out_u.append(u[k])
                out_v.append(key[k])
                out_n.append(int((own[at] == one).sum()))
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (out_u, out_v, out_n)], ["u", "v", "inter"])


def overlaps(pairs: DataFrame, sets: DataFrame, tile: int) -> DataFrame:
    """(u, v, nu, nv, inter) of pairs (u, v, nu, nv) of hubs u; a hub of many pairs is dealt over chunks."""
    chunks = stored(pairs.groupBy("u").agg(F.ceil(F.sum("nv") / tile).cast("int").alias("chunks")), "set-chunks")
    dealt = pairs.join(chunks, "u").select("u", F.pmod(F.xxhash64("v"), F.col("chunks")).cast("int").alias("chunk"), F.lit(1).alias("part"), "v")
    hubs = chunks.select("u", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"), F.lit(0).alias("part"), F.col("u").alias("v"))
    rows = dealt.unionByName(hubs).join(sets, F.col("v") == F.col("key")).select("u", "chunk", "part", "key", "set")
    counted = rows.repartition("u", "chunk").sortWithinPartitions("u", "chunk", "part", "key").mapInArrow(
        _overlaps, "u long, v long, inter long")
    return counted.join(pairs, ["u", "v"]).select("u", "v", "nu", "nv", "inter")


def similar(inter: Column, nu: Column, nv: Column) -> Column:
    """100 * intersection >= 80 * union, in sizes."""
    return 9 * inter >= 4 * (nu + nv)


def _hub_pairs(meets: DataFrame) -> DataFrame:
    """For each set the hub that most of its lists join it to: (u, v, nu, nv), u the hub."""
    named = meets.where("c > 0").groupBy("v", "nv", "u", "nu").agg(F.sum("c").alias("c"))
    return named.groupBy("v", "nv").agg(F.max(F.struct("c", "u", "nu")).alias("b")).select("b.u", "v", "b.nu", "nv")


def _alike(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The pairs (u, v, nu, nv) whose parities leave them similar."""
    for batch in batches:
        sizes = batch.column(2).to_numpy() + batch.column(3).to_numpy()
        on = []
        for both, a, b in zip(sizes.tolist(), batch.column(4), batch.column(5)):
            a, b = np.frombuffer(a.as_buffer(), np.uint64), np.frombuffer(b.as_buffer(), np.uint64)
            while len(a) != len(b):
                a, b = (a, b) if len(a) > len(b) else (b, a)
                a = a[:len(a) // 2] ^ a[len(a) // 2:]
            on.append(9 * int(np.bitwise_count(a ^ b).sum()) <= both)
        yield batch.select([0, 1, 2, 3]).filter(pa.array(on, pa.bool_()))


def alike_pairs(pairs: DataFrame, parities: DataFrame) -> DataFrame:
    """Those of the pairs (u, v, nu, nv) that the parities (key, parity) of their sets leave similar."""
    of = lambda c: parities.select(F.col("key").alias(c), F.col("parity").alias(f"p{c}"))
    return pairs.join(of("u"), "u").join(of("v"), "v").select("u", "v", "nu", "nv", "pu", "pv").mapInArrow(_alike, "u long, v long, nu long, nv long")


def similar_links(key: np.ndarray, side: np.ndarray, root: np.ndarray, n: np.ndarray, data: list[bytes]) -> tuple[list[int], list[int]]:
    """Spanning links of the similar sets of a tile: rows of different roots, and of different sides but for side -1."""
    sets = [unpacked(x) for x in data]
    size = np.array([len(s) for s in sets], np.int64)
    order = np.argsort(size, kind="stable")
    key, side, root, size = key[order], side[order], root[order].copy(), size[order]
    offset = np.concatenate([[0], np.cumsum(size)])
    known, codes = np.unique(np.concatenate([sets[n] for n in order]), return_inverse=True)
    # the rows of each shingle, and where they begin
    holders = np.repeat(np.arange(len(size)), size)[np.argsort(codes, kind="stable")]
    begins = np.concatenate([[0], np.cumsum(np.bincount(codes, minlength=len(known)))])

    def overlap(some: np.ndarray) -> np.ndarray:
        count = begins[some + 1] - begins[some]
        at = np.repeat(begins[some] - (np.cumsum(count) - count), count) + np.arange(count.sum())
        return np.bincount(holders[at], minlength=len(size))

    leaders: list[tuple[int, np.ndarray]] = []
    u, v = [], []
    for i in range(len(size) - 1):
        # a set longer than this cannot be similar
        stop = int(np.searchsorted(size, size[i] * 5 // 4, side="right"))
        apart = root[i + 1:stop] != root[i]
        if side[i] >= 0:
            apart &= side[i + 1:stop] != side[i]
        if not apart.any():
            continue
        own = codes[offset[i]:offset[i + 1]]
        unlike, best = int(size[i]), None
        for leader in leaders:
            differ = int(size[i] + size[leader[0]] - 2 * leader[1][i])
            if differ < unlike:
                unlike, best = differ, leader
        if best is None:
            shared = overlap(own)
        else:
            other = codes[offset[best[0]]:offset[best[0] + 1]]
            shared = best[1] + overlap(np.setdiff1d(own, other, assume_unique=True)) - overlap(np.setdiff1d(other, own, assume_unique=True))
        if unlike * 8 > size[i]:
            leaders = [*leaders[-LEADERS + 1:], (i, shared)]
        near = apart & (9 * shared[i + 1:stop] >= 4 * (size[i] + size[i + 1:stop]))
        for j in (np.flatnonzero(near) + i + 1).tolist():
            if root[j] != root[i]:
                u.append(int(key[i]))
                v.append(int(key[j]))
                root[root == root[j]] = root[i]
    return u, v


def alike_links(key: np.ndarray, side: np.ndarray, root: np.ndarray, n: np.ndarray, bits: list[bytes]) -> tuple[list[int], list[int]]:
    """Spanning links of the sets of a tile whose parities leave them similar, by the roots and sides of ``similar_links``."""
    order = np.argsort(n, kind="stable")
    key, side, root, n = key[order], side[order], root[order], n[order]
    rows = [np.frombuffer(bits[k], np.uint64) for k in order.tolist()]
    width = np.array([len(r) for r in rows])
    label, u, v = np.arange(len(n)), [], []
    for w in np.unique(width).tolist():
        # rows in order of size: those of this width, then those of twice the width, folded; no others are near in size
        low, middle, high = (int(np.searchsorted(width, x, side)) for x, side in ((w, "left"), (w, "right"), (2 * w, "right")))
        wide = [r[:w] ^ r[w:] for r in rows[middle:high]]
        table = np.stack(rows[low:middle] + wide)
        for i in range(low, middle):
            stop = min(high, int(np.searchsorted(n, n[i] * 5 // 4, side="right")))
            apart = (root[i + 1:stop] != root[i]) & (label[i + 1:stop] != label[i])
            if side[i] >= 0:
                apart &= side[i + 1:stop] != side[i]
            at = np.flatnonzero(apart) + i + 1
            if not len(at):
                continue
            differ = np.bitwise_count(table[at - low] ^ table[i - low]).sum(axis=1, dtype=np.int64)
            for j in at[9 * differ <= n[i] + n[at]].tolist():
                if label[j] != label[i]:
                    u.append(int(key[i]))
                    v.append(int(key[j]))
                    label[label == label[j]] = label[i]
    return u, v


def _per_tile(find):
    """Links that ``find`` gives for the rows (key, side, root, n, data) of each (group, tile) of a sorted partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list] = []
        now = None

        def solve() -> pa.RecordBatch:
            u, v = find(*(np.array(x, np.int64) for x in list(zip(*held))[:4]), [x[4] for x in held])
            return pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], ["u", "v"])

        for batch in batches:
            for grp, tile, *row in zip(*(c.to_pylist() for c in batch.columns)):
                if now != (grp, tile):
                    if len(held) > 1:
                        yield solve()
                    held, now = [], (grp, tile)
                # a row that is there twice is one set
                if not held or held[-1][0] != row[0]:
                    held.append(row)
        if len(held) > 1:
            yield solve()

    return run


def _group_links(members: DataFrame, data: DataFrame, cost: Column, tile: int, find) -> DataFrame:
    """Links (u, v) that ``find`` gives for the members (grp, key, n, root) of all groups, with their data (key, data).

    A group that fits one tile is compared there.  Of a larger one, the largest component is
    dealt over tiles and the other rows go to each of them; these meet each other in tile pairs.
    """
    by_root = members.groupBy("grp", "root").agg(F.sum(cost).alias("c"))
    large = by_root.groupBy("grp").agg(F.sum("c").alias("all"), F.max("c").alias("most"), F.max_by("root", F.struct("c", "root")).alias("main"))
    # a group of one component has no links to find
    plan = stored(large.where("all > most").select(
        "grp", "main", F.when(F.col("all") > tile, F.ceil(F.col("most") / tile)).otherwise(0).cast("int").alias("mains"),
        F.when(F.col("all") > tile, F.ceil((F.col("all") - F.col("most")) / tile)).otherwise(1).cast("int").alias("others")), "set-groups")
    at = lambda c: F.pmod(F.xxhash64("key"), F.col(c)).cast("int")
    spot = lambda t, side: F.struct(t.cast("int").alias("tile"), side.cast("int").alias("side"))
    own, in_main = at("others"), F.col("root") == F.col("main")
    apart = F.transform(F.sequence(F.lit(0), F.col("others") - 1), lambda t: spot(
        F.col("mains") + F.least(t, own) * F.col("others") + F.greatest(t, own),
        F.when(t == own, F.lit(-1)).when(own < t, F.lit(0)).otherwise(F.lit(1))))
    to_mains = F.transform(F.sequence(F.lit(0), F.col("mains") - 1), lambda t: spot(t, F.lit(1)))
    tiles = (
        F.when(F.col("mains") == 0, F.array(spot(F.lit(0), F.lit(-1))))
        .when(in_main, F.array(spot(at("mains"), F.lit(0)))).otherwise(F.concat(to_mains, apart)))
    dealt = members.join(plan, "grp").select("grp", F.inline(tiles), "key", "root", "n")
    rows = dealt.join(data, "key").select("grp", "tile", "key", "side", "root", "n", "data")
    return rows.repartition("grp", "tile").sortWithinPartitions("grp", "tile", "key").mapInArrow(_per_tile(find), "u long, v long")


def set_join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SHINGLE, tile: int = TILE) -> DataFrame:
    """One row for each input row: id, n_shingles and component_id.

    A-Z is lower-cased, words are split at ASCII whitespace, shingles are ``size`` words (a
    shorter text is one shingle).  Two texts link if the Jaccard similarity of their sets of
    shingles is 0.8 or more.  Null, empty and blank texts have no shingle and link to nothing.
    component_id is the smallest id of the documents reachable over links, itself included; a
    null id never is, unless its component has no other.  Repeated rows share their class.
    Shingles are compared by 48 bits of hash and more within a pair.  Other columns are not read.  An empty table
    gives no rows.
    """
    from pyspark.sql.pandas.types import to_arrow_type

    context = docs.sparkSession.sparkContext
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.coalesce(F.xxhash64(F.col(text_col)), F.lit(0)).alias("text_hash"))
    kind = source.schema["id"].dataType
    types = pa.schema([
        ("id", to_arrow_type(kind)), ("text_hash", pa.int64()), ("key", pa.int64()), ("n", pa.int64()), ("segment", pa.int32()), ("cells", pa.binary())])
    own = stored(source.mapInArrow(
        _classes(size, types), f"id {kind.simpleString()}, text_hash long, key long, n long, segment int, cells binary"), "set-classes")
    levels = context.broadcast(shingle_levels(own))
    rows = own.where("key is not null").select("id", "key", "n", "text_hash")
    # one row stands for all of equal sets; known ids first
    classes = stored(rows.where("n > 0").groupBy("key").agg(
        F.min(F.struct(F.col("id").isNull().alias("none"), "id", "text_hash")).alias("least")).select(
            "key", "least", F.xxhash64("least.id", "least.text_hash").alias("row_hash")), "set-least")
    texts = source.select("text", F.xxhash64("id", "text_hash").alias("row_hash"))
    shared, bits = _key_sketch(classes, "row_hash")
    prefixes = stored(texts.mapInArrow(_prefixes(size, shared, bits, levels), "key long, n long, prefix binary, parity binary"), "set-prefixes")
    total = int(prefixes.agg(F.coalesce(F.sum(F.octet_length("prefix")), F.lit(0))).first()[0])
    bits = power_of_two(total, 12, sketches.MAX_BITS)
    shared = context.broadcast(sketches.twice_bits(prefixes.select("prefix").mapInArrow(_fill(bits), sketches.SEGMENTS), bits))
    entries = prefixes.select("key", "n", "prefix").mapInArrow(_entries(shared, bits), "token long, key long, n long, place long")
    lists = entries.repartition("token").sortWithinPartitions("token", "place", "n", "key").select("token", "place", "n", "key")
    meets = stored(lists.mapInArrow(_meet, "u long, v long, nu long, nv long, c long"), "set-meets")
    groups = components(meets.select("u", "v")).select(F.col("node").alias("key"), F.col("root").alias("grp"))
    # rows that meet none can never link
    members = stored(prefixes.select("key", "n", "parity").dropDuplicates(["key"]).join(groups, "key"), "set-members")
    pairs = stored(alike_pairs(_hub_pairs(meets), members), "set-hub-pairs")

    def sets_of(keys: DataFrame) -> DataFrame:
        """The sets of these keys and of few others."""
        shared, bits = _key_sketch(classes.join(keys, "key", "left_semi"), "row_hash", 64)
        return texts.mapInArrow(_member_sets(size, shared, bits), "key long, set binary")

    ends = pairs.select(F.explode(F.array("u", "v")).alias("key"))
    near = overlaps(pairs, sets_of(ends), tile).where(similar(F.col("inter"), F.col("nu"), F.col("nv")))
    links = stored(near.select("u", "v"), "set-links")
    roots = components(links).select(F.col("node").alias("key"), "root")
    rooted = stored(members.join(roots, "key", "left").select("key", "grp", "n", F.coalesce("root", "key").alias("root")), "set-rooted")
    # first by parities, a fiftieth of the sets: who may be similar to whom makes smaller groups
    alike = stored(_group_links(
        rooted, members.select("key", F.col("parity").alias("data")), F.ceil(F.col("n") / 32) + ROW_COST // 4, tile, alike_links), "set-alike")
    closer = components(alike).select(F.col("node").alias("key"), F.col("root").alias("grp"))
    rooted = stored(rooted.drop("grp").join(closer, "key"), "set-closer")
    more = stored(_group_links(
        rooted, sets_of(rooted).select("key", F.col("set").alias("data")), F.col("n") + ROW_COST, tile, similar_links), "set-more-links")
    final = stored(components(links.unionByName(more)), "set-final")
    linked = classes.join(final, classes.key == final.node, "left").select("key", "least", F.coalesce("root", "key").alias("root"))
    named = linked.groupBy("root").agg(F.min("least").alias("b")).select("root", F.col("b.id").alias("component_id"))
    by_class = stored(linked.join(named, "root").select(F.col("key").alias("class_key"), "component_id"), "set-components")
    whole = rows.where("n > 0").join(by_class, F.col("key") == F.col("class_key")).select("id", "n", "component_id")
    alone = rows.where("n = 0").select("id", "n", F.col("id").alias("component_id"))
    return whole.unionByName(alone).toDF(id_col, "n_shingles", "component_id")


def _key_sketch(rows: DataFrame, column: str, cells: int = 16):
    """A broadcast sketch of a column of hashes, of ``cells`` a row, and its bits: no false negative, so readers lose no row."""
    bits = power_of_two(cells * rows.count(), 12, sketches.MAX_BITS)
    # each hash enters as seen twice, which is what the sketch is asked for
    parts = rows.select(column).mapInArrow(_fill_keys(bits), sketches.SEGMENTS)
    return rows.sparkSession.sparkContext.broadcast(sketches.twice_bits(parts, bits)), bits


def _fill_keys(bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = np.zeros(0, np.uint64)
        for batch in batches:
            cells = np.union1d(cells, batch.column(0).to_numpy().view(np.uint64) >> _U(64 - bits))
        yield from sketches.segments(cells, cells, bits)

    return run
