"""The Jaccard join against all pairs of sets."""

import os
import re

import numpy as np
import pytest

from fieldloom.llm.set_join import alike_links, block_ranges, list_links, meeting, packed, parity, set_join, similar_links
from tests.llm.helpers import SF_DIR, documents

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    return {" ".join(w[i:i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute(rows):
    """(id, set size, smallest id reachable) of each row; every pair of distinct sets that share a shingle is compared."""
    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    first, holders, done = {}, {}, set()
    for i, s in enumerate(sets):
        j = first.setdefault(frozenset(s), i) if s else i
        if j != i:
            root[find(i)] = find(j)
            continue
        for x in s:
            holders.setdefault(x, []).append(i)
    for of in holders.values():
        for a in range(len(of)):
            for b in range(a):
                pair = (of[b], of[a])
                if pair not in done:
                    done.add(pair)
                    u, v = sets[pair[0]], sets[pair[1]]
                    if 100 * len(u & v) >= 80 * len(u | v):
                        root[find(pair[0])] = find(pair[1])
    least = {}
    for i, (d, _) in enumerate(rows):
        r = find(i)
        least[r] = min((x for x in (least.get(r), d) if x is not None), default=None)
    return sorted(((d, len(sets[i]), least[find(i)]) for i, (d, _) in enumerate(rows)), key=repr)


def answer(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def edited(rng, words, n):
    out = list(words)
    for at in rng.integers(0, len(out), n):
        out[at] = f"new{rng.integers(0, 10**9)}"
    return out


def groups(seed):
    """Groups about the limit of similarity: chains, long and short texts, a passage in half of all texts."""
    rng = np.random.default_rng(seed)
    banner = [f"banner{n}" for n in range(30)]
    rows = []
    for _ in range(12):
        base = [f"w{rng.integers(0, 5000)}" for _ in range(int(rng.choice([4, 5, 6, 9, 40, 120, 300])))]
        for _ in range(int(rng.integers(1, 14))):
            base = edited(rng, base, int(rng.integers(0, 2 + len(base) // 40)))
            rows.append(" ".join(banner * int(rng.integers(0, 2)) + base))
    rows += ["", None, "  \n", "A b", "a B", "a b c d", "a b c d e", "one", " ".join(banner), rows[0], rows[0]]
    ids = rng.permutation(len(rows) * 3)[: len(rows)]
    return [(int(i), t) for i, t in zip(ids, rows)]


@pytest.mark.parametrize("seed,tile", [(1, 1 << 20), (3, 700)])
def test_equals_all_pairs(spark, seed, tile):
    rows = groups(seed)
    assert answer(set_join(documents(spark, rows), tile=tile)) == brute(rows)


@pytest.mark.parametrize("leaders", [1, 64])
def test_derived_answers_link_like_counted_ones(monkeypatch, leaders):
    from fieldloom.llm import set_join as module

    monkeypatch.setattr(module, "LEADERS", leaders)
    rng = np.random.default_rng(12)
    for _ in range(40):
        size = int(rng.choice([8, 70, 150]))
        base = rng.integers(0, 1 << 63, size).astype(np.uint64)
        sets = [np.unique(np.where(rng.random(size) < rng.choice([0.02, 0.1, 0.3]), rng.integers(0, 1 << 63, size).astype(np.uint64), base))[:int(rng.integers(size * 2 // 3, size + 1))]
                for _ in range(25)]
        side, root = rng.integers(-1, 2, 25) if rng.random() < 0.5 else np.full(25, -1), rng.integers(0, 25, 25)
        side[side < 0] = side.min()
        one = lambda r: {tuple(sorted(np.flatnonzero(r == x))) for x in r}
        want, got = root.copy(), root.copy()
        for a in range(25):
            for b in range(a):
                both = len(np.intersect1d(sets[a], sets[b]))
                if (side[a] < 0 or side[a] != side[b]) and 5 * both >= 4 * (len(sets[a]) + len(sets[b]) - both):
                    want[want == want[a]] = want[b]
        n, near = np.array([len(x) for x in sets]), np.arange(25)
        for a, b in zip(*similar_links(np.arange(25), side, root, n, [packed(x).tobytes() for x in sets])):
            got[got == got[a]] = got[b]
        assert one(got) == one(want)
        # the groups by parity part no similar pair
        for a, b in zip(*alike_links(np.arange(25), side, root, n, [parity(x).tobytes() for x in sets])):
            near[near == near[a]] = near[b]
        for a in range(25):
            for b in range(a):
                both = len(np.intersect1d(sets[a], sets[b]))
                if root[a] != root[b] and (side[a] < 0 or side[a] != side[b]) and 5 * both >= 4 * (n[a] + n[b] - both):
                    assert near[a] == near[b]


def test_null_ids_repeats_long_and_empty(spark):
    long = " ".join(f"w{n}" for n in range(60_000))
    rows = [(None, "a b c d e f g h"), (5, "a b c d e f g h"), (None, None), (None, ""), (None, "only null ids here now"), (None, "only null ids here now"),
            (7, long), (8, long + " x"), (9, "q " * 30_000), (9, "q " * 30_000), (1, "r s")] + [(3, "same row again and again")] * 50
    assert answer(set_join(documents(spark, rows))) == brute(rows)
    assert set_join(documents(spark, [(1, "a")]).limit(0)).count() == 0
    assert answer(set_join(documents(spark, [(1, None), (2, "")]))) == [(1, 0, 1), (2, 0, 2)]


def test_blocks_leave_every_pair_that_can_reach():
    rng = np.random.default_rng(9)
    group, place = rng.integers(0, 40, 400), rng.integers(0, 9, 400)
    n = place + rng.integers(1, 60, 400)
    order = np.lexsort((n, place, group))
    group, place, n = (x[order] for x in (group, place, n))
    got = [(a, b) for rows, low, count in block_ranges(group, place, n) for a, x, c in zip(rows.tolist(), low.tolist(), count.tolist()) for b in range(x, x + c)]
    want = [
        (a, b) for a in range(400) for b in range(a + 1, 400)
        if group[a] == group[b] and 9 * min(n[a] - place[a], n[b] - place[b]) >= 4 * (n[a] + n[b])]
    assert sorted(got) == want
    label = np.arange(400)
    for a, b in want:
        label[label == max(label[a], label[b])] = min(label[a], label[b])
    assert meeting(group, place, n).tolist() == label.tolist()


def test_lists_give_one_link_a_pair_to_the_least_key():
    rng = np.random.default_rng(10)
    token, key = rng.integers(0, 30, 400), rng.integers(-40, 40, 400)
    place, n = (key + token) % 7, 10 + (key * key) % 50
    place, n = np.concatenate([place, place[:50]]), np.concatenate([n, n[:50]])
    token, key = np.concatenate([token, token[:50]]), np.concatenate([key, key[:50]])
    order = np.lexsort((key, n, place, token))
    got = list(zip(*(x.tolist() for x in list_links(token[order], place[order], n[order], key[order]))))
    want = {}
    for t in range(30):
        rows = sorted({(int(k), int(p), int(m)) for x, k, p, m in zip(token, key, place, n) if x == t})
        near = lambda a, b: 9 * min(a[2] - a[1], b[2] - b[1]) >= 4 * (a[2] + b[2])
        least = {r: r for r in rows}
        for a in rows:
            for b in rows:
                if a < b and near(a, b):
                    x, y = sorted((least[a], least[b]))
                    least = {r: x if z == y else z for r, z in least.items()}
        for r, u in least.items():
            if r != u:
                at = (u[0], r[0], u[2], r[2])
                want[at] = want.get(at, 0) + near(u, r)
    assert got == [(*k, c) for k, c in sorted(want.items())]


def test_sets_are_compared_only_where_bitmaps_leave_them_similar(spark, monkeypatch):
    from fieldloom.llm import set_join as module

    # two texts each share a passage of their own, and so meet, and differ in the rest; one pair is similar
    part = lambda name, n: " ".join(f"{name}x{k}" for k in range(n))
    rows = [
        (2 * f + m, " ".join([part(f"own{f}", 14), *(part(f"slot{i}v{(f // 4 ** i + m) % 4}", 30) for i in range(3))]))
        for f in range(30) for m in range(2)]
    rows.append((60, rows[7][1] + " end"))
    given, real = [], module.overlaps
    monkeypatch.setattr(module, "overlaps", lambda pairs, *rest: given.append(pairs.count()) or real(pairs, *rest))
    assert answer(set_join(documents(spark, rows))) == brute(rows)
    assert given[0] <= 5


@pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="driver tables are not here")
@pytest.mark.parametrize("sf", ["sf0.001"])
def test_query_equals_all_pairs(spark, sf):
    from fieldloom.llm.queries import QUERIES

    folder = f"{os.path.dirname(SF_DIR)}/{sf}"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]
    got = answer(QUERIES["op12_ngram_jaccard_join"](spark, folder))
    assert got == brute(rows) and any(r[0] != r[2] for r in got)
