import numpy as np
import xxhash

from fieldloom.llm import simhash
from fieldloom.llm.components import components
from fieldloom.llm.simhash import fingerprint, grid_cells, links, manhattan, near_duplicates, popcounts
from tests.llm.helpers import documents


def slow_fingerprint(text):
    words = (text or "").encode().lower().split()
    shingles = [b" ".join(words[i:i + 4]) for i in range(len(words) - 3)] or ([b" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def slow_components(fps, most=4):
    root = list(range(len(fps)))
    for _ in fps:
        for i, a in enumerate(fps):
            for j, b in enumerate(fps):
                if (a ^ b).bit_count() <= most:
                    root[i] = root[j] = min(root[i], root[j])
    return root


def test_fingerprints():
    for t in [None, "", " ", "A b", "a b c", "a b c d", "A B c d e f g", "é É x y z w " * 300, "w " * 70_000]:
        assert fingerprint(t and t.encode()) == slow_fingerprint(t)


def test_close_pairs_meet_in_a_cell_and_the_bound_holds():
    rng = np.random.default_rng(5)
    a = rng.integers(0, 2**63, 3000, dtype=np.uint64) * np.uint64(2) + rng.integers(0, 2, 3000).astype(np.uint64)
    b = a.copy()
    for _ in range(4):
        b ^= np.uint64(1) << rng.integers(0, 64, 3000).astype(np.uint64)
    cells = []
    for fp in (a, b):
        index, cell = grid_cells(fp)
        cells.append([set(cell[index == n].tolist()) for n in range(300)])
    assert all(x & y for x, y in zip(*cells))
    assert (manhattan(popcounts(a), popcounts(b)) <= np.bitwise_count(a ^ b)).all()


def near_texts():
    base = [f"w{n}" for n in range(400)]
    rows = [(n, " ".join(base[:n] + ["changed"] + base[n + 1:])) for n in range(12)]
    rows += [(50 + n, " ".join(f"v{n}x{i}" for i in range(60))) for n in range(10)]
    rows += [(70, None), (71, ""), (72, " \n"), (73, rows[0][1]), (74, rows[0][1].upper()), (None, rows[13][1]), (52, rows[14][1])]
    return rows


def test_equals_brute_force(spark):
    rows = near_texts()
    got = near_duplicates(documents(spark, rows)).collect()
    fps = [slow_fingerprint(t) for _, t in rows]
    root = slow_components(fps)
    least = {r: min((i for (i, _), q in zip(rows, root) if q == r and i is not None), default=None) for r in set(root)}
    want = sorted([(i, f, least[r]) for (i, _), f, r in zip(rows, fps, root)], key=str)
    assert sorted([(r.doc_id, r.fp % 2**64, r.component_id) for r in got], key=str) == want


def test_large_cells_are_dealt_over_tiles(spark):
    rng = np.random.default_rng(2)
    values = {0}
    while len(values) < 300:
        values.add(sum(1 << int(b) for b in rng.choice(64, 3, replace=False)))
    frame = spark.createDataFrame([(v - 2**64 if v >= 2**63 else v,) for v in values], "fp long")
    for tile in (16, simhash.TILE):
        found = components(links(frame, tile=tile)).collect()
        assert len(found) == 300 and len({r.root for r in found}) == 1


def test_components_of_chains_and_stars(spark):
    edges = [(n, n + 1) for n in range(60)] + [(100, 100 + n) for n in range(50)] + [(7, 7)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {**{n: 0 for n in range(61)}, **{100 + n: 100 for n in range(50)}}


def test_empty_table(spark):
    assert near_duplicates(documents(spark, [(1, "x")]).limit(0)).count() == 0
