import itertools
import random

from pyspark.sql import functions as F

from fieldloom.llm.packing import boundaries, pack
from tests.llm.helpers import documents


def padding(levels, edges):
    return sum(n * (min(e for e in edges if e >= size) - size) for size, n in levels)


def test_boundaries_are_optimal():
    rng = random.Random(3)
    for _ in range(60):
        sizes = sorted(rng.sample(range(1, 60), rng.randint(1, 8)))
        levels = [(s, rng.randint(1, 30)) for s in sizes]
        k = rng.randint(1, 5)
        best = min(padding(levels, c + (sizes[-1],)) for n in range(k) for c in itertools.combinations(sizes[:-1], n))
        edges = boundaries(levels, k)
        assert len(edges) <= k and padding(levels, edges) == best
    assert boundaries([], 4) == []


def check(rows, tokens, max_len, budget):
    """Every token once, every batch within its budget and full but for the last."""
    by_doc = {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
    for i, n in tokens.items():
        pieces = sorted(by_doc[i], key=lambda r: r.piece)
        assert [r.first_token for r in pieces] == [k * max_len for k in range(len(pieces))]
        assert sum(r.n_tokens for r in pieces) == n and all(r.n_tokens == max_len for r in pieces[:-1])
    batches = {}
    for r in rows:
        if r.n_tokens:
            assert r.n_tokens <= r.bucket_len
            batches.setdefault((r.bucket, r.bucket_len), {}).setdefault(r.batch, []).append(r.slot)
        else:
            assert r.bucket is None and r.batch is None and r.slot is None
    for (_, size), of in batches.items():
        room = max(1, budget // size)
        assert sorted(of) == list(range(len(of)))
        for b, slots in of.items():
            assert sorted(slots) == list(range(room if b + 1 < len(of) else len(slots))) and len(slots) <= room


def test_batches(spark, monkeypatch):
    from fieldloom.llm import packing

    monkeypatch.setattr(packing, "SHARD_ROWS", 20)
    rng = random.Random(7)
    tokens = {n: rng.choice([0, 1, 5, 31, 32, 33, 100, 250]) for n in range(300)}
    docs = documents(spark, [(i, " ".join(["w"] * n) if n else rng.choice([None, "", " \n"])) for i, n in tokens.items()])
    rows = pack(docs, max_len=64, align=4, buckets=4, budget=256).collect()
    check(rows, tokens, 64, 256)
    assert len({r.bucket for r in rows} - {None}) == 4


def test_own_lengths_nulls_repeats_and_empty(spark):
    docs = documents(spark, [(1, "a b"), (1, "a b"), (None, "a"), (2, None)])
    rows = pack(docs, length=F.length("text") * 10, max_len=8, align=8, budget=8).collect()
    assert sorted((str(r.doc_id), r.n_tokens) for r in rows) == sorted(
        [("1", 8), ("1", 8), ("1", 8), ("1", 6)] * 2 + [("None", 8), ("None", 2), ("2", 0)])
    assert len({(r.bucket, r.batch, r.slot) for r in rows if r.n_tokens}) == 10
    assert pack(docs.limit(0)).count() == 0


def test_very_long_text(spark):
    rows = pack(documents(spark, [(1, "w " * 500_000)])).collect()
    assert len(rows) == -(-500_000 // 2048) and sum(r.n_tokens for r in rows) == 500_000
