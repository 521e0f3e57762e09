import random

import pyarrow as pa
from pyspark.sql import functions as F

from fieldloom.llm import substring_dedup as module
from fieldloom.llm.substring_dedup import find_windows, substring_dedup
from tests.llm.helpers import documents


def brute(rows, window):
    seen, split = {}, [(t or "").split() for _, t in rows]
    for n, w in enumerate(split):
        for i in range(len(w) - window + 1):
            seen.setdefault(tuple(w[i:i + window]), []).append((n, i))
    gone = {(n, i + j) for at in seen.values() if len(at) > 1 for n, i in at for j in range(window)}
    return sorted((str(i), " ".join(x for j, x in enumerate(w) if (n, j) not in gone), len(w), sum((n, j) in gone for j in range(len(w))))
                  for n, ((i, _), w) in enumerate(zip(rows, split)))


def run(spark, rows, **kw):
    got = substring_dedup(documents(spark, rows), **kw).collect()
    return sorted((str(r.doc_id), r.text, r.n_words, r.n_removed) for r in got)


def test_equals_brute_force_on_small_windows(spark):
    rng = random.Random(1)
    shared = [f"s{n}" for n in range(40)]
    rows = []
    for n in range(60):
        w = [f"w{rng.randrange(50)}" for _ in range(rng.randrange(0, 50))]
        a = rng.randrange(0, 30)
        rows.append((n, " ".join(w + shared[a:a + rng.randrange(0, 20)] + w[:9])))
    rows += [(100, None), (101, ""), (102, "x " * 30), (None, rows[3][1]), (5, rows[6][1]), (6, rows[6][1]), (103, "A a " * 9)]
    assert run(spark, rows, window=8, gram=3) == brute(rows, 8)


def test_windows_of_a_hot_anchor_are_spread(spark):
    """One phrase in many texts, each time between other words, and some of the windows repeated."""
    rng = random.Random(6)
    phrase = " ".join(f"p{n}" for n in range(6))
    around = lambda: " ".join(f"o{rng.randrange(10**6)}" for _ in range(12))
    rows = [(n, f"{around()} {phrase} {around()}") for n in range(300)]
    rows += [(1000 + n, rows[n][1] + " end") for n in range(5)]
    assert run(spark, rows, window=8, gram=3, hot_windows=40) == brute(rows, 8) == run(spark, rows, window=8, gram=3)
    docs, bits = documents(spark, rows), 16
    shared = spark.sparkContext.broadcast(module.sketches.twice_bits(docs.select("text").mapInArrow(module._fill(bits, 8, 3), module.sketches.SEGMENTS), bits))
    hot = module.hot_anchors(docs, "text", shared, bits, 8, 3, 40)
    assert len(hot) >= 1
    kinds = [("id", pa.int64()), ("text_hash", pa.int64()), ("anchor", pa.int64()), ("start", pa.int32()), ("size", pa.int32()), ("weight", pa.int8()), ("hash", pa.int64())]
    types = pa.schema([("bucket", pa.int32()), *[(n, pa.list_(t)) for n, t in kinds]])
    sent = docs.select("doc_id", "text", F.xxhash64("text")).mapInArrow(
        module._send(shared, spark.sparkContext.broadcast(hot), bits, 50, 8, 3, types),
        "bucket int, id array<bigint>, text_hash array<bigint>, anchor array<bigint>, start array<int>, size array<int>, weight array<tinyint>, hash array<bigint>")
    per_bucket = [r["n"] for r in sent.groupBy("bucket").agg(F.sum(F.size("hash")).alias("n")).collect()]
    assert len(per_bucket) > 40 and max(per_bucket) < 6 * sum(per_bucket) / len(per_bucket)


def test_production_window(spark):
    rng = random.Random(2)
    passage = [f"p{rng.randrange(10**6)}" for _ in range(80)]
    rows = []
    for n in range(40):
        own = [f"o{rng.randrange(10**6)}" for _ in range(60)]
        a, b = sorted((rng.randrange(0, 80), rng.randrange(0, 80)))
        rows.append((n, " ".join(own[:30] + passage[a:b] + own[30:])))
    rows += [(90, "same word " * 400), (91, "\n\t ".join(passage))]
    assert run(spark, rows) == brute(rows, 35)


def test_hot_passage_long_text_and_empty_table(spark):
    passage = " ".join(f"p{n}" for n in range(50))
    rows = [(n, f"a{n} {passage} b{n}") for n in range(2000)] + [(5000, " ".join(f"l{n}" for n in range(300_000)))]
    got = substring_dedup(documents(spark, rows)).collect()
    assert all(r.n_removed == (0 if r.doc_id == 5000 else 50) for r in got)
    assert substring_dedup(documents(spark, [(1, "x")]).limit(0)).count() == 0


def test_equal_windows_have_equal_anchors():
    passage = b" ".join(b"p%d" % n for n in range(60))
    one, two = find_windows([passage]), find_windows([b"x y z", b"a b " + passage + b" c"])
    place = {int(h): int(g) for h, g in zip(two.hashes, two.grams[two.anchors])}
    assert all(place[int(h)] == int(g) for h, g in zip(one.hashes, one.grams[one.anchors]))
