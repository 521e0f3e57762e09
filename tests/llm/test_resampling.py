"""Importance resampling against a plain loop."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from fieldloom.llm.resampling import build, compose, features, resample, scan
from tests.llm.helpers import documents

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def runs(text, max_n):
    w = words(text)
    return [" ".join(w[i:i + n]) for n in range(1, max_n + 1) for i in range(len(w) - n + 1)]


def brute(rows, target, max_n=1, buckets=10_000, percent=10, min_words=20):
    bucket = lambda f: zlib.crc32(f.encode()) % buckets
    s, t = (Counter(bucket(f) for x in texts for f in runs(x, max_n)) for texts in ([x for _, x in rows], target))
    big_s, big_t = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (big_s + buckets) / ((s[b] + 1) * (big_t + buckets))))
    out = []
    for i, text in rows:
        f = runs(text, max_n)
        weight = sum(gain(bucket(x)) for x in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, len(words(text)), len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None])
    able = sorted((r for r in out if r[1] >= min_words), key=lambda r: (-r[4], r[0] is None, r[0]))
    for n, r in enumerate(able[:percent * len(able) // 100]):
        r[5] = n + 1
    return sorted(map(tuple, out), key=repr)


def corpus():
    rng = np.random.default_rng(5)
    vocab = [f"w{n}" for n in range(60)] + ["Ünïcode", "中文", "ABC", "x9", "a b"]
    marks = [" ", "\n", ", ", ".", " - ", "\x7f"]
    text = lambda n: "".join(str(rng.choice(vocab)) + str(rng.choice(marks)) for _ in range(n))
    rows = [(n, text(int(rng.integers(0, 60)))) for n in range(150)]
    rows += [(200, None), (201, ""), (202, "?!"), (7, rows[7][1]), (7, rows[7][1]), (203, "w1 " * 50_000), (204, "z" * 300_000)]
    return rows, [text(30) for _ in range(5)] + [None]


@pytest.mark.parametrize("max_n,dictionary", [(1, 50_000), (1, 4), (3, 20), (2, 0)])
def test_equals_plain_loop(spark, max_n, dictionary):
    rows, target = corpus()
    out = resample(
        documents(spark, rows), spark.createDataFrame([(n, t) for n, t in enumerate(target)], "item_id int, text string"),
        max_n=max_n, buckets=500, dictionary_words=dictionary)
    got = sorted((tuple(r) for r in out.collect()), key=repr)
    assert got == brute(rows, target, max_n, buckets=500)
    assert sum(g[5] is not None for g in got) == sum(g[1] >= 20 for g in got) // 10


def test_composed_payloads_are_crcs():
    texts = [b"ab cd  efg", b"", "中文 x ab ab".encode(), b"A-B-c"]
    known = build(["ab", "x", "中文".encode().decode("latin-1")])
    crc, length, owner = scan(texts, *known)
    assert length.tolist() == [2, 2, 3, 6, 1, 2, 2, 1, 1, 1] and owner.tolist() == [0] * 3 + [2] * 4 + [3] * 3
    got, of = features(crc, length, owner, 4)
    want = sorted((zlib.crc32(f.encode()), n) for n, t in enumerate(texts) for f in runs(t.decode(), 4))
    assert sorted(zip(got.tolist(), of.tolist())) == want
    left, right = b"any bytes " * 99, b"z" * 100_001
    crcs = [np.array([zlib.crc32(x)], np.uint32) for x in (left, right)]
    assert compose(*crcs, np.array([len(right)])).tolist() == [zlib.crc32(left + right)]


def test_null_ids_and_empty_tables(spark):
    text = " ".join(f"w{n}" for n in range(40))
    docs = documents(spark, [(None, text)] * 30 + [(1, text)] * 30)
    target = spark.createDataFrame([(1, "w1")], "item_id int, text string")
    got = [tuple(r) for r in resample(docs, target).collect()]
    assert sorted((r for r in got if r[5]), key=lambda r: r[5])[-1][5] == 6
    assert sorted((r[:5] for r in got), key=repr) == sorted((r[:5] for r in brute([(None, text)] * 30 + [(1, text)] * 30, ["w1"])), key=repr)
    assert resample(docs.limit(0), target).count() == 0
    assert resample(docs, target.limit(0)).count() == 60


def test_dictionary_is_made_once_a_worker(monkeypatch):
    from types import SimpleNamespace

    from fieldloom.llm import resampling

    made = []
    monkeypatch.setattr(resampling, "build", lambda words: made.append(words) or build(words))
    words = ["alpha", "beta"]
    shared = SimpleNamespace(value=words)
    first, second = (resampling._reader(shared, 1)([b"alpha gamma", b"beta"]) for _ in range(2))
    assert made == [words]
    assert [a.tolist() for a in first] == [a.tolist() for a in second]
    # another dictionary of the same words is made anew
    resampling._reader(SimpleNamespace(value=list(words)), 1)([b"alpha"])
    assert len(made) == 2
