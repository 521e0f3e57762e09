import random

import pytest

from fieldloom.llm.decontamination import EDIT_RATE, Index, align, leaks, normal
from tests.llm.helpers import documents


def best_edits(item, text):
    """Edits of the whole item against its best region of the text, by the full table."""
    row = [0] * (len(text) + 1)
    for i, c in enumerate(item, 1):
        new = [i]
        for j, d in enumerate(text, 1):
            new.append(min(row[j - 1] + (c != d), row[j] + 1, new[-1] + 1))
        row = new
    return min(row)


def edited(rng, text, edits):
    out = list(text)
    for _ in range(edits):
        at, kind = rng.randrange(len(out)), rng.randrange(3)
        if kind == 0:
            out[at] = rng.choice("xyz")
        elif kind == 1:
            out.insert(at, rng.choice("xyz"))
        else:
            del out[at]
    return "".join(out)


def prose(rng, n):
    return " ".join("".join(rng.choice(["an", "er", "th", "on", "re", "st"]) for _ in range(rng.randint(1, 4))) for _ in range(n))


def cases():
    rng = random.Random(4)
    items = [(n, prose(rng, rng.randint(8, 40))) for n in range(6)] + [(50, "short"), (51, None), (52, "")]
    docs = []
    for n in range(40):
        item = items[n % 6][1]
        k = rng.randrange(0, int(len(item) * 0.16) + 1)
        docs.append((n, f"{prose(rng, 20)} {edited(rng, item, k)} {prose(rng, 15)}"))
    docs += [(100, None), (101, ""), (102, items[0][1].upper().replace(" ", "\n ")), (103, items[1][1][:-4]), (None, items[2][1]), (0, docs[0][1]),
             (104, items[3][1] + " " + items[4][1]), (105, prose(rng, 3000))]
    return docs, items


def test_equals_full_alignment(spark):
    docs, items = cases()
    bench = spark.createDataFrame([(i, t, "z") for i, t in items], "item_id long, text string, doc_id string")
    got = sorted(((str(r.doc_id), r.item_id, r.edits) for r in leaks(documents(spark, docs), bench).collect()))
    want = []
    for i, t in docs:
        for j, q in items:
            a, b = normal(q), normal(t)
            if a and (k := best_edits(a, b)) <= (int(len(a) * EDIT_RATE) if len(a) >= 32 else 0):
                want.append((str(i), j, k))
    assert got == sorted(want) and len({k for *_, k in got}) > 5


def test_blocks_of_items_give_the_same(spark):
    docs, items = cases()
    bench = spark.createDataFrame(items, "item_id long, text string")
    one = sorted(map(str, leaks(documents(spark, docs), bench).collect()))
    assert one == sorted(map(str, leaks(documents(spark, docs), bench, block_bytes=150).collect()))


def test_spans_hold_the_item(spark):
    docs, items = cases()
    texts = {i: normal(t) for i, t in docs}
    bench = spark.createDataFrame(items, "item_id long, text string")
    for r in leaks(documents(spark, docs), bench).collect():
        region = texts[r.doc_id][r.start:r.stop]
        assert best_edits(normal(dict(items)[r.item_id]), region) == r.edits


@pytest.mark.parametrize("docs, items", [([], [(1, "x" * 50)]), ([(1, "x" * 60)], [])])
def test_empty_tables(spark, docs, items):
    frame = documents(spark, docs or [(1, "x")])
    assert leaks(frame if docs else frame.limit(0), spark.createDataFrame(items, "item_id long, text string")).count() == 0


def test_alignment_in_a_band():
    assert align(b"abcdef", b"xxabXdefyy", 0, 5) == (1, 8)
    assert align(b"abcdef", b"abcdef", -2, 5) == (0, 6)


def test_every_item_has_a_positive_bound():
    index = Index([(n, b"q" * n) for n in range(32, 600)], EDIT_RATE)
    assert (index.least > 0).all()


def test_short_items_are_found_exactly_at_word_borders(spark):
    items = [(1, "what is 2+2?"), (2, "今天天气"), (3, "Kot"), (4, "kot"), (5, "a  b"), (6, " "), (7, "ภาษา")]
    docs = [(1, "He asks:  What is\n2+2? again what is 2+2?"), (2, "我说今天天气很好"), (3, "kotik and skot"), (4, "the kot."), (5, "xa b"), (6, "(A b)"), (7, "พูดภาษาไทย"),
            (None, "kot"), (8, None), (9, "what is 2+2?x")]
    frame = spark.createDataFrame(items, "item_id long, text string")
    got = sorted(((str(r.doc_id), r.item_id, r.edits, r.start, r.stop) for r in leaks(documents(spark, docs), frame).collect()))
    assert got == sorted([("1", 1, 0, 9, 21), ("2", 2, 0, 6, 18), ("4", 3, 0, 4, 7), ("4", 4, 0, 4, 7), ("6", 5, 0, 1, 4), ("7", 7, 0, 9, 21),
                          ("None", 3, 0, 0, 3), ("None", 4, 0, 0, 3), ("9", 1, 0, 0, 12)])
    small = sorted(map(str, leaks(documents(spark, docs), frame, block_bytes=8).collect()))
    assert small == sorted(map(str, leaks(documents(spark, docs), frame).collect()))
