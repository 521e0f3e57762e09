import pytest

from fieldloom.llm.line_dedup import line_dedup, line_key
from tests.llm.helpers import documents

LONG = "this line is surely longer than forty characters é"


def brute(rows, min_chars=40, min_docs=5):
    held = {}
    for i, text in rows:
        for x in (text or "").split("\n"):
            key = x.strip(" \t\n\x0b\x0c\r")
            key = "".join(c.lower() if "A" <= c <= "Z" else c for c in key)
            if len(key) >= min_chars:
                held.setdefault(key, set()).add(i)
    out = []
    for i, text in rows:
        lines = (text or "").split("\n")
        keep = []
        for x in lines:
            key = "".join(c.lower() if "A" <= c <= "Z" else c for c in x.strip(" \t\n\x0b\x0c\r"))
            ids = held.get(key, set())
            known = [j for j in ids if j is not None]
            if len(ids) < min_docs or (known and i == max(known)):
                keep.append(x)
        out.append((i, "\n".join(keep), len(lines), len(lines) - len(keep)))
    return out


def test_equals_brute_force(spark):
    rows = [(n, f"own {n}\n  {LONG.upper() if n % 2 else LONG}\t\nshort\n{LONG}") for n in range(9)]
    rows += [(20, None), (21, ""), (22, LONG + "!" + "\n" * 3), (3, f"own 3\n{LONG}"), (None, LONG), (None, LONG), (23, "x" * 39), (24, "É" * 40)]
    rows += [(30 + n, "É" * 40 + "\n" + "e" * 40) for n in range(5)]
    # É is not lower-cased: its upper and lower forms stay apart
    got = sorted(map(tuple, line_dedup(documents(spark, rows), min_docs=5).collect()), key=str)
    assert got == sorted(brute([(i, t and t.replace("É", "É")) for i, t in rows]), key=str)


def test_key_folds_only_ascii():
    assert line_key(" \tÀB\x0b".encode()) == "Àb".encode()


def test_hot_line_in_all_documents(spark):
    rows = [(n, f"{LONG}\nthe own line of document number {n} stays where it is") for n in range(3000)]
    got = line_dedup(documents(spark, rows), min_docs=2).collect()
    assert [r.doc_id for r in got if not r.n_dropped] == [2999]
    assert all(r.n_lines == 2 for r in got)


def test_empty_table_and_carried_columns(spark):
    docs = documents(spark, [(1, LONG, "de", "s1")])
    assert line_dedup(docs.limit(0)).count() == 0
    row = line_dedup(docs, carry=("lang", "source")).first()
    assert (row.doc_id, row.lang, row.source, row.text, row.n_lines, row.n_dropped) == (1, "de", "s1", LONG, 1, 0)


@pytest.mark.parametrize("keep, last", [("largest", 2), ("smallest", 0)])
def test_which_document_keeps(spark, keep, last):
    got = line_dedup(documents(spark, [(n, LONG) for n in range(3)]), keep=keep).collect()
    assert [r.doc_id for r in got if r.text] == [last]
