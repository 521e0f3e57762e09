"""Fill-in-middle against a plain loop, and the exact round trip."""

import hashlib
import re

from fieldloom.llm.fill_in_middle import fill_in_middle, restore
from tests.llm.helpers import documents


def brute(doc_id, text):
    text = text or ""
    units = re.findall(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+", text)
    said = hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(said[8 * k:8 * k + 8], 16) for k in range(4)]
    n = len(units)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = ("".join(x) for x in (units[:a], units[a:b], units[b:]))
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 50:
        return n, "plain", text, None, None
    if h[3] % 100 < 80:
        return n, "spm", f"<S>{s}<P>{p}<M>{m}", len(p), len(m)
    return n, "psm", f"<P>{p}<S>{s}<M>{m}", len(p), len(m)


HARD = [
    "", None, " ", "\n\n\t", "one", " one ", "a <P> mark", "tail <S", "<M", "dollar $1 \\2 back\\slash $", "a\x0bb\x0cc\rd",
    "no-break space is a word", "中文 \U0001f600 face\U0001f600\U0001f600 x", "line one\nline two\n\nline three  ", "x" * 5000 + "  y"]


def test_equals_plain_loop(spark):
    rows = [(n * len(HARD) + k, t) for n in range(8) for k, t in enumerate(HARD)] + [(None, "null id keeps its text"), (3, "again"), (3, "again")]
    out = fill_in_middle(documents(spark, rows), carry=("text", "n_lines"))
    got = sorted(((r.doc_id, r.n, r.form, r.output, r.prefix_chars, r.middle_chars) for r in out.collect()), key=repr)
    assert got == sorted(((i, *brute(i, t)) for i, t in rows), key=repr)
    assert {g[2] for g in got} == {"plain", "spm", "psm"}
    back = out.select("text", restore(out["output"], out["form"]).alias("back")).collect()
    assert all(r.back == (r.text or "") for r in back)


def test_long_texts_and_empty_table(spark):
    long = [(n, f"word{n} " * 200_000) for n in range(6)] + [(6, " " * 300_000), (7, "x" * 2_000_000), (8, "a " + " " * 200_000)]
    out = fill_in_middle(documents(spark, long))
    for r in out.select("doc_id", "n", "form", "output", restore(out["output"], out["form"]).alias("back")).collect():
        text = dict(long)[r.doc_id]
        assert r.back == text and (r.n, r.form, r.output) == brute(r.doc_id, text)[:3]
    assert fill_in_middle(documents(spark, [(1, "a")]).limit(0)).count() == 0
