import re

from fieldloom.llm.quality import METRICS, bucket, quality_rules, thresholds
from pyspark.sql import functions as F
from tests.llm.helpers import documents

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    words = WORD.findall(text or "")
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    windows = list(zip(words, words[1:], words[2:]))
    covered = {j for i, w in enumerate(windows) if windows.count(w) > 1 for j in (i, i + 1, i + 2)}
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered))


TEXTS = [
    None, "", " \t\n ", "one", "two words", "a b c", "a b c a b c", "a a a a a", "x y é ü\x0bz", "l 1\nl 1\nl 2\n\n\nl 1",
    "# * $ % & | < > #", "a b c d a b c e a b c", " lead and trail ", "\n".join(["same line here"] * 9),
]


def test_measures_equal_brute_force(spark):
    got = quality_rules(documents(spark, list(enumerate(TEXTS)))).collect()
    assert {r.doc_id: (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in got} == {
        n: brute(t) for n, t in enumerate(TEXTS)}
    assert all(r.base_failed and not r.kept for r in got)


def test_long_text_and_empty_table(spark):
    long = " ".join(f"w{n}" for n in range(200_000))
    row = quality_rules(documents(spark, [(1, long)])).first()
    assert (row.n_words, row.n_repeat_words, row.base_failed, row.kept) == (200_000, 0, False, True)
    assert quality_rules(documents(spark, [(1, "x")]).limit(0)).count() == 0


def test_buckets_keep_ten_bits(spark):
    values = [0, 1, 1023, 1024, 1025, 2047, 4099, 10**9 + 7]
    got = [r[0] for r in spark.createDataFrame([(v,) for v in values], "v long").select(bucket(F.col("v"))).collect()]
    assert got == [v - v % (1 << max(0, v.bit_length() - 10)) for v in values]


def clean(n, extra=""):
    return " ".join(f"word{(n * 31 + i) % 997:03d}" for i in range(80)) + extra


def test_symbol_heavy_text_goes_and_thresholds_follow_the_group(spark):
    # source "code" is full of symbols by nature, source "prose" is not
    rows = [(n, clean(n), "en", "prose") for n in range(250)]
    rows += [(1000 + n, clean(n, " <|>" * (40 + n % 5)), "en", "code") for n in range(250)]
    rows += [(5000, clean(3, " <|>" * 40), "en", "prose"), (5001, clean(3), None, None), (None, clean(4), "en", "prose"), (7, clean(7), "en", "prose")]
    got = quality_rules(documents(spark, rows)).collect()
    assert len(got) == len(rows)
    assert [r.doc_id for r in got if not r.kept] == [5000]


def test_fences_are_exact_quartiles_of_small_values(spark):
    measured = spark.createDataFrame(
        [(n, "en", "s", 100, 500, n, 0, 0, 10) for n in range(400)],
        "id long, lang string, source string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_text_lines long")
    row = thresholds(measured).first()
    values = sorted(n * 1000 // 500 for n in range(400))
    q1, q3 = values[99], values[299]
    assert row.symbols_high == q3 + 3 * max(q3 - q1, METRICS["symbols"][3])
