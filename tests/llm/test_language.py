import os
import zlib

import pytest
from pyspark.sql import functions as F

from fieldloom.llm.language_id import PIECE_CHARS, language_id, learn, letters, pieces
from fieldloom.llm.queries import QUERIES
from tests.llm.helpers import documents

EN = "the weather of this morning was nothing that we had thought about when the letter with their names arrived "
DE = "das wetter an diesem morgen war nichts worüber wir nachgedacht hatten als der brief mit ihren namen ankam "


def trained(spark):
    # lines differ, as distinct lines are learned from
    return documents(spark, [(n, f"{EN if n % 2 else DE} {'ab' * (n % 7)}\n" * 3, "en" if n % 2 else "de", "s") for n in range(60)]
                     + [(900, None, "fr", "s"), (901, "text without a language", None, "s"), (902, "", "xx", "s")])


def test_predictions_and_edge_cases(spark):
    rows = [(1, "we had thought about the weather and their names"), (2, "wir hatten über das wetter und ihren namen nachgedacht"), (3, None), (4, ""),
            (5, "123 456 !!"), (6, "THE LETTER WITH THEIR NAMES ARRIVED"), (None, "der brief mit ihren namen"), (1, EN), (7, DE * 3000)]
    got = language_id(documents(spark, rows), trained(spark)).collect()
    assert [(r.doc_id, r.lang_pred) for r in got] == [
        (1, "en"), (2, "de"), (3, "und"), (4, "und"), (5, "und"), (6, "en"), (None, "de"), (1, "en"), (7, "de")]
    assert all(0 <= r.score <= 1 for r in got)
    assert all(r.rejected and r.score == 0 for r in got if r.lang_pred == "und")


def test_nothing_learned_and_empty_table(spark):
    docs = documents(spark, [(1, EN)])
    assert language_id(docs, trained(spark).limit(0)).first().lang_pred == "und"
    assert language_id(docs.limit(0), trained(spark)).count() == 0


def test_pieces_hold_the_whole_text():
    for n in (0, 1, PIECE_CHARS, PIECE_CHARS + 1, 5 * PIECE_CHARS + 3):
        text = "é" * n
        assert b"".join(pieces(text)).decode() == text and max(len(p.decode()) for p in pieces(text)) <= PIECE_CHARS
    assert letters(" 1 A,b\nÉ_") == "a b é"
    assert letters("हिन्दी भाषा, ภาษาไทยที่นี่ 12") == "हिन्दी भाषा ภาษาไทยที่นี่"
    assert letters("² ½ ① _ \u0301") == ""


def test_predictions_equal_a_plain_loop(spark):
    """Each piece is compressed with each dictionary, and the smallest total wins."""
    import zstandard

    from fieldloom.llm.language_id import LEVEL, MIN_MATCH

    content = learn(trained(spark), "text", "lang", F.xxhash64("text"))
    rows = [(n, f"{(EN if n % 2 else DE)[n % 40:]} {n} ² {'z' * (n % 9)}" * (1 + n % 3 * 40)) for n in range(40)] + [(100, "² ½ ①"), (101, "zz yy"), (102, "é")]
    want = {}
    for i, text in rows:
        said = letters(text)
        sizes = []
        for lang, data in sorted(content.items()):
            d = zstandard.ZstdCompressionDict(data, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            params = zstandard.ZstdCompressionParameters.from_level(
                LEVEL, source_size=PIECE_CHARS, dict_size=len(data), min_match=MIN_MATCH, write_content_size=0, write_checksum=0, write_dict_id=0)
            total = 0
            n = max(1, -(-len(said) // PIECE_CHARS))
            for k in range(n):
                part = said[len(said) * k // n:len(said) * (k + 1) // n]
                total += len(zstandard.ZstdCompressor(dict_data=d, compression_params=params).compress(part.encode()))
            sizes.append((total, lang))
        first, second = sorted(sizes)[:2]
        want[i] = (first[1], round(1 - first[0] / second[0], 9)) if said else ("und", 0.0)
    got = {r.doc_id: (r.lang_pred, round(r.score, 9)) for r in language_id(documents(spark, rows), trained(spark)).collect()}
    assert got == want


def test_every_language_is_learned_whatever_its_shape(spark):
    # documents far over the sample, and lines shorter than twenty characters
    long = [(n, f"{n} {EN}" * 20_000, "en", "s") for n in range(2)]
    short = [(100 + n, "\n".join(["das wetter", "am morgen", f"war nichts {n}", "mit ihren namen"]), "de", "s") for n in range(30)]
    chinese = [(200 + n, "\n".join(["今天早上的天气", "我们没有想到", f"来信 {n}"]), "zh", "s") for n in range(30)]
    rows = [(1, EN), (2, "das wetter am morgen war nichts mit ihren namen"), (3, "今天早上的天气我们没有想到")]
    got = language_id(documents(spark, rows), documents(spark, long + short + chinese)).collect()
    assert [r.lang_pred for r in got] == ["en", "de", "zh"]
    learned = learn(documents(spark, long + short + chinese), "text", "lang", F.lit((1 << 30) - 1).cast("long"))
    assert set(learned) == {"en", "de", "zh"} and all(learned.values())


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="driver tables are not here")
def test_held_out_accuracy(spark):
    sf_dir = "/root/testdata/sf0.01"
    langs = {r.doc_id: r.lang for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "lang").collect()}
    out = [r for r in QUERIES["op1_language_id"](spark, sf_dir).collect() if r.held_out]
    assert all(zlib.crc32(str(r.doc_id).encode()) % 4 == 2 for r in out) and len(out) > 200
    assert sum(langs[r.doc_id] == r.lang_pred for r in out) / len(out) > 0.97
