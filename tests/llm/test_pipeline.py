"""Every stage against its brute-force form, on its own input."""

import os

import numpy as np
import pytest

import corpus_pipeline
from fieldloom.llm.decontamination import EDIT_RATE, normal
from fieldloom.llm.packing import BUDGET, MAX_LEN
from tests.llm.helpers import SF_DIR, documents
from tests.llm.test_line_dedup import brute as brute_lines
from tests.llm.test_packing import check as check_batches
from tests.llm.test_quality import brute as brute_measures
from tests.llm.test_simhash import slow_components, slow_fingerprint

pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="driver tables are not here")


def edits_of_best_region(item, texts):
    """Edits of the whole item against its best region of each text, by the full table over all texts at once."""
    apart = b"\xfe" * (len(item) + 1)
    joined = np.frombuffer(apart.join([*texts, b""]), np.uint8)
    order = np.arange(len(joined) + 1, dtype=np.int32)
    row = np.zeros(len(joined) + 1, np.int32)
    for i, c in enumerate(item, 1):
        new = np.minimum(row[:-1] + (joined != c), row[1:] + 1)
        row = np.minimum.accumulate(np.concatenate([[i], new]).astype(np.int32) - order) + order
    ends = np.cumsum([len(t) + len(apart) for t in texts])
    return [int(row[b - len(apart) - len(t):b - len(apart) + 1].min()) for t, b in zip(texts, ends)]


def test_stages(spark, tmp_path):
    from fieldloom.llm.quality import quality_rules

    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    kept = {}
    for n, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, SF_DIR)
        out.write.parquet(str(tmp_path / str(n)))
        before, after = docs.toPandas(), spark.read.parquet(str(tmp_path / str(n)))
        if n + 1 < len(corpus_pipeline.STAGES):
            assert after.dtypes == [("doc_id", "bigint"), ("text", "string"), ("lang", "string"), ("source", "string"), ("n_chars", "bigint")]
            assert after.where("n_chars <> length(text)").count() == 0
        rows, got = list(zip(before.doc_id, before.text)), after.toPandas()
        if n == 0:
            verdict = {r.doc_id: r for r in quality_rules(docs).collect()}
            for i, t in rows:
                words, _, _, _, repeated = brute_measures(t)
                assert verdict[i].base_failed == (words < 50 or 100 * repeated > 50 * words)
            assert set(got.doc_id) == {i for i, r in verdict.items() if r.kept}
        elif n == 1:
            assert sorted(zip(got.doc_id, got.text)) == sorted((i, t) for i, t, _, _ in brute_lines(rows))
        elif n == 2:
            root = slow_components([slow_fingerprint(t) for _, t in rows])
            assert set(got.doc_id) == {min(i for (i, _), q in zip(rows, root) if q == r) for r in set(root)}
        elif n == 3:
            texts = [normal(t) for _, t in rows]
            held = set()
            for r in spark.read.parquet(f"{SF_DIR}/benchmark.parquet").collect():
                item = normal(r.text)
                found = edits_of_best_region(item, texts)
                held |= {i for (i, _), k in zip(rows, found) if k <= int(len(item) * EDIT_RATE)}
            assert held and set(got.doc_id) == {i for i, _ in rows} - held
        else:
            out = spark.read.parquet(str(tmp_path / str(n))).collect()
            check_batches(out, {i: len(t.split()) for i, t in rows}, MAX_LEN, BUDGET)
        kept[name] = len(got)
        docs = after
    assert all(kept.values())


def test_run_gives_the_last_stage(spark):
    out = corpus_pipeline.run(spark, SF_DIR)
    assert out.columns == ["doc_id", "piece", "first_token", "n_tokens", "bucket", "bucket_len", "batch", "slot"] and out.count() > 50


def test_stages_with_nulls_and_repeated_rows(spark):
    text = " ".join(f"word{n}" for n in range(90))
    rows = [(1, text), (1, text), (None, text), (1, "short"), (2, None), (3, text + " x"), (None, text + " y z"), (3, text[::-1])]
    docs = spark.createDataFrame(
        [(i, t, "en" if n % 2 else None, "s", 1) for n, (i, t) in enumerate(rows)],
        "doc_id long, text string, lang string, source string, n_chars long")
    said = lambda df: sorted([(r.doc_id, r.text) for r in df.collect()], key=repr)
    # rows of one id are judged apart, and those without one stay
    assert said(corpus_pipeline.quality(spark, docs, "")) == sorted([r for r in rows if r[1] and len(r[1]) > 99], key=repr)
    # one row of each group, with an id where the group has one
    assert said(corpus_pipeline.near(spark, documents(spark, [(i, t) for i, t in rows if t != "short"]), "")) in (
        [(1, text), (2, None), (3, text[::-1])], sorted([(1, text), (2, None), (3, text[::-1]), (3, text + " x")], key=repr))
    alone = spark.createDataFrame([(None, "a b c d", "en", "s", 7)] * 3, docs.schema)
    assert said(corpus_pipeline.near(spark, alone, "")) == [(None, "a b c d")]
    for _, stage in corpus_pipeline.STAGES[:3] + corpus_pipeline.STAGES[4:]:
        assert stage(spark, docs.limit(0), "").count() == 0
        stage(spark, docs, "").count()


@pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="driver tables are not here")
def test_decontamination_judges_rows_apart(spark):
    item = spark.read.parquet(f"{SF_DIR}/benchmark.parquet").orderBy("item_id").first().text
    rows = [(None, item), (None, "a clean text"), (4, item + " and more"), (4, "clean as well"), (5, None)]
    got = corpus_pipeline.decontaminate(spark, documents(spark, rows), SF_DIR).collect()
    assert sorted([(r.doc_id, r.text) for r in got], key=repr) == sorted([rows[1], rows[3], rows[4]], key=repr)
