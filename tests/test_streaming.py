"""New files are processed once, in one or several runs."""

import json

from pyspark.sql import functions as F

from fieldloom.plans import invoices
from fieldloom.streaming.arrivals import current_records, process_arrivals


def page(doc_id, number, page_no=1):
    body = {"analyzeResult": {"content": f"DL/2627/{number:06d}" if number else "", "documents": [{"fields": {}}]}}
    return json.dumps({"doc_id": doc_id, "page_no": page_no, "json": json.dumps(body)})


def test_arrivals_merge_pages_of_several_batches(spark, tmp_path):
    source, target, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    (tmp_path / "in").mkdir()
    plan = lambda rows: invoices.invoice_records(invoices.page_records(rows, 2026)).select("doc_id", "Invoice_No")
    (tmp_path / "in" / "a.json").write_text(page(1, 7) + "\n" + page(2, None))
    assert process_arrivals(spark, source, target, plan, checkpoint=state) == 1
    # document 2 gets its number from a page that arrives later, document 1 is not touched
    (tmp_path / "in" / "b.json").write_text(page(3, 9) + "\n" + page(2, 8, 2))
    assert process_arrivals(spark, source, target, plan, checkpoint=state) == 1
    assert process_arrivals(spark, source, target, plan, checkpoint=state) == 0
    rows = sorted((r["doc_id"], r["Invoice_No"]) for r in current_records(spark, target).collect())
    assert rows == [(1, "DL/2627/000007"), (2, "DL/2627/000008"), (3, "DL/2627/000009")]


def test_a_batch_reads_only_the_pages_of_its_documents(spark, tmp_path):
    source, target = str(tmp_path / "in"), str(tmp_path / "out")
    (tmp_path / "in").mkdir()
    seen = []

    def plan(rows):
        seen.append((rows.count(), len({f.split("batch=")[1].split("/")[0] for f in rows.inputFiles()})))
        return rows.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.sum("page_no").alias("pages"))

    def arrive(name, ids, page_no):
        (tmp_path / "in" / name).write_text("\n".join(page(i, 1, page_no) for i in ids))
        return process_arrivals(spark, source, target, plan)

    assert arrive("a.json", range(200), 1) == 1
    assert arrive("b.json", range(200, 400), 1) == 1
    # whatever is stored, three documents are read with their pages and nothing else
    for n in range(2, 4):
        assert arrive(f"c{n}.json", [5, 250, None], n) == 1
    assert [r for r, _ in seen] == [200, 200, 2 * 2 + 1, 2 * 3 + 2] and {f for _, f in seen} == {1}
    got = {r["doc_id"]: (r["n"], r["pages"]) for r in current_records(spark, target).collect()}
    assert len(got) == 401 and got[5] == got[250] == (3, 6) and got[None] == (2, 5) and got[6] == (1, 1)


def test_a_hot_document_is_dealt_over_shards(spark, tmp_path):
    source, target = str(tmp_path / "in"), str(tmp_path / "out")
    (tmp_path / "in").mkdir()
    plan = lambda rows: rows.groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("n"), F.countDistinct("page_no").alias("different"))
    for part in range(2):
        lines = [page(1, 1, part * 500 + n) for n in range(500)] + [page(2 + part, 1)]
        (tmp_path / "in" / f"{part}.json").write_text("\n".join(lines))
        assert process_arrivals(spark, source, target, plan, shards=3) == 1
    got = {r["doc_id"]: (r["n"], r["different"]) for r in current_records(spark, target).collect()}
    assert got == {1: (1000, 1000), 2: (1, 1), 3: (1, 1)}


def test_nested_columns_come_back_as_they_were(spark, tmp_path):
    source, target = str(tmp_path / "in"), str(tmp_path / "out")
    (tmp_path / "in").mkdir()
    schema = "doc_id bigint, at timestamp, words array<string>, box struct<x: double, label: string>"
    lines = ['{"doc_id": 1, "at": "2026-01-02T03:04:05.678901Z", "words": ["a", null], "box": {"x": 1.5, "label": "b"}}', '{"doc_id": 1}']
    plan = lambda rows: rows
    for n, line in enumerate(lines):
        (tmp_path / "in" / f"{n}.json").write_text(line)
        assert process_arrivals(spark, source, target, plan, schema=schema, shards=1) == 1
    want = spark.read.schema(schema).json(source)
    assert current_records(spark, target).exceptAll(want).isEmpty() and current_records(spark, target).count() == 2
