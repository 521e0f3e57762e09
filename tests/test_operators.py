"""Order, ties, skew and failure behaviour of the operators on small inputs."""

import json
import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from fieldloom import rules
from fieldloom.functions import pyfuncs
from fieldloom.operators import content, pages, ranking, reports, routing, store, tables, tax, validate
from fieldloom.plans import documents, invoices
from fieldloom.sources import files, sinks


def collected(df):
    return sorted(map(repr, (tuple(r) for r in df.collect())))


# --- routing --------------------------------------------------------------------------------

LABELS = [
    ("agreement", "Effective Date", "agreement_date"), ("invoice", "Due Date", "invoice_date"),
    ("invoice", "Tax Amount", "total_amount"), ("invoice", "Invoice No", "invoice_number"),
    ("pan", "Father's Name", "name"), ("pan", "Company Name", "pan_number"), ("aadhaar", "Liquid", "aadhaar_number"),
    ("aadhaar", "Colour", None),
]


def test_first_pattern_wins(spark):
    df = spark.createDataFrame(LABELS, "t string, label string, want string")
    for r in df.select("*", routing.route_label(F.col("label"), F.col("t")).alias("got")).collect():
        assert r["got"] == r["want"], r


def test_last_label_wins_whatever_the_partitioning(spark):
    kv = [(d, s, label, f"v{s}") for d in range(20) for s, label in enumerate(
        ["Invoice Date", "Total", "Due Date", "Amount", "nothing"])]
    random.Random(5).shuffle(kv)
    base = spark.createDataFrame(kv, "doc_id long, seq int, label string, value string")
    results = {tuple(collected(routing.route_fields(base.repartition(n), "invoice"))) for n in (1, 8)}
    assert len(results) == 1
    row = routing.route_fields(base, "invoice").where("doc_id = 3 and field_name = 'invoice_date'").first()
    assert (row["seq"], row["field_value"]) == (0, "v2")


def test_merge_layers_keeps_first_position(spark):
    schema = "doc_id long, seq long, field_name string, field_value string, value_type string"
    a = spark.createDataFrame([(1, 0, "x", "1", "str"), (1, 1, "y", "2", "str")], schema)
    b = spark.createDataFrame([(1, 0, "z", "3", "str"), (1, 1, "x", None, "NoneType")], schema)
    rows = [(r["field_name"], r["field_value"]) for r in routing.merge_layers(a, b).orderBy("seq").collect()]
    assert rows == [("x", None), ("y", "2"), ("z", "3")]


def test_unknown_type_has_no_required_fields(spark):
    docs = spark.createDataFrame([(1, "letter"), (2, "pan")], "doc_id long, document_type string")
    fields = spark.createDataFrame([], "doc_id long, seq long, field_name string, field_value string, value_type string")
    got = {r["doc_id"]: (r["is_valid"], r["n_errors"]) for r in validate.verdicts(docs, fields).collect()}
    assert got == {1: (True, 0), 2: (False, 2)}


def test_bad_required_field_is_reported_twice(spark):
    docs = spark.createDataFrame([(1, "pan"), (2, "invoice")], "doc_id long, document_type string")
    fields = spark.createDataFrame(
        [(1, 0, "pan_number", "BAD", "str"), (1, 1, "name", "A", "str")],
        "doc_id long, seq long, field_name string, field_value string, value_type string")
    errors = validate.record_errors(docs, fields).orderBy("doc_id", "phase", "seq").collect()
    assert [(r["doc_id"], r["message"]) for r in errors] == [
        (1, "Invalid value for field: pan_number"), (1, "Invalid format for field: pan_number"),
        (2, "Missing required field: invoice_number"), (2, "Missing required field: invoice_date"),
        (2, "Missing required field: total_amount")]


def test_sanitise_lists_keeps_other_items(spark):
    fields = spark.createDataFrame(
        [(1, 0, "t", '[" a ",1,{"x":" y "},null]', "list"), (1, 1, "s", "  b\n", "str"), (1, 2, "d", '{"k":" v "}', "dict")],
        "doc_id long, seq long, field_name string, field_value string, value_type string")
    got = [r["field_value"] for r in validate.sanitize(fields).orderBy("seq").collect()]
    assert got == ['["a",1,{"x":" y "},null]', "b", '{"k":" v "}']


# --- folders and answers ------------------------------------------------------------------------

@pytest.mark.parametrize("name,kind", [
    ("pann", "pan"), ("Aggrements", "agreement"), ("japan", "pan"), ("xyz", None), ("", None), ("123", None),
    ("Contracts", "agreement"), ("AADHAR", "aadhaar"), (None, None)])
def test_folder_type(name, kind):
    assert pyfuncs.folder_type(name) == kind


def test_answers(spark):
    answers = ['```json\n{"a": 1,}\n```', 'text {"a": {"b": [1,2,],}} tail {"c"', "{ {x} ", "no", '  ```\n{"a":2}```', None]
    df = spark.createDataFrame(list(enumerate(answers)), "n int, v string")
    got = [r[1] for r in df.select("n", content.answer_json(F.col("v"))).orderBy("n").collect()]
    assert got == ['{"a": 1}', '{"a": {"b": [1,2]}}', "{ {x}", "no", '{"a":2}', None]


def test_model_failure_is_one_error_row(spark):
    def model(batch):
        if (batch["text"] == "bad").any():
            raise ValueError("cannot read")
        return batch.assign(n=batch["text"].str.len(), error=None)[["doc_id", "n", "error"]]

    df = spark.createDataFrame([(i, "bad" if i == 3 else "x" * i) for i in range(6)], "doc_id long, text string").coalesce(1)
    got = {r["doc_id"]: (r["n"], r["error"]) for r in pyfuncs.map_model(df, model, "doc_id long, n long, error string").collect()}
    assert got[3] == (None, "cannot read") and got[5] == (5, None) and len(got) == 6


# --- HTML -----------------------------------------------------------------------------------------

def test_html_spans_headers_and_open_tags():
    html = ("x<table><tr><th rowspan=2>A</th><th colspan='2'>B &amp; C</th></tr><tr><th>b</th><th>c</th></tr>"
            "<tr><td>1<td>2 <b>x</b>\n y<td></tr></table><!-- <table> --><script>'<table>'</script><table><tr><td>only</td></tr></table>")
    assert pyfuncs.read_tables(html) == [
        {"header": ["A A", "B & C b", "B & C c"], "rows": [["1", "2 x y", None]]},
        {"header": ["0"], "rows": [["only"]]}]
    assert pyfuncs.read_tables("no tables") == [] and pyfuncs.read_tables(None) == []


def test_table_classes_first_invoice_last_bank(spark):
    table = "<table><tr><th>{}</th></tr><tr><td>{}</td></tr></table>"
    bank = table.format("bank account ifsc", "{}")
    html = bank.format("one") + table.format("ROI", "first") + bank.format("two") + table.format("payout", "second") \
        + table.format("cgst", "t")
    df = spark.createDataFrame([(1, html)], "doc_id long, markdown string")
    h = tables.with_tables(df).first()["html"]
    assert h["bank"]["rows"] == [["two"]] and h["invoice"]["rows"] == [["first"]] and h["gst"]["rows"] == [["t"]]


# --- tables -----------------------------------------------------------------------------------------

CELLS = "doc_id long, table_no int, seq long, row_index int, column_index int, content string"


def test_line_items_defaults_duplicates_and_sparse_rows(spark):
    cells = [(1, 0, 0, 0, 0, "h"), (1, 0, 1, 1, 0, "old"), (1, 0, 2, 1, 0, "new"), (1, 0, 3, 1, 3, "9"),
             (1, 0, 4, 2, 1, "lonely"), (1, 0, 5, 9, 0, "far"), (1, 0, 6, 9, 1, "far")]
    got = tables.line_items(spark.createDataFrame(cells, CELLS)).collect()
    # four distinct rows: index 9 is outside 1..3, row 2 has one cell
    assert [tuple(r)[2:] for r in got] == [(1, "new", "1", "0", "9")]


def test_grid_fills_missing_rows_and_columns(spark):
    cells = spark.createDataFrame([(1, 0, 0, 0, 1, "b"), (1, 0, 1, 2, 0, "x\ny")], CELLS)
    lines = {r["line_no"]: r["text"] for r in tables.markdown_lines(cells).collect()}
    assert lines == {0: "|  | b |", 1: "| --- | --- |", 2: "|  |  |", 3: "| x y |  |"}


def test_bank_cells_bad_value_does_not_shadow_good_one(spark):
    cells = [(1, 0, 0, 0, 0, "Bank PAN"), (1, 0, 1, 0, 1, "wrong"), (1, 0, 2, 1, 0, "PAN:"), (1, 0, 3, 1, 1, "ABCDE1234F"),
             (1, 0, 4, 2, 0, "account"), (1, 0, 5, 2, 1, "12 3"), (1, 0, 6, 2, 1, "second")]
    got = {r["field_name"]: r["field_value"] for r in tables.bank_fields_from_cells(spark.createDataFrame(cells, CELLS)).collect()}
    assert got == {"Vendor_PAN_No": "ABCDE1234F", "Bank_Account_No": "123"}


# --- tax ----------------------------------------------------------------------------------------------

def claimed(lines):
    """By the statement of the rule: an amount belongs to the last label at or before it
    when no other amount lies from that label on; of a type the first that is not zero counts."""
    out = dict.fromkeys(("CGST", "SGST", "IGST"), 0)
    spoken = {"CGST": "CGST", "c gst": "CGST", "SGST 9%": "SGST", "IGST": "IGST"}
    for kind in out:
        owned = [
            amount for j, (_, amount) in enumerate(lines) if amount is not None
            for i in [max((i for i in range(j + 1) if lines[i][0] in spoken), default=None)]
            if i is not None and spoken[lines[i][0]] == kind and all(a is None for _, a in lines[i:j])
        ]
        out[kind] = next((a for a in owned if a), 0)
    return out


def test_tax_rule_by_hand(spark):
    cases = {
        1: ([("CGST", None), ("x", 5), ("x", 7)], (5, 0, 0)),      # the second amount has no label left
        2: ([("CGST", 0), ("x", 5), ("c gst", 7)], (7, 0, 0)),     # zero uses the label up
        3: ([("SGST 9%", None), ("IGST", None), ("", 9)], (0, 0, 9)),  # the later label replaces the earlier
        4: ([("x", 3), ("CGST", None)], (0, 0, 0)),
        5: ([("CGST", 4), ("CGST", 6), ("SGST 9%", 2)], (4, 2, 0)),
    }
    rows = [(d, s * 7_000_000_000, c, a) for d, (lines, _) in cases.items() for s, (c, a) in enumerate(lines)]
    df = spark.createDataFrame(rows, "doc_id long, seq long, content string, amount int")
    got = {r["doc_id"]: (int(r["CGST"]), int(r["SGST"]), int(r["IGST"])) for r in tax.tax_from_lines(df).collect()}
    assert got == {d: want for d, (_, want) in cases.items()}


def test_tax_lines_follow_the_rule_in_any_range(spark):
    rnd = random.Random(11)
    docs = {d: [(rnd.choice(["CGST", "SGST 9%", "x", "", "IGST", "c gst"]), rnd.choice([None, None, 0, 5, 7, 9]))
                for _ in range(rnd.randrange(1, 30))] for d in range(200)}
    rows = [(d, s, c, a) for d, lines in docs.items() for s, (c, a) in enumerate(lines)]
    rnd.shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id long, seq long, content string, amount int")
    # one document with most of all lines as well
    hot = [("CGST" if n % 50 == 0 else "x", 7 if n % 50 == 49 else None) for n in range(4000)]
    more = df.unionByName(spark.createDataFrame(
        [(999, s * 3, c, a) for s, (c, a) in enumerate(hot)], "doc_id long, seq long, content string, amount int"))
    got = {r["doc_id"]: {k: int(r[k]) for k in ("CGST", "SGST", "IGST")} for r in tax.tax_from_lines(more).collect()}
    assert got == {d: claimed(lines) for d, lines in docs.items()} | {999: {"CGST": 7, "SGST": 0, "IGST": 0}}
    as_array = df.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("seq", F.struct(
        "content", F.struct(F.struct(F.struct(F.col("amount").cast("string").alias("amount")).alias("valueCurrency")).alias("Amount"))
        .alias("valueObject")).alias("line")))).alias("l"))
    got = as_array.select("doc_id", tax.tax_from_array(F.transform("l", lambda x: x["line"])).alias("t")).collect()
    assert {r["doc_id"]: {k: int(r["t"][k]) for k in ("CGST", "SGST", "IGST")} for r in got} == {
        d: claimed(lines) for d, lines in docs.items()}


def test_rate_split(spark):
    df = spark.createDataFrame(
        [(1, "118.00", "07A", "07B"), (2, "118.00", "07A", "08B"), (3, "118.00", "07A", None)],
        "doc_id long, total string, Vendor_GSTIN string, Company_GSTIN string").select(
        "*", F.col("total").cast("decimal(18,2)").alias("Total_Payable"), F.lit(18).cast("decimal(18,6)").alias("rate"),
        *[F.lit(0).cast("decimal(18,2)").alias(k) for k in ("CGST", "SGST", "IGST")],
        F.lit(None).cast("decimal(18,2)").alias("Amount_Before_GST"))
    got = {r["doc_id"]: [str(r[k]) for k in ("Amount_Before_GST", "CGST", "SGST", "IGST")] for r in tax.split_by_rate(df).collect()}
    assert got == {1: ["100.00", "9.00", "9.00", "0.00"], 2: ["100.00", "0.00", "0.00", "18.00"], 3: ["100.00", "0.00", "0.00", "18.00"]}


# --- pages ----------------------------------------------------------------------------------------------

def test_page_merge_emptiness(spark):
    rows = [(1, 1, None, 0, "False", False, "0"), (1, 2, "X", 5, "True", True, "0.0"), (1, 3, "Y", 9, "True", False, "")]
    df = spark.createDataFrame(rows, "doc_id long, page_no int, Vendor_Name string, CGST int, IRN_Flag string, Flag boolean, Z string")
    r = pages.merge_pages(df).first()
    assert (r["Vendor_Name"], r["CGST"], r["IRN_Flag"], r["Flag"], r["Z"]) == ("X", 9, "False", True, "0")


def test_long_documents_come_page_by_page(spark):
    df = spark.createDataFrame([(1, p * 1000, f"t{p}") for p in range(2500)] + [(2, 5, None)], "doc_id long, page_no int, text string")
    parts = pages.combine_texts(df, "|").orderBy("doc_id", "page_no").collect()
    assert "".join(r["text"] for r in parts if r["doc_id"] == 1) == "|".join(f"t{p}" for p in range(2500))
    assert [r["text"] for r in parts if r["doc_id"] == 2] == [""]


# --- ranking ------------------------------------------------------------------------------------------------

def test_numbering_with_a_hot_group(spark):
    rows = [(0 if n % 3 else n % 7, n * 7919 % 5000) for n in range(5000)]
    df = spark.createDataFrame(rows, "g int, u int").repartition(8)
    want = df.select("g", "u", F.row_number().over(Window.partitionBy("g").orderBy("u")).alias("row_no"))
    got = ranking.number_in_group(df, ["g"], ["u"])
    assert got.exceptAll(want).isEmpty() and got.count() == 5000
    want = df.select("g", "u", F.row_number().over(Window.orderBy("u")).alias("row_no"))
    assert ranking.number_rows(df, ["u"]).exceptAll(want).isEmpty()


def test_null_group_is_numbered_too(spark):
    df = spark.createDataFrame([(None, 2), (None, 1), ("a", 3)], "g string, u int")
    assert collected(ranking.number_in_group(df, ["g"], ["u"])) == collected(
        spark.createDataFrame([(None, 1, 1), (None, 2, 2), ("a", 3, 1)], "g string, u int, n int"))


# --- text ------------------------------------------------------------------------------------------------------

def test_commission_month_paths_agree(spark):
    docs = {
        1: ["Commission for the month", "x", "y", "May - 24", "z"], 2: ["Service of the firm", "a", "b", "c", "d", "June 2025"],
        3: ["bill July, 2026"], 4: ["nothing"], 5: ["x", "the service of", "", "", "", "dec 25"]}
    rows = [(d, n, p) for d, ps in docs.items() for n, p in enumerate(ps)]
    paragraphs = spark.createDataFrame(rows, "doc_id long, seq int, content string")
    markdown = spark.createDataFrame([(d, "\n".join(ps)) for d, ps in docs.items()], "doc_id long, markdown string")
    want = {1: "MAY 24", 2: "JUNE2025", 3: "JULY2026", 4: None, 5: "DEC 25"}
    assert dict(map(tuple, content.commission_month(paragraphs, markdown, 2026).collect())) == want
    rowwise = markdown.select("doc_id", content.commission_month_of(F.split("markdown", "\n"), F.col("markdown"), 2026))
    assert dict(map(tuple, rowwise.collect())) == want


def test_flags_match_inside_words(spark):
    df = spark.createDataFrame([("designed by Birnam",)], "v string")
    flags = content.document_flags(F.col("v"))
    r = df.select(*[c.alias(n) for n, c in flags.items()]).first()
    assert (r["IRN_Flag"], r["E_Invoice_Flag"], r["Digital_Signature_Val"]) == ("True", "False", True)


def test_state_map_has_gaps_and_a_repeat():
    assert rules.STATE_NAMES["28"] == rules.STATE_NAMES["37"] and "25" not in rules.STATE_NAMES and len(rules.STATE_NAMES) == 36


def test_text_report_never_cuts_names(spark):
    name = "n" * 60
    fields = spark.createDataFrame([(1, 0, name, "v"), (1, 1, "short", None), (1, 2, "id", "7")],
                                   "doc_id long, seq int, field_name string, field_value string")
    docs = spark.createDataFrame([(1, "d")], "doc_id long, name string")
    lines = [r["text"] for r in reports.text_report(fields, docs).where("section = 1").orderBy("line_no").collect()]
    assert lines == [name + ": v", "short".ljust(45) + ": "]


# --- store -------------------------------------------------------------------------------------------------------

def test_pipeline_and_maintenance(spark):
    docs = spark.createDataFrame(
        [(1, "a", "pan", "p1", "2024-01-01"), (2, "b", "invoice", "p2", "2024-01-02")],
        "doc_id long, document_name string, document_type string, file_path string, created_at string")
    kv = spark.createDataFrame(
        [(1, "pan", 0, "PAN", " ABCDE1234F "), (1, "pan", 1, "Name", "X"), (2, "invoice", 0, "Total", "-5")],
        "doc_id long, document_type string, seq int, label string, value string")
    s = documents.process(docs, kv)
    status = {r["id"]: r["validation_status"] for r in s.documents.collect()}
    assert status == {1: "valid", 2: "invalid"}
    assert json.loads(s.documents.where("id = 1").first()["extracted_data"]) == {
        "pan_number": "ABCDE1234F", "name": "X", "document_type": "pan", "source_file": "p1"}
    assert s.extractions.where("field_name = 'source_file'").isEmpty()
    gone = store.delete_documents(s, spark.createDataFrame([(2,)], "id long"))
    assert gone.documents.count() == 1 and gone.errors.count() == 0
    lines = store.export_lines(s).where("document_id = 2").collect()
    assert sorted(r["kind"] for r in lines) == [0, 1, 2, 2, 2, 2]
    assert [json.loads(r["json"])["field_name"] for r in lines if r["kind"] == 1] == ["total_amount"]


def test_export_has_one_shape_for_every_size(spark):
    docs = spark.createDataFrame([(1,), (2,)], "id long")
    ext = spark.createDataFrame([(1, n, f"f{n}") for n in range(2500)] + [(3, 0, "gone")], "document_id long, seq long, field_name string")
    err = spark.createDataFrame([(1, 1, 3, "m")], "document_id long, phase int, seq long, error_message string")
    got = store.export_lines(store.Store(docs, ext, err)).orderBy("document_id", "kind", "phase", "seq").collect()
    assert [(r["document_id"], r["kind"]) for r in got] == [(1, 0)] + [(1, 1)] * 2500 + [(1, 2), (2, 0)]


def test_record_json_keeps_every_field_with_its_type(spark):
    rows = [(1, 3, "name", "X \"y\" é", "str"), (1, 0, "vendor_email", "a@b.co", "str"), (1, 1, "tags", '["a",1]', "list"), (1, 2, "n", "5", "int"),
            (1, 4, "none", None, "NoneType"), (1, 5, "flag", "True", "bool"), (1, 6, "document_type", "pan", "str"), (1, 7, "bad", "nan", "float")]
    df = spark.createDataFrame(rows, "doc_id long, seq long, field_name string, field_value string, value_type string")
    record = json.loads(store.record_json(df).first()["record"])
    assert list(record.items()) == [("vendor_email", "a@b.co"), ("tags", ["a", 1]), ("n", 5), ("name", 'X "y" é'), ("none", None), ("flag", True),
                                    ("document_type", "pan"), ("bad", "nan")]


def test_layers_beat_positions(spark):
    schema = "doc_id long, seq long, field_name string, field_value string, value_type string"
    first = spark.createDataFrame([(1, 5_000_000_000, "a", "old", "str"), (1, 6_000_000_000, "b", "kept", "str")], schema)
    second = spark.createDataFrame([(1, 0, "a", "new", "str"), (1, 1, "c", "more", "str")], schema)
    got = routing.merge_layers(first, second).orderBy("seq").collect()
    assert [(r["seq"], r["field_name"], r["field_value"]) for r in got] == [(0, "a", "new"), (1, "b", "kept"), (2, "c", "more")]


def test_repeated_changes_do_not_multiply_rows(spark):
    target = spark.createDataFrame([("I1", "old", 1), ("I2", "old", 2)], "Invoice_No string, Vendor_Name string, n int")
    changes = spark.createDataFrame([("I1", "x", None, 1), ("I1", "", 7, 2), ("I9", "z", 9, 1)], "Invoice_No string, Vendor_Name string, n int, at int")
    got = store.update_known_values(target, changes, order=("at",)).orderBy("Invoice_No").collect()
    assert [tuple(r) for r in got] == [("I1", "x", 7), ("I2", "old", 2)]


def test_versions_can_be_written_from_the_version_before(spark, tmp_path):
    from fieldloom.sources import sinks

    docs = spark.createDataFrame([(1, "a"), (2, "b")], "id long, extracted_data string")
    kids = spark.createDataFrame([(1, "f"), (2, "g")], "document_id long, field_name string")
    sinks.save_store(store.Store(docs, kids, kids), str(tmp_path))
    for _ in range(2):
        sinks.change_store(spark, str(tmp_path), lambda s: store.delete_documents(s, spark.createDataFrame([(2,)], "id long")))
    assert sinks.last_version(spark, str(tmp_path)) == 2
    left = sinks.read_store(spark, str(tmp_path))
    assert [r["id"] for r in left.documents.collect()] == [1] and left.errors.count() == 1


def test_deep_json(spark):
    deep = '{"a":' * 300 + "1.50" + "}" * 300
    rows = [(1, deep), (2, '{"x":{},"y":[1,{"z":2}],"k":"1"}'), (3, "no json"), (4, None), (5, "[1]")]
    got = {(r["doc_id"], r["path"]): r["value"] for r in routing.flatten_json(spark.createDataFrame(rows, "doc_id long, j string"), "j").collect()}
    assert got == {(1, ".".join("a" * 300)): "1.50", (2, "y"): '[1,{"z":2}]', (2, "k"): "1"}


def test_root_is_cut_where_it_first_ends(spark):
    paths = [("file:/x/Input/Input/files/y.pdf",), ("/x/Input/pan/z.pdf",)]
    got = files.input_documents(spark.createDataFrame(paths, "path string"), "file:/x/Input").collect()
    assert {(r["document_type"], r["document_name"]) for r in got} == {("input", "y"), ("pan", "z")}


# --- files -----------------------------------------------------------------------------------------------------------

def test_folder_scan_and_reads(spark, tmp_path):
    for name, body in {
        "Invoice/files/a.PDF": "x", "Invoice/b.pdf": "x", "PAN/c.pdf": "x", "PAN/d.txt": "x", "empty/files/n.txt": "x",
        "empty/o.pdf": "x", "out/r_extracted.json": '{"a": 1}', "out/s_extracted.json": "{bad",
    }.items():
        path = tmp_path / "Input" / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(body)
    root = str(tmp_path / "Input")
    found = files.input_documents(files.list_files(spark, root), root).collect()
    assert sorted((r["document_type"], r["document_name"]) for r in found) == [("invoice", "a"), ("pan", "c")]
    assert files.list_files(spark, str(tmp_path / "missing")).isEmpty()
    assert files.find_by_extension(spark, root, [".TXT"]).count() == 2
    read = {files_name(r["path"]): (r["json"], r["error"]) for r in files.saved_records(spark, root).collect()}
    assert read == {"r_extracted.json": ('{"a": 1}', None), "s_extracted.json": (None, "unreadable JSON")}


def files_name(path):
    return path.rsplit("/", 1)[1]


def test_writes(spark, tmp_path):
    empty = spark.createDataFrame([], "a int")
    assert sinks.write_csv(empty, str(tmp_path / "e")) and not (tmp_path / "e").exists()
    df = spark.createDataFrame([(1, "x")], "a int, b string")
    assert sinks.append_matching(df, str(tmp_path / "t"), ["z"]) is False
    assert sinks.append_matching(df, str(tmp_path / "t"), ["b", "z"]) is True
    assert spark.read.parquet(str(tmp_path / "t")).columns == ["b"]
    same_name = spark.createDataFrame([("pan", "n", "{}"), ("invoice", "n", "{}")], "document_type string, document_name string, value string")
    sinks.write_records(same_name, str(tmp_path / "x"), str(tmp_path / "raw"))
    assert spark.read.json(str(tmp_path / "raw")).count() == 2


def test_verdict_json_shapes(spark):
    df = spark.createDataFrame([("{}",), ('{"a":1}',)], "r string")
    none = F.array().cast("array<string>")
    got = [json.loads(r[0]) for r in df.select(sinks.verdict_json(F.col("r"), F.lit(True), none)).collect()]
    assert got == [{"validation": {"is_valid": True, "errors": []}}, {"a": 1, "validation": {"is_valid": True, "errors": []}}]


def test_output_names_on_clash(spark):
    df = spark.createDataFrame([(1, "A/1", "x"), (2, "A:1", "y"), (3, "", "keep.pdf"), (4, "A 1", "z")], "doc_id int, Invoice_No string, file_name string")
    got = {r["doc_id"]: r["new_name"] for r in sinks.output_names(df, ["doc_id"]).collect()}
    assert got == {1: "A_1.pdf", 2: "A_1_1.pdf", 3: "keep.pdf", 4: "A_1_2.pdf"}
    # a key that is null is a key, and a hot name is numbered whole
    rows = [(n if n else None, "hot" if n % 3 == 0 else f"n{n}", "x") for n in range(3000)]
    df = spark.createDataFrame(rows, "doc_id int, Invoice_No string, file_name string").repartition(8)
    out = sinks.output_names(df, ["doc_id"]).collect()
    got = {r["doc_id"]: r["new_name"] for r in out}
    assert len(out) == len(set(got.values())) == 3000 and got[None] == "hot.pdf"
    assert (got[3], got[2997], got[5]) == ("hot_1.pdf", "hot_999.pdf", "n5.pdf")


def test_what_numbering_writes_is_as_wide_as_its_key(spark):
    import os

    def written_bytes(df):
        folders = {os.path.dirname(f.removeprefix("file://")) for f in df.inputFiles() if "fieldloom-sorted" in f}
        assert len(folders) == 1
        return sum(os.path.getsize(os.path.join(f, n)) for f in folders for n in os.listdir(f) if n.endswith(".parquet"))

    narrow = spark.range(2000, numPartitions=4).select(
        "id", F.concat(F.lit("n"), F.col("id") % 700).alias("Invoice_No"), F.lit("x").alias("file_name"))
    wide = narrow.withColumn("body", F.repeat(F.sha2(F.col("id").cast("string"), 256), 50))
    numbers = [ranking.number_by_key(d, ["id"], ["Invoice_No", "id"]) for d in (narrow, wide)]
    names = [sinks.output_names(d, ["id"]) for d in (narrow, wide)]
    for a, b in (numbers, names):
        assert written_bytes(b) < 1.1 * written_bytes(a) < 100_000
        assert b.drop("body").exceptAll(a).isEmpty() and b.count() == 2000 and b.where("body is null").isEmpty()
    want = ranking.number_rows(narrow, ["Invoice_No", "id"])
    assert numbers[1].drop("body").exceptAll(want).isEmpty()
    grouped = ranking.number_by_key(wide, ["id"], ["id"], group=["Invoice_No"]).drop("body")
    assert grouped.exceptAll(ranking.number_in_group(narrow, ["Invoice_No"], ["id"])).isEmpty()
    chunks = ranking.chunk_rows(wide, ["id"], 7, key=["id"]).select("id", "chunk_no")
    assert chunks.where("chunk_no <> floor(id / 7)").isEmpty() and chunks.count() == 2000



def test_amount_in_words_is_the_patterns_first_match(spark):
    import re

    pattern = re.compile(rules.TEXT_PATTERNS["amount_in_words"])
    rnd = random.Random(5)
    parts = ["Rupees", "Five", "Hundred", "Only", "lower words", "A", " ", "\n", ".", ",", "12", "Thousand and", "x Lakh", "\t", "  "]
    texts = ["".join(rnd.choice(parts) for _ in range(rnd.randrange(1, 12))) for _ in range(1500)] + [
        "Rupees\n\n  Five Hundred Only.", "Only", "Word " * 20_000 + ". Total Rupees Five Lakh Only.", ""]
    df = spark.createDataFrame(list(enumerate(texts)), "n int, t string")
    got = dict(map(tuple, df.select("n", content.amount_in_words(F.col("t"))).collect()))
    want_of = lambda hit: spark.createDataFrame(list(hit.items()), "n int, m string")
    hits = {n: (m.group() if (m := pattern.search(t)) else None) for n, t in enumerate(texts)}
    from fieldloom.functions.text import clean, strip

    cleaned = clean(strip(F.col("m")))
    want = dict(map(tuple, want_of(hits).select("n", F.when(F.length(cleaned) > 5, cleaned)).collect()))
    assert got == want


# --- word edges -------------------------------------------------------------------------------

def test_word_edges_are_ascii_as_in_sql(one):
    import duckdb

    codes = "|".join(rules.LOAN_CODES)
    texts = ["payout CIÓAL and PL", "payout ÑBL!! ÉCCÉ", "payout BĹ x", "payout _BL BLx", "payout GL", "no code BL", ""]
    want = [duckdb.execute(
        rf"SELECT CASE WHEN regexp_matches($1, '(?i)payout') THEN list_min(regexp_extract_all($1, '\b({codes})\b')) END", [t]).fetchone()[0] for t in texts]
    assert one(content.loan_type_in_text, texts) == want
    assert want[:2] == ["AL", "BL"]
    assert one(content.pan_in_text, ["ÉABCDE1234F", "xABCDE1234F"]) == ["ABCDE1234F", None]


# --- work done once ---------------------------------------------------------------------------

def optimized(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_bank_values_are_cleaned_once_and_rows_grouped_without_a_join(spark):
    cells = [(1, t, s, s, c, text) for t in (0, 1) for s, pair in enumerate(
        [("Bank details", ""), ("Branch", " 　"), ("Branch:", f"North  {t}"), ("PAN", "bad"), ("Account no", "00 1")]) for c, text in enumerate(pair)]
    df = spark.createDataFrame(cells, "doc_id long, table_no int, seq long, row_index int, column_index int, content string")
    out = tables.bank_fields_from_cells(df)
    assert collected(out) == ["(1, 'Bank_Account_No', '001')", "(1, 'Bank_Branch', 'North 0')"]
    plan = optimized(out)
    assert plan.count(r"(?<=[^ ]) +\z") == 1 and "Join" not in plan


def test_errors_of_both_phases_check_the_fields_once(spark, tmp_path):
    seen = spark.sparkContext.accumulator(0)

    def count(value):
        seen.add(1)
        return value

    fields = [(d, n, name, value, "str") for d in range(20) for n, (name, value) in enumerate(
        [("invoice_number", "INV"), ("invoice_date", "31/02/2024"), ("contact_email", "bad"), ("total_amount", "")])]
    df = spark.createDataFrame(fields, "doc_id long, seq long, field_name string, field_value string, value_type string")
    df = df.withColumn("field_value", F.udf(count, "string").asNondeterministic()("field_value"))
    docs = spark.createDataFrame([(d, "invoice") for d in range(21)], "doc_id long, document_type string")
    got = validate.record_errors(docs, df).groupBy("message").count().collect()
    assert seen.value == len(fields)
    assert dict(map(tuple, got)) == {
        "Missing required field: invoice_number": 1, "Missing required field: invoice_date": 1, "Missing required field: total_amount": 21,
        "Invalid value for field: invoice_date": 20, "Invalid format for field: invoice_date": 20, "Invalid format for field: contact_email": 20}


def test_layers_with_repeated_labels_are_merged_in_one_aggregate(spark):
    labels = ["Invoice Date", "Total", "Due Date", "Amount", "nothing"]
    kv = spark.createDataFrame([(d, "invoice", s, l, None if s == 3 else f"v{s}") for d in range(3) for s, l in enumerate(labels)],
                               "doc_id long, document_type string, seq int, label string, value string")
    docs = spark.createDataFrame([(d, "invoice", f"f{d}") for d in range(3)], "doc_id long, document_type string, file_path string")
    out = documents.extract_fields(docs, kv)
    twice = routing.merge_layers(routing.route_fields(kv, F.col("document_type")), routing.metadata_layer(
        docs, document_type=F.col("document_type"), source_file=F.col("file_path")))
    assert collected(out) == collected(twice.select(*out.columns)) and out.count() == 12
    assert optimized(out).count("Aggregate") == 1


def test_unreadable_documents_are_read_once_and_exports_are_compressed(spark):
    import workload.all  # noqa: F401
    from workload.base import REGISTRY, Inputs

    inputs = Inputs(spark, "/root/testdata/sf0.001")
    assert optimized(REGISTRY["s5_unreadable_documents"].run(inputs)).count("Relation") == 1
    assert all(f.endswith(".json.gz") for f in REGISTRY["d6_nested_export_json"].run(inputs).inputFiles())


def test_required_names_are_bit_sets(spark):
    names = [f"field_{n}" for n in range(70)]
    book = rules.STANDARD.register("Long", rules.DocumentRules(names, [], [], {"field_65": lambda c: c == "good"}))
    docs = spark.createDataFrame([(1, "long"), (2, "long"), (3, "pan"), (4, "long")], "doc_id long, document_type string")
    rows = [(d, n, f, "bad" if (d, f) == (1, "field_65") else "good", "str") for d in (1, 2) for n, f in enumerate(names) if f not in ("field_0", "field_61")]
    fields = spark.createDataFrame(rows, "doc_id long, seq long, field_name string, field_value string, value_type string")
    got = validate.required_errors(docs, fields, book).where("doc_id < 3").select("doc_id", "seq", "message").collect()
    assert sorted(map(tuple, got)) == [
        (1, 0, "Missing required field: field_0"), (1, 61, "Missing required field: field_61"), (1, 65, "Invalid value for field: field_65"),
        (2, 0, "Missing required field: field_0"), (2, 61, "Missing required field: field_61")]
    state = {r.doc_id: r.n_errors for r in validate.verdicts(docs, fields, book).collect()}
    assert state == {1: 4, 2: 2, 3: len(book.types["pan"].required), 4: 70}
    # two numbers for each 62 names
    assert len(validate._required_flags(book)[1]) <= 4


def test_labels_and_names_are_lowered_once(spark):
    kv = spark.createDataFrame([(1, 0, "Due Date", "x", "invoice")], "doc_id long, seq int, label string, value string, document_type string")
    fields = routing.route_fields(kv, F.col("document_type"))
    # once for each type's pattern in the filter, once for all rules
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    assert 1 <= plan(fields).count("lower(label") <= len(rules.STANDARD.types) + 1
    assert plan(validate.with_checks(fields)).count("lower(field_name") == 1


def test_html_tables_are_classified_once(spark):
    df = spark.createDataFrame([(1, "<table><tr><th>Bank Name</th></tr><tr><td>x</td></tr></table>")], "doc_id long, markdown string")
    h = tables.with_tables(df)
    found = tables.bank_fields_from_html(F.col("html.bank"))
    plan = h.select(*[c.alias(n) for n, c in found.items()])._jdf.queryExecution().optimizedPlan().toString()
    # the signature's pattern is there once, not once for every alias that is looked up
    assert plan.count("[^a-z]") == 1


def test_html_split_and_entities():
    html = ("<table><tr><td a='x>y'>1 &amp; 2<!-- <td> --><script>a<td>b</script></td><td colspan=2>é</tr><tr><td '>no</td></tr>"
            "<tr><td>3<table><tr><td>in</table></table>after<td>")
    # of a nested table the text belongs to the outer cell too; a tag with an open quote is text of no cell
    assert pyfuncs._raw_tables(html) == [
        [(False, [("1 & 2", 1, 1), ("é", 2, 1)]), (False, [("3in", 1, 1)])], [(False, [("in", 1, 1)])]]


def test_identity_pages_are_put_together_once_for_all_types(spark):
    from fieldloom.plans import identity

    docs = spark.createDataFrame([(1, "PAN"), (2, "aadhaar"), (3, "agreement"), (4, "memo"), (5, "pan")], "doc_id long, document_type string")
    pages = spark.createDataFrame([(d, p, f"{'of ABCDE1234F' if p else 'page'} {d}") for d in range(1, 5) for p in range(2)], "doc_id long, page_no int, text string")
    answers = spark.createDataFrame([(1, '{"name": "A"}'), (3, "none")], "doc_id long, answer string")
    fields, errors = identity.process(docs, pages, answers)
    got = {(r.doc_id, r.field_name): r.field_value for r in fields.collect()}
    assert got[1, "name"] == "A" and got[1, "pan_number"] == got[3, "company.pan"] == "ABCDE1234F" and got[5, "pan_number"] is None
    assert [tuple(r) for r in errors.collect()] == [(4, "Unsupported document type: memo")]
    plan = fields._jdf.queryExecution().optimizedPlan().toString()
    # once before, and not once in the plan of every type
    assert "collect_list" not in plan
    # a value's pattern is searched for in a column, not again for each use in its row
    assert all("regexp" not in line for line in plan.splitlines() if "Generate inline" in line)
