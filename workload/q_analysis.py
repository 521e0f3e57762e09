"""Service results: normalisers, value pickers and the invoice plan."""

from __future__ import annotations

from pyspark.sql import functions as F


from fieldloom.operators import reports, tables
from fieldloom.plans import invoices
from fieldloom.sources import analysis
from workload.base import query
from workload.fixtures import CONTENT, ORDERS, _LEN1, money_of
from workload.q_checks import paise

_O = f"(SELECT * FROM {ORDERS.replace('{orders}', 'orders')} WHERE o_orderkey % 29 <> 0)"


def _normal(i):
    return analysis.normalise(i.fixture("analysis").where(F.try_parse_json("json").isNotNull()))


@query("s8_service_result", sql=f"""
    SELECT o_orderkey AS doc_id, {CONTENT} AS content, 1 AS n_tables, 4 AS n_cells, 'Order ' || o_orderkey AS cell,
           2 AS n_pages, 2 AS n_paragraphs, 3 AS n_pairs, 'title' AS role, NULL AS error FROM {_O} AS o
    UNION ALL SELECT o_orderkey, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, 'unreadable JSON' FROM orders WHERE o_orderkey % 29 = 0""")
def _(i):
    good, bad = analysis.split_readable(i.fixture("analysis"))
    return analysis.normalise(good).select(
        "doc_id", "content", F.size("tables").alias("n_tables"), F.size(F.get("tables", F.lit(0))["cells"]).alias("n_cells"),
        F.get(F.get("tables", F.lit(0))["cells"], F.lit(2))["content"].alias("cell"), F.size("pages").alias("n_pages"),
        F.size("paragraphs").alias("n_paragraphs"), F.size("pairs").alias("n_pairs"),
        F.get("paragraphs", F.lit(0))["role"].alias("role"), F.lit(None).cast("string").alias("error"),
    ).unionByName(bad.select("doc_id", "error"), allowMissingColumns=True)


@query("s8_key_values", sql=f"""
    SELECT o_orderkey AS doc_id, 0 AS seq, 'Invoice No' AS label, 'LAST-' || o_orderkey AS value FROM {_O} AS o
    UNION ALL SELECT o_orderkey, 1, 'Total', {money_of('paise')} FROM {_O} AS o""")
def _(i):
    return analysis.key_values(_normal(i))


@query("s9_legacy_key_values", sql=f"""
    SELECT o_orderkey AS doc_id, 'Legacy' AS label, CAST(o_orderkey AS VARCHAR) AS value FROM {_O} AS o""")
def _(i):
    return analysis.legacy_key_values(i.fixture("analysis")).select("doc_id", "label", "value")


@query("s9_legacy_result", sql=f"""
    SELECT o_orderkey AS doc_id, CASE WHEN o_orderkey % 29 = 0 THEN '' ELSE {CONTENT} END AS content,
           CASE WHEN o_orderkey % 29 = 0 THEN 0 ELSE 1 END AS n_tables, CASE WHEN o_orderkey % 29 = 0 THEN 0 ELSE 2 END AS n_pages FROM orders""")
def _(i):
    return analysis.normalise_legacy(i.fixture("analysis")).select(
        "doc_id", "content", F.size("tables").alias("n_tables"), F.size("pages").alias("n_pages"))


@query("s10_page_text_by_spans", sql=f"""
    SELECT o_orderkey AS doc_id, 1 AS page_number, substr({CONTENT}, 1, {_LEN1}) AS text FROM {_O} AS o
    UNION ALL SELECT o_orderkey, 2, substr({CONTENT}, {_LEN1} + 1) FROM {_O} AS o""")
def _(i):
    return analysis.page_texts(_normal(i))


@query("k6_paragraph_lines", sql=f"""
    SELECT o_orderkey AS doc_id, 0 AS line_no, '[1] (title) Title ' || o_custkey AS text FROM {_O} AS o
    UNION ALL SELECT o_orderkey, 1, '[2] Body ' || o_orderpriority FROM {_O} AS o""")
def _(i):
    return reports.paragraph_lines(_normal(i))


@query("k6_page_blocks", sql=f"""
    SELECT o_orderkey AS doc_id, 1 AS page_number, repeat('=', 40) || chr(10) || 'PAGE 1' || chr(10) || repeat('=', 40) || chr(10) || substr({CONTENT}, 1, {_LEN1}) AS text FROM {_O} AS o
    UNION ALL SELECT o_orderkey, 2, repeat('=', 40) || chr(10) || 'PAGE 2' || chr(10) || repeat('=', 40) || chr(10) || substr({CONTENT}, {_LEN1} + 1) FROM {_O} AS o""")
def _(i):
    return reports.page_blocks(analysis.page_texts(_normal(i)))


@query("x38_result_tables", sql=f"""
    SELECT o_orderkey AS doc_id, r.row_index, r.column_index,
           CASE r.n WHEN 0 THEN 'Item' WHEN 1 THEN 'Price' WHEN 2 THEN 'Order ' || o_orderkey ELSE {money_of('paise')} END AS content
    FROM {_O} AS o, (VALUES (0, 0, 0), (1, 0, 1), (2, 1, 0), (3, 1, 1)) AS r(n, row_index, column_index)""")
def _(i):
    return tables.explode_cells(analysis.tables_of(_normal(i))).select("doc_id", "row_index", "column_index", "content")


@query("s5_unreadable_documents", uses="analysis", sql="""
    SELECT doc_id, doc_id % 29 <> 0 AS readable, CASE WHEN doc_id % 29 = 0 THEN 'unreadable JSON' END AS error FROM analysis""")
def _(i):
    return analysis.mark_unreadable(i.fixture("analysis")).select("doc_id", F.col("error").isNull().alias("readable"), "error")


@query("x16_value_picker", sql=f"""
    SELECT o_orderkey AS doc_id, 'ACP/26/' || o_orderkey AS text_value, CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS date_value,
           CAST(o_totalprice AS VARCHAR) AS amount_value, 'No. ' || o_custkey || ',, Main  Road' AS address_value, 'INR ' || {money_of('paise')} AS content_value FROM {_O} AS o""")
def _(i):
    f = analysis.parse(i.fixture("analysis"), parts=("documents",), lists=()).where(F.col("a").isNotNull()).select("doc_id", analysis.first_fields().alias("f"))
    pick = lambda n: analysis.pick_field(f"f.{n}")
    return f.select(
        "doc_id", pick("InvoiceId").alias("text_value"), pick("InvoiceDate").alias("date_value"),
        pick("InvoiceTotal").alias("amount_value"), pick("VendorAddress").alias("address_value"),
        pick("SubTotal").alias("content_value")).where(F.col("text_value").isNotNull())


_CONTENT_KINDS = """SELECT o_orderkey AS doc_id, CASE o_orderkey % 4
    WHEN 0 THEN '{{"analyzeResult":{{"content":[{{"x":1}},{{"markdown":"# M ' || o_orderpriority || '"}},{{"markdown":"second"}},{{"paragraphs":[{{"content":"p1"}},{{"content":"p ' || o_orderpriority || '"}}]}}]}}}}'
    WHEN 1 THEN '{{"analyzeResult":{{"content":"plain ' || o_orderpriority || '","pages":[{{"markdown":"no"}}]}}}}'
    WHEN 2 THEN '{{"analyzeResult":{{"pages":[{{"markdown":"a' || o_orderstatus || '"}},{{"x":1}},{{"markdown":"b"}}]}}}}'
    ELSE '{{"analyzeResult":{{}}}}' END AS json FROM {orders}"""


@query("x17_markdown_picker", sql="""
    SELECT o_orderkey AS doc_id, CASE o_orderkey % 4 WHEN 0 THEN '# M ' || o_orderpriority WHEN 1 THEN 'plain ' || o_orderpriority
           WHEN 2 THEN 'a' || o_orderstatus || 'b' ELSE '' END AS markdown FROM orders""")
def _(i):
    parsed = analysis.parse(i.sql(_CONTENT_KINDS), parts=("content", "pages"))
    return parsed.select("doc_id", analysis.markdown_of(F.col("json"), F.col("a")).alias("markdown"))


@query("x18_paragraph_picker", sql="""
    SELECT o_orderkey AS doc_id, CASE o_orderkey % 4 WHEN 0 THEN 'p1|p ' || o_orderpriority ELSE '' END AS paragraphs FROM orders""")
def _(i):
    return analysis.parse(i.sql(_CONTENT_KINDS), parts=("content",)).select(
        "doc_id", F.array_join(analysis.paragraphs_of(F.col("json"), F.col("a")), "|").alias("paragraphs"))


_GST = "CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE gstin_o END"


@query("x15_primary_fields", sql=f"""
    SELECT o_orderkey AS doc_id, 'ACP/26/' || o_orderkey AS invoice_no, 'Vendor ' || o_custkey AS vendor_name,
           CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE gstin_c END AS vendor_gstin, {_GST} AS company_gstin, paise AS payable, paise AS base,
           'No. ' || o_custkey || ',, Main Road' AS address, '00-' || o_orderkey AS account, 'I' || 'FSC' || ifsc_o AS ifsc_text,
           CASE WHEN o_orderkey % 5 = 0 THEN CASE WHEN o_orderkey % 4 = 0 THEN pan_c END ELSE pan_o END AS vendor_pan
    FROM {_O} AS o""")
def _(i):
    f = analysis.parse(i.fixture("analysis"), parts=("documents",), lists=()).select("doc_id", analysis.first_fields().alias("f")).where(F.col("f").isNotNull())
    r = invoices.primary_fields(f)
    return r.select(
        "doc_id", F.col("Invoice_No").alias("invoice_no"), F.col("Vendor_Name").alias("vendor_name"),
        F.col("Vendor_GSTIN").alias("vendor_gstin"), F.col("Company_GSTIN").alias("company_gstin"),
        paise(F.col("Total_Payable")).alias("payable"), paise(F.col("Amount_Before_GST")).alias("base"),
        F.col("Vendor_Address").alias("address"), F.col("Bank_Account_No").alias("account"),
        F.concat(F.lit("IFSC"), F.col("Bank_IFSC_Code")).alias("ifsc_text"), F.col("Vendor_PAN_No").alias("vendor_pan"))


@query("x15_required_missing", sql=f"""
    SELECT o_orderkey AS doc_id, CASE WHEN o_custkey % 4 = 0 THEN 'InvoiceId' ELSE '' END AS missing FROM orders""")
def _(i):
    pages = i.sql("""SELECT o_orderkey AS doc_id, '{{"analyzeResult":{{"documents":[{{"fields":{{"VendorName":{{"valueString":"V"}}' ||
        CASE WHEN o_custkey % 4 = 0 THEN '' ELSE ',"InvoiceId":{{"valueString":"I' || CAST(o_orderkey AS STRING) || '"}}' END || '}}}}]}}}}' AS json FROM {orders}""")
    f = analysis.parse(pages, parts=("documents",), lists=()).select("doc_id", analysis.first_fields().alias("f"))
    return f.select("doc_id", F.array_join(invoices.missing_required(), ",").alias("missing"))


@query("j5_field_rules", sql=f"""
    SELECT o_orderkey AS doc_id, CASE WHEN o_orderkey % 3 = 0 THEN 'n/a' ELSE gstin_o END AS raw, {_GST} AS cleaned FROM {_O} AS o""")
def _(i):
    f = analysis.parse(i.fixture("analysis"), parts=("documents",), lists=()).select("doc_id", analysis.first_fields().alias("f")).where(F.col("f").isNotNull())
    raw = f.withColumn("raw", analysis.pick_field("f.CustomerTaxId"))
    return invoices.primary_fields(raw).select("doc_id", "raw", F.col("Company_GSTIN").alias("cleaned"))


@query("x40_blank_record", sql=f"""
    SELECT o_orderkey AS doc_id, 'INV' || o_orderkey AS "Invoice_No", {len(invoices.COLUMNS)} AS n_columns, 0 AS cgst, 'False' AS irn,
           FALSE AS signed, CAST(NULL AS VARCHAR) AS supply FROM orders""")
def _(i):
    given = i.sql("SELECT o_orderkey AS doc_id, 'INV' || CAST(o_orderkey AS STRING) AS Invoice_No, CAST(NULL AS DECIMAL(18,2)) AS CGST FROM {orders}")
    full = invoices.complete_record(given)
    n = len([c for c in full.columns if c != "doc_id"])
    return full.select(
        "doc_id", "Invoice_No", F.lit(n).alias("n_columns"), F.col("CGST").cast("int").alias("cgst"),
        F.col("IRN_Flag").alias("irn"), F.col("Digital_Signature_Val").alias("signed"), F.col("Place_Of_Supply").alias("supply"))


# --- the whole invoice run -----------------------------------------------------------------------
#
# Two pages per order: the first has the fields, the second tax lines and bank cells.

_PAGE_ONE = """'{{"analyzeResult":{{"content":"Place of Supply : Goa","documents":[{{"fields":{{'
    || '"InvoiceId":{{"type":"string","valueString":"N/' || CAST(o_orderkey AS STRING) || '"}},'
    || '"VendorTaxId":{{"type":"string","valueString":"' || gstin_c || '"}},"CustomerTaxId":{{"type":"string","valueString":"' || gstin_o || '"}},'
    || '"InvoiceTotal":{{"type":"currency","valueCurrency":{{"amount":' || total_text || '}}}}}}}}]}}}}'"""
_PAGE_TWO = """'{{"analyzeResult":{{"content":"Due Date : 10-08-2026 ' || o_orderpriority || '","tables":[{{"cells":[{{"rowIndex":0,"columnIndex":0,"content":"Bank Name"}},{{"rowIndex":0,"columnIndex":1,"content":"Bank ' || CAST(o_custkey AS STRING)
    || '"}},{{"rowIndex":1,"columnIndex":0,"content":"Account"}},{{"rowIndex":1,"columnIndex":1,"content":"12 34"}}]}}],"documents":[{{"fields":{{"TaxDetails":{{"valueArray":[{{"content":"CGST","valueObject":{{}}}},{{"content":"x","valueObject":{{"Amount":{{"valueCurrency":{{"amount":' || CAST(o_orderkey % 10 AS STRING)
    || '.50}}}}}}}}]}},"Items":{{"valueArray":[{{"content":"North","valueObject":{{"Description":{{"type":"string","valueString":"Item ' || o_orderstatus || '"}},"Amount":{{"content":"1,000.25"}}}}}}]}}}}}}]}}}}'"""


def _raw_pages(i):
    return i.sql(f"""SELECT o_orderkey AS doc_id, seq + 1 AS page_no, CASE seq WHEN 0 THEN {_PAGE_ONE} ELSE {_PAGE_TWO} END AS json
        FROM (SELECT *, @explode(@array(0, 1)) AS seq FROM {ORDERS}) AS t""")


# page one: no tax, so only a rate or a state split could give one, and neither is there;
# page two: CGST is the claimed amount, total tax follows from it
@query("invoice_records", sql=f"""
    SELECT o_orderkey AS doc_id, 'N/' || o_orderkey AS invoice_no, gstin_c AS vendor_gstin, gstin_o AS company_gstin, paise AS payable,
           (o_orderkey % 10) * 100 + 50 AS cgst, 0 AS igst, (o_orderkey % 10) * 100 + 50 AS total_tax, 'Goa' AS place, '2026-08-10' AS due_date,
           'Bank ' || o_custkey AS bank, '1234' AS account, substr(gstin_c, 3, 10) AS vendor_pan, substr(gstin_o, 3, 10) AS company_pan,
           CASE WHEN contains(lower(gstin_c || ' ' || gstin_o), 'irn') THEN 'True' ELSE 'False' END AS irn
    FROM {ORDERS.replace('{orders}', 'orders')}""")
def _(i):
    r = invoices.invoice_records(invoices.page_records(_raw_pages(i), 2026))
    return r.select(
        "doc_id", F.col("Invoice_No").alias("invoice_no"), F.col("Vendor_GSTIN").alias("vendor_gstin"),
        F.col("Company_GSTIN").alias("company_gstin"), paise(F.col("Total_Payable")).alias("payable"),
        paise(F.col("CGST")).alias("cgst"), paise(F.col("IGST")).alias("igst"), paise(F.col("Total_Tax")).alias("total_tax"),
        F.col("Place_Of_Supply").alias("place"), F.col("DueDate").alias("due_date"), F.col("Bank_Name").alias("bank"),
        F.col("Bank_Account_No").alias("account"), F.col("Vendor_PAN_No").alias("vendor_pan"),
        F.col("Company_PAN_No").alias("company_pan"), F.col("IRN_Flag").alias("irn"))


@query("invoice_items", sql="""
    SELECT o_orderkey AS doc_id, 2 AS page_no, 1 AS sr_no, 'N/' || o_orderkey AS invoice_no, 'Item ' || o_orderstatus AS item, 'North' AS region, 100025 AS total FROM orders""")
def _(i):
    raw = _raw_pages(i)
    records = i.sql("SELECT o_orderkey AS doc_id, 'N/' || CAST(o_orderkey AS STRING) AS Invoice_No FROM {orders}")
    return invoices.invoice_items(raw, records).select(
        "doc_id", "page_no", F.col("Sr_No").alias("sr_no"), F.col("Invoice_No").alias("invoice_no"),
        F.col("Item_Description").alias("item"), F.col("Region").alias("region"), paise(F.col("Total_Amount")).alias("total"))


