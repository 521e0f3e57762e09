"""Cells, grids, line items, bank details and HTML tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from fieldloom import rules
from fieldloom.operators import ranking, tables
from fieldloom.sources import analysis
from workload.base import FIXTURES, query, values
from workload.fixtures import LINE_PAISE, ORDERS, damaged, money_of, text
from workload.q_checks import paise

GRID_SQL = """
    WITH one AS (SELECT doc_id, table_no, row_index, column_index, replace(arg_max(content, seq), chr(10), ' ') AS content
                 FROM cells GROUP BY ALL),
    shape AS (SELECT doc_id, table_no, max(row_index) + 1 AS n_rows, max(column_index) + 1 AS n_columns FROM cells GROUP BY ALL),
    full_grid AS (SELECT s.doc_id, s.table_no, s.n_rows, s.n_columns, CAST(r.i AS INTEGER) AS row_index, CAST(c.i AS INTEGER) AS column_index
                  FROM shape s, LATERAL (SELECT unnest(range(s.n_rows)) AS i) r, LATERAL (SELECT unnest(range(s.n_columns)) AS i) c),
    filled AS (SELECT g.*, coalesce(o.content, '') AS content FROM full_grid g LEFT JOIN one o USING (doc_id, table_no, row_index, column_index))
"""


@query("x5_line_items", uses="cells", sql="""
    WITH one AS (SELECT doc_id, table_no, row_index, column_index, arg_max(content, seq) AS content FROM cells GROUP BY ALL),
    per_row AS (SELECT doc_id, table_no, row_index, count(*) AS n_cells,
                       max(content) FILTER (column_index = 0) AS d, max(content) FILTER (column_index = 1) AS q,
                       max(content) FILTER (column_index = 2) AS u, max(content) FILTER (column_index = 3) AS a FROM one GROUP BY ALL),
    sizes AS (SELECT doc_id, table_no, count(*) AS n FROM per_row GROUP BY ALL)
    SELECT doc_id, table_no, row_index, coalesce(d, '') AS description, coalesce(q, '1') AS quantity,
           coalesce(u, '0') AS unit_price, coalesce(a, '0') AS amount
    FROM per_row JOIN sizes USING (doc_id, table_no) WHERE row_index >= 1 AND row_index < n AND n_cells >= 2""")
def _(i):
    return tables.line_items(i.fixture("cells"))


@query("k5_table_csv_lines", uses="cells", sql=GRID_SQL + """
    SELECT doc_id, table_no, row_index, string_agg(CASE WHEN regexp_matches(content, '[,"\\r\\n]')
           THEN '"' || replace(content, '"', '""') || '"' ELSE content END, ',' ORDER BY column_index) AS text
    FROM filled GROUP BY doc_id, table_no, row_index""")
def _(i):
    return tables.csv_lines(i.fixture("cells"))


@query("r3_table_markdown", uses="cells", sql=GRID_SQL + """
    , lines AS (SELECT doc_id, table_no, n_rows, n_columns, row_index, '| ' || string_agg(content, ' | ' ORDER BY column_index) || ' |' AS text
                FROM filled GROUP BY ALL)
    SELECT doc_id, table_no, CASE WHEN row_index = 0 THEN 0 ELSE row_index + 1 END AS line_no, text FROM lines
    UNION ALL SELECT doc_id, table_no, 1, '|' || repeat(' --- |', n_columns) FROM lines WHERE row_index = 0""")
def _(i):
    return tables.markdown_lines(i.fixture("cells")).select("doc_id", "table_no", "line_no", "text")


@query("j3_label_value_cells", uses="bank_cells", sql="""
    SELECT a.doc_id, a.table_no, a.seq, a.content AS label, b.value
    FROM bank_cells a JOIN (SELECT doc_id, table_no, row_index, column_index, arg_min(content, seq) AS value FROM bank_cells GROUP BY ALL) b
      ON b.doc_id = a.doc_id AND b.table_no = a.table_no AND b.row_index = a.row_index AND b.column_index = a.column_index + 1""")
def _(i):
    return tables.label_value_cells(i.fixture("bank_cells")).select(
        "doc_id", "table_no", "seq", F.col("content").alias("label"), "value")


LABELS_SQL = values([(n, k, t) for n, (k, t) in enumerate(rules.BANK_LABELS)], "m(pos, key, target)")
_KNOWN = "SELECT o_orderkey AS doc_id, CASE WHEN o_orderkey % 6 = 0 THEN 'Known' ELSE '' END AS Bank_Name FROM orders"


@query("x27_bank_label_cells", uses="bank_cells", sql=rf"""
    WITH speaking AS (SELECT doc_id, table_no FROM bank_cells GROUP BY ALL
        HAVING bool_or(contains(lower(content), 'bank')) AND bool_or(contains(lower(content), 'details') OR contains(lower(content), 'account'))),
    pairs AS (SELECT a.doc_id, a.table_no, a.seq, replace(replace(lower(trim(a.content)), ':', ''), ' ', '') AS label, trim(b.value) AS value
        FROM bank_cells a JOIN speaking USING (doc_id, table_no)
        JOIN (SELECT doc_id, table_no, row_index, column_index, arg_min(content, seq) AS value FROM bank_cells GROUP BY ALL) b
          ON b.doc_id = a.doc_id AND b.table_no = a.table_no AND b.row_index = a.row_index AND b.column_index = a.column_index + 1
        WHERE a.doc_id NOT IN (SELECT doc_id FROM ({_KNOWN}) AS k WHERE Bank_Name <> '')),
    named AS (SELECT *, (SELECT arg_min(target, pos) FROM {LABELS_SQL} WHERE contains(label, key)) AS field_name FROM pairs WHERE value <> ''),
    cleaned AS (SELECT *, CASE field_name
          WHEN 'Bank_Account_No' THEN nullif(regexp_replace(value, '[^0-9\-]', '', 'g'), '')
          WHEN 'Bank_IFSC_Code' THEN coalesce(nullif(regexp_extract(regexp_replace(upper(value), '[^A-Z0-9]', '', 'g'), '{rules.IFSC_PATTERN}'), ''),
                                              nullif(regexp_replace(upper(value), '[^A-Z0-9]', '', 'g'), ''))
          WHEN 'Vendor_PAN_No' THEN CASE WHEN regexp_full_match(regexp_replace(upper(value), '[^A-Z0-9]', '', 'g'), '{rules.PAN_PATTERN}')
                                         THEN regexp_replace(upper(value), '[^A-Z0-9]', '', 'g') END
          ELSE regexp_replace(value, '\s+', ' ', 'g') END AS field_value FROM named WHERE field_name IS NOT NULL)
    SELECT doc_id, field_name, arg_min(field_value, (table_no, seq)) AS field_value
    FROM cleaned WHERE field_value IS NOT NULL GROUP BY doc_id, field_name""")
def _(i):
    known = i.sql(_KNOWN.replace("FROM orders", "FROM {orders}"))
    return tables.bank_fields_from_cells(i.fixture("bank_cells"), known)


# --- HTML ------------------------------------------------------------------------------------

_HEAD = ("CASE WHEN o_orderkey % 4 = 0 THEN '<thead><tr><th>' ELSE '<tr><th>' END")
FIXTURES["html"] = f"""
SELECT o_orderkey AS doc_id, 'INV-' || {text('o_orderkey')} AS Invoice_No, pan_o, total_text,
       {damaged('ifsc_o', 'o_orderkey')} AS ifsc_raw,
       'Invoice text ' || o_orderpriority || chr(10)
       || CASE WHEN o_orderkey % 3 = 0 THEN '' ELSE '<TABLE border=1><tr><th>Bank  Name</th><th>Account No</th><th>IFSC Code</th><th>PAN</th></tr><tr><td> State <b>Bank</b> </td><td>00'
          || {text('o_orderkey')} || '</td><td>' || coalesce({damaged('ifsc_o', 'o_orderkey')}, '') || '</td><td>' || CASE WHEN o_orderkey % 2 = 0 THEN pan_o ELSE 'wrong' END || '</td></tr></TABLE>' END
       || CASE WHEN o_orderkey % 5 = 0 THEN '' ELSE '<table><tr><th>CGST</th><th>SGST</th></tr><tr><td>9</td><td>9</td></tr></table>' END
       || CASE WHEN o_orderkey % 7 = 0 THEN '' ELSE '<table><tr><th>Description</th><th>Region</th><th>ROI</th><th>Amount</th><th>Payout</th></tr><tr><td>Loan &amp; fee</td><td>North</td><td>'
          || {text('o_orderkey % 20')} || '.5</td><td>' || total_text || '</td><td></td></tr><tr><td></td><td></td><td></td><td></td><td></td></tr><tr><td>Second</td><td></td><td>n/a</td><td>1,2'
          || lpad({text('o_orderkey % 100')}, 2, '0') || '.10</td><td>7</td></tr></table><table><tr><th>payout</th></tr><tr><td>99</td></tr></table>' END
       || 'end' AS markdown
FROM {ORDERS}"""


@query("x29_html_table_classes", uses="html", sql="""
    SELECT doc_id, doc_id % 3 <> 0 AS has_bank, doc_id % 5 <> 0 AS has_gst, doc_id % 7 <> 0 AS has_invoice,
           CASE WHEN doc_id % 7 <> 0 THEN 'Description|Region|ROI|Amount|Payout' END AS invoice_header,
           CASE WHEN doc_id % 7 <> 0 THEN 3 END AS invoice_rows FROM html""")
def _(i):
    h = tables.with_tables(i.fixture("html").select("doc_id", "markdown"))
    return h.select(
        "doc_id", F.col("html.bank").isNotNull().alias("has_bank"), F.col("html.gst").isNotNull().alias("has_gst"),
        F.col("html.invoice").isNotNull().alias("has_invoice"),
        F.array_join("html.invoice.header", "|").alias("invoice_header"),
        F.when(F.col("html.invoice").isNotNull(), F.size("html.invoice.rows")).alias("invoice_rows"))


@query("x29_page_tables", sql="""
    SELECT page_id, CAST(0 AS INTEGER) AS n_tables, FALSE AS has_invoice FROM pages WHERE NOT contains(lower(html), '<table')""")
def _(i):
    h = tables.with_tables(i.table("pages").select("page_id", "html").withColumnRenamed("html", "markdown"))
    from fieldloom.functions.pyfuncs import html_tables

    return h.select(
        "page_id", F.size(html_tables("markdown")).alias("n_tables"),
        F.col("html.invoice").isNotNull().alias("has_invoice"))


@query("x26_bank_html_row", uses="html", sql=f"""
    SELECT doc_id, CASE WHEN b THEN 'State Bank' END AS Bank_Name, CASE WHEN b THEN '00' || doc_id END AS Bank_Account_No,
           CASE WHEN b THEN coalesce(nullif(regexp_extract(regexp_replace(upper(ifsc_raw), '[^A-Z0-9]', '', 'g'), '{rules.IFSC_PATTERN}'), ''),
                                     nullif(regexp_replace(upper(ifsc_raw), '[^A-Z0-9]', '', 'g'), '')) END AS Bank_IFSC_Code,
           CASE WHEN b AND doc_id % 2 = 0 THEN pan_o END AS Vendor_PAN_No
    FROM (SELECT *, doc_id % 3 <> 0 AS b FROM html) AS q""")
def _(i):
    h = tables.with_tables(i.fixture("html").select("doc_id", "markdown"))
    found = tables.bank_fields_from_html(F.col("html.bank"))
    return h.select("doc_id", *[
        found[n].alias(n) for n in ("Bank_Name", "Bank_Account_No", "Bank_IFSC_Code", "Vendor_PAN_No")])


_HTML_ITEMS_SQL = """
    SELECT doc_id, Invoice_No, 1 AS Sr_No, 'Loan & fee' AS Item_Description, 'North' AS Region,
           (doc_id % 20) * 100 + 50 AS roi, CAST(CAST(total_text AS DECIMAL(18,2)) * 100 AS BIGINT) AS amount, CAST(NULL AS BIGINT) AS payout
    FROM html WHERE doc_id % 7 <> 0
    UNION ALL SELECT doc_id, Invoice_No, 3, 'Second', NULL, NULL, 120010 + (doc_id % 100) * 100, 700 FROM html WHERE doc_id % 7 <> 0"""


def _html_items(i):
    h = tables.with_tables(i.fixture("html").select("doc_id", "Invoice_No", "markdown"))
    return tables.items_from_html(h, F.col("html.invoice"))


@query("x32_html_items", uses="html", sql=_HTML_ITEMS_SQL)
def _(i):
    return _html_items(i).select(
        "doc_id", "Invoice_No", "Sr_No", "Item_Description", "Region", paise(F.col("ROI_Percent")).alias("roi"),
        paise(F.col("Disbursement_Amount")).alias("amount"), paise(F.col("Total_Payout")).alias("payout"))


# --- item lines --------------------------------------------------------------------------------

FIXTURES["item_lines"] = f"""
SELECT l_orderkey AS doc_id, l_partkey, l_suppkey, l_linenumber,
       {money_of(LINE_PAISE)} AS amount, 'Part  ' || {text('l_partkey')} || '!!' AS description,
       CASE l_partkey % 4 WHEN 0 THEN 'BL' WHEN 1 THEN 'HSN9' ELSE '' END AS code,
       CASE l_partkey % 5 WHEN 0 THEN 'North Zone' || chr(10) || 'Acme Pvt' || chr(10) || '1,20,000' || chr(10) || '3.50' || chr(10) || '2%'
            WHEN 1 THEN 'Delhi' || chr(10) || ' Goa ' || chr(10) || '4.25' || chr(10) || '1.5%' || chr(10) || '3%'
            WHEN 2 THEN '1%' || chr(10) || '2%' || chr(10) || '3%' || chr(10) || '4%' || chr(10) || '77'
            WHEN 3 THEN 'X' ELSE '' END AS content
FROM {{lineitem}}"""


@query("x31_item_content_line", uses="item_lines", sql="""
    SELECT doc_id, l_partkey, l_suppkey, l_linenumber,
           CASE l_partkey % 5 WHEN 0 THEN 'North Zone' WHEN 1 THEN 'Goa' END AS region,
           CASE l_partkey % 5 WHEN 0 THEN 3.5::DOUBLE WHEN 1 THEN 4.25::DOUBLE END AS roi,
           CASE l_partkey % 5 WHEN 1 THEN 1.5::DOUBLE WHEN 2 THEN 1.0::DOUBLE END AS pf,
           CASE l_partkey % 5 WHEN 2 THEN 2.0::DOUBLE END AS payout,
           CASE l_partkey % 5 WHEN 0 THEN 2.0::DOUBLE WHEN 1 THEN 3.0::DOUBLE WHEN 2 THEN 3.0::DOUBLE END AS subvention
    FROM item_lines""")
def _(i):
    parsed = tables.parse_content_line(F.col("content"))
    names = {"Region": "region", "ROI_Percent": "roi", "PF_Percent": "pf", "Payout_Percent": "payout",
             "Subvention_Percent": "subvention"}
    return i.fixture("item_lines").select(
        "doc_id", "l_partkey", "l_suppkey", "l_linenumber", *[parsed[k].alias(v) for k, v in names.items()])


def _item_array(i):
    """One two-item list per line item, as the service would give it."""
    cells = "map<string," + analysis.CELL + ">"
    lines = i.fixture("item_lines")
    first = F.concat(
        F.lit('{"Description":{"type":"string","valueString":"'), F.col("description"),
        F.lit('"},"ProductCode":{"type":"string","content":"'), F.col("code"),
        F.lit('"},"Amount":{"type":"currency","valueCurrency":{"amount":'), F.col("amount"), F.lit("}}}"))
    second = F.concat(
        F.lit('{"Quantity":{"type":"string","valueString":"'), F.col("l_linenumber").cast("string"), F.lit('"}}'))
    key = F.struct("doc_id", "l_partkey", "l_suppkey", "l_linenumber").alias("doc_id")
    return lines.select(
        key, F.concat(F.lit("INV-"), F.col("doc_id").cast("string")).alias("Invoice_No"),
        F.array(
            F.struct(F.col("content"), F.from_json(first, cells).alias("valueObject")),
            F.struct(F.lit("").alias("content"), F.from_json(second, cells).alias("valueObject")),
        ).alias("items"))


@query("x30_items_from_array", uses="item_lines", sql="""
    SELECT doc_id, l_partkey, l_suppkey, l_linenumber, 'INV-' || doc_id AS Invoice_No, 1 AS Sr_No,
           'Part ' || l_partkey || '!' AS Item_Description, code AS HSN_Code, NULL AS Quantity,
           CAST(CAST(amount AS DECIMAL(18,2)) * 100 AS BIGINT) AS total FROM item_lines
    UNION ALL SELECT doc_id, l_partkey, l_suppkey, l_linenumber, 'INV-' || doc_id, 2, NULL, NULL, CAST(l_linenumber AS VARCHAR), NULL FROM item_lines""")
def _(i):
    return tables.items_from_array(_item_array(i)).select(
        "doc_id.*", "Invoice_No", "Sr_No", "Item_Description", "HSN_Code", "Quantity",
        paise(F.col("Total_Amount")).alias("total"))


@query("x33_items_choice", uses="html", sql=f"""
    SELECT doc_id, Sr_No, Item_Description, total FROM (
        SELECT o_orderkey AS doc_id, 1 AS Sr_No, 'Structured' AS Item_Description, CAST(NULL AS BIGINT) AS total FROM orders WHERE o_custkey % 2 = 0
        UNION ALL SELECT h.doc_id, Sr_No, Item_Description, amount FROM ({_HTML_ITEMS_SQL}) AS h JOIN orders ON o_orderkey = h.doc_id WHERE o_custkey % 2 <> 0) AS q""")
def _(i):
    structured = i.sql("""SELECT o_orderkey AS doc_id, 1 AS Sr_No, 'Structured' AS Item_Description FROM {orders} WHERE o_custkey % 2 = 0""")
    return tables.choose_items(structured, _html_items(i)).select(
        "doc_id", "Sr_No", "Item_Description", paise(F.col("Total_Amount")).alias("total"))


@query("j8_item_invoice_number", uses="item_lines", sql="""
    SELECT i.doc_id, l_partkey, l_suppkey, l_linenumber,
           coalesce(CASE WHEN o_custkey % 3 = 0 THEN NULL ELSE 'MERGED-' || o_orderkey END, 'PAGE') AS Invoice_No
    FROM item_lines i LEFT JOIN orders ON o_orderkey = i.doc_id""")
def _(i):
    merged = i.sql("""SELECT o_orderkey AS doc_id, CASE WHEN o_custkey % 3 = 0 THEN '' ELSE 'MERGED-' || CAST(o_orderkey AS STRING) END AS Invoice_No FROM {orders}""")
    items = i.fixture("item_lines").select("doc_id", "l_partkey", "l_suppkey", "l_linenumber", F.lit("PAGE").alias("Invoice_No"))
    return tables.with_invoice_number(items, merged)


@query("w7_item_sequence", sql="""
    SELECT o_orderkey AS doc_id, n AS Sr_No, string_split(o_orderpriority, '-')[n] AS piece
    FROM orders, LATERAL (SELECT unnest(range(1, len(string_split(o_orderpriority, '-')) + 1)) AS n) AS s""")
def _(i):
    rows = i.table("orders").select(F.col("o_orderkey").alias("doc_id"), F.split("o_orderpriority", "-").alias("pieces"))
    return tables.item_rows(rows, "pieces", "piece")


@query("w6_chunk_list", sql="""
    SELECT o_orderkey, CAST(floor((row_number() OVER (ORDER BY o_orderdate, o_orderkey) - 1) / 10) AS BIGINT) AS chunk_no FROM orders""")
def _(i):
    return ranking.chunk_rows(i.table("orders").select("o_orderkey", "o_orderdate"), ["o_orderdate", "o_orderkey"], 10).select(
        "o_orderkey", "chunk_no")


