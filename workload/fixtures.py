"""Inputs rendered from the driver tables.

The reference data has no identifiers, labels or cells, so they are written from
key columns with SQL that Spark and DuckDB read alike: every row of a table gives
rows of a fixture (variation comes from ``CASE`` on the key, never from a filter).
"""

from __future__ import annotations

from workload.base import FIXTURES


def text(expr) -> str:
    return f"CAST({expr} AS STRING)"


def idiv(a, b) -> str:
    return f"CAST(floor({a} / {b}) AS BIGINT)"


def letter(k, step) -> str:
    return f"chr(CAST(65 + {idiv(k, step)} % 26 AS INT))"


def pan_of(k) -> str:
    head = " || ".join(letter(k, p) for p in (1, 7, 31, 101, 211))
    return f"({head} || lpad({text(f'({k}) % 10000')}, 4, '0') || {letter(k, 3)})"


def gstin_of(k) -> str:
    return f"(lpad({text(f'({k}) % 38 + 1')}, 2, '0') || {pan_of(k)} || '1Z' || {text(f'({k}) % 10')})"


def ifsc_of(k) -> str:
    code = " ".join(f"WHEN {i} THEN '{c}'" for i, c in enumerate(("HDFC", "ICIC", "QQQQ", "SBIN", "ZZZZ")))
    return f"(CASE ({k}) % 5 {code} END || '0' || lpad({text(f'({k}) % 1000000')}, 6, '0'))"


def aadhaar_of(k) -> str:
    return f"lpad({text(f'({k}) * 7919 + 100000')}, 12, '4')"


def money_of(paise) -> str:
    return f"({text(idiv(paise, 100))} || '.' || lpad({text(f'({paise}) % 100')}, 2, '0'))"


def case(key, options: list[str], otherwise: str = "NULL") -> str:
    whens = " ".join(f"WHEN {i} THEN {o}" for i, o in enumerate(options))
    return f"CASE {key} {whens} ELSE {otherwise} END"


MONTH_NAME = case("month(o_orderdate) - 1", [f"'{m}'" for m in (
    "January", "February", "March", "April", "May", "June", "July",
    "August", "September", "October", "November", "December")])
YEAR = text("year(o_orderdate)")
MM, DD = (f"lpad({text(f'{p}(o_orderdate)')}, 2, '0')" for p in ("month", "day"))
M1, D1 = (text(f"{p}(o_orderdate)") for p in ("month", "day"))
PAISE = "CAST(round(o_totalprice * 100) AS BIGINT)"

DATE_TEXT = case("o_orderkey % 9", [
    f"{YEAR} || '-' || {MM} || '-' || {DD}",
    f"{D1} || '-' || {M1} || '-' || {YEAR}",
    f"{YEAR} || '/' || {MM} || '/' || {DD}",
    f"{DD} || '/' || {MM} || '/' || {YEAR}",
    f"{MM} || '/' || {DD} || '/' || {YEAR}",
    f"{D1} || ' ' || {MONTH_NAME} || ' ' || {YEAR}",
    f"{MONTH_NAME} || ' ' || {D1} || ', ' || {YEAR}",
    "'31/02/2024'",
    f"'on ' || {DD} || '.' || {MM} || '.' || {YEAR}",
])

AMOUNT_TEXT = case("o_orderkey % 8", [
    f"'₹' || {money_of(PAISE)}",
    f"'-' || {money_of(PAISE)}",
    f"'INR ' || {money_of(PAISE)}",
    "'1_000'",
    "'nan'",
    f"'$' || {text(idiv(PAISE, 100000))} || ',' || lpad({text(f'{idiv(PAISE, 100)} % 1000')}, 3, '0')",
    "'abc'",
], money_of(PAISE))


TYPE_OF_KEY = "CASE o_orderkey % 4 WHEN 0 THEN 'agreement' WHEN 1 THEN 'invoice' WHEN 2 THEN 'pan' ELSE 'aadhaar' END"


def damaged(value, key) -> str:
    return case(f"({key}) % 10", [
        f"substr({value}, 1, CAST(length({value}) - 1 AS INT))",
        f"replace({value}, '0', 'O')",
        f"lower({value})",
        "''",
        "NULL",
        f"'  ' || {value} || ' '",
    ], value)


# Orders with the rendered pieces as columns, so that each is computed once per row.
ORDERS = f"""(SELECT *, {PAISE} AS paise, {money_of(PAISE)} AS total_text, {DATE_TEXT} AS date_text, {AMOUNT_TEXT} AS amount_text,
       {pan_of('o_orderkey')} AS pan_o, {pan_of('o_custkey')} AS pan_c, {gstin_of('o_orderkey')} AS gstin_o,
       {gstin_of('o_custkey')} AS gstin_c, {aadhaar_of('o_orderkey')} AS aadhaar_o, {aadhaar_of('o_custkey')} AS aadhaar_c,
       {ifsc_of('o_orderkey')} AS ifsc_o, {TYPE_OF_KEY} AS document_type
FROM {{orders}}) AS o"""


# --- identifiers ---------------------------------------------------------------------

FIXTURES["ids"] = f"""
SELECT o_orderkey AS k,
       {damaged('gstin_o', 'o_orderkey')} AS gstin,
       {damaged('pan_o', 'o_orderkey')} AS pan,
       CASE o_orderkey % 6
            WHEN 0 THEN substr(aadhaar_o, 1, 4) || ' ' || substr(aadhaar_o, 5, 4)
                        || ' ' || substr(aadhaar_o, 9, 4)
            WHEN 1 THEN substr(aadhaar_o, 1, 4) || '-' || substr(aadhaar_o, 5, 8)
            WHEN 2 THEN 'XXXX XXXX ' || substr(aadhaar_o, 9, 4)
            WHEN 3 THEN NULL
            ELSE aadhaar_o END AS aadhaar,
       {damaged('ifsc_o', 'o_orderkey')} AS ifsc,
       {case('o_orderkey % 6', [
           f"'+91 98' || lpad({text('o_custkey')}, 3, '0') || '-' || lpad({text('o_orderkey % 100000')}, 5, '0')",
           f"'(022) ' || lpad({text('o_orderkey % 10000000')}, 7, '0')",
           "'12345'", "NULL", "'98765 43210x'",
       ], f"lpad({text('o_orderkey')}, 10, '9')")} AS phone,
       {case('o_orderkey % 5', [
           f"'user.' || {text('o_custkey')} || '@example.com'", f"'user' || {text('o_custkey')} || '@example'",
           "'no mail'", "''",
       ], f"'a+b_' || {text('o_custkey')} || '@mail.example.org'")} AS email,
       date_text AS date_text,
       amount_text AS amount_text,
       {case('o_orderkey % 12', [
           "'Yes'", "' TRUE '", "'1'", "'Not Required'", "'absent'", "''", "'maybe'", "NULL", "'Detected'", "'n'", "'0'",
       ], "'12/05/2024'")} AS flag_text
FROM {ORDERS}"""

# --- labelled pairs ---------------------------------------------------------------------

_INVOICE = [
    ("'Invoice No'", f"CASE WHEN o_orderkey % 17 = 0 THEN '  ' ELSE ' INV-' || {text('o_orderkey')} END"),
    ("'Invoice Date'", "date_text"),
    ("'Due Date'", f"CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE date_text END"),
    ("'Bill To'", f"'Customer ' || {text('o_custkey')} || ' '"),
    ("'Tax Amount'", f"CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE amount_text END"),
    ("CASE WHEN o_orderkey % 2 = 0 THEN 'TOTAL' ELSE 'Grand total amount' END",
     f"CASE WHEN o_orderkey % 11 = 0 THEN '' ELSE total_text END"),
    ("'Currency'", "CASE WHEN o_orderkey % 4 = 0 THEN 'USD' ELSE 'INR' END"),
    ("'Supplier GST'", "gstin_c"),
    ("'Remarks'", "o_orderpriority"),
]
_AGREEMENT = [
    ("'Agreement Date'", "date_text"),
    ("'Effective Date'", f"CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE date_text END"),
    ("'Parties'", f"'Customer ' || {text('o_custkey')}"),
    ("'Second Party'", f"CASE WHEN o_orderkey % 7 = 0 THEN '' ELSE 'Clerk ' || {text('o_orderkey % 100')} END"),
    ("'Type of Deed'", "o_orderpriority"),
    ("'Governing Law'", "'India'"),
    ("'Consideration Amount'", "amount_text"),
    ("'Notes'", "'none'"),
]
_PAN = [
    ("'PAN Number'", damaged('pan_o', "o_orderkey")),
    ("'Company Name'", f"CASE WHEN o_orderkey % 6 = 0 THEN pan_c ELSE NULL END"),
    ("'Full Name'", f"CASE WHEN o_orderkey % 13 = 0 THEN '' ELSE 'Person ' || {text('o_custkey')} END"),
    ("'Father''s Name'", f"'Parent ' || {text('o_custkey')}"),
    ("'Date of Birth'", "date_text"),
    ("'Gender'", "o_orderstatus"),
]
_AADHAAR = [
    ("'Aadhaar No.'", f"CASE WHEN o_orderkey % 4 = 1 THEN aadhaar_o ELSE '12-34' END"),
    ("'UID'", f"CASE WHEN o_orderkey % 3 = 0 THEN aadhaar_c ELSE NULL END"),
    ("'Name'", f"CASE WHEN o_orderkey % 19 = 0 THEN NULL ELSE 'Person ' || {text('o_custkey')} END"),
    ("'DOB'", "date_text"),
    ("'Gender'", "o_orderstatus"),
    ("'Postal Address'", f"{text('o_custkey')} || ' Main Road'"),
]
PAIRS = {"agreement": _AGREEMENT, "invoice": _INVOICE, "pan": _PAN, "aadhaar": _AADHAAR}

def _exploded(n: int, source: str = ORDERS) -> str:
    numbers = ", ".join(str(i) for i in range(n))
    return f"(SELECT *, @explode(@array({numbers})) AS seq FROM {source}) AS t"



def rows_of(rows: list[dict[str, str]]) -> str:
    """Array of structs; all columns but ``seq`` are text."""
    def struct(row):
        return ", ".join(
            f"'{name}', @as {expr if name == 'seq' else text(expr)}" for name, expr in row.items())

    return "@array(" + ", ".join(f"@row({struct(row)})" for row in rows) + ")"


def _pair_rows(pairs) -> str:
    return rows_of([{"seq": str(n), "label": a, "value": b} for n, (a, b) in enumerate(pairs)])


for _kind, _pairs in PAIRS.items():
    FIXTURES[f"kv_{_kind}"] = f"""
SELECT o_orderkey AS doc_id, @inline({_pair_rows(_pairs)}@end) FROM {ORDERS}"""

_ROWS_ALL = " ".join(f"WHEN {i} THEN {_pair_rows(p)}" for i, p in enumerate(PAIRS.values()))
FIXTURES["kv_all"] = f"""
SELECT o_orderkey AS doc_id, document_type, @inline(CASE o_orderkey % 4 {_ROWS_ALL} END@end) FROM {ORDERS}"""

FIXTURES["docs"] = f"""
SELECT o_orderkey AS doc_id, 'doc-' || {text('o_custkey')} AS document_name, document_type,
       'Input/' || document_type || '/files/doc-' || {text('o_orderkey')} || '.pdf' AS file_path,
       o_orderdate AS created_at
FROM {ORDERS}"""

# --- a mixed record ------------------------------------------------------------------------

_FIELDS = [
    ("pan_number", damaged('pan_o', "o_orderkey"), "str"),
    ("aadhaar_number", f"CASE WHEN o_orderkey % 3 = 0 THEN aadhaar_o ELSE '1234 5678' END", "str"),
    ("contact_email", case("o_orderkey % 3", ["'a@b.co'", "'bad mail'"], "''"), "str"),
    ("mobile", case("o_orderkey % 2", ["'+91 98765-43210'"], "'12345'"), "str"),
    ("invoice_date", "date_text", "str"),
    ("total_amount", "amount_text", "str"),
    ("unit_price", text(f"paise % 7 - 3"), "int"),
    ("liquidated_damages", "'as agreed'", "str"),
    ("contact_person", "'Clerk'", "str"),
    ("date_of_birth", "'unknown'", "str"),
    ("is_active", case("o_orderkey % 2", ["'True'"], "'False'"), "bool"),
    ("quantity", text("o_orderkey % 4"), "int"),
    ("name", case("o_orderkey % 5", ["''", "'  padded name  '"], "'Plain Name'"), "str"),
    ("tags", case("o_orderkey % 3", ["'[]'"], "'[\" a \",\"b\"]'"), "list"),
    ("validation", "'{{\"is_valid\":true}}'", "dict"),
    ("password", "'secret-' || " + text("o_orderkey"), "str"),
]
_FIELD_ROWS = rows_of([
    {"seq": str(n), "field_name": f"'{name}'", "field_value": v,
     "value_type": f"CASE WHEN {v} IS NULL THEN 'NoneType' ELSE '{t}' END"}
    for n, (name, v, t) in enumerate(_FIELDS)
])
FIXTURES["fields"] = f"""
SELECT o_orderkey AS doc_id, document_type, @inline({_FIELD_ROWS}@end) FROM {ORDERS}"""

# --- table cells ------------------------------------------------------------------------------

LINE_PAISE = "CAST(round(l_extendedprice * 100) AS BIGINT)"
# order of line items inside an order; equal only for identical lines
LINE_SEQ = "(l_linenumber * 100000000000 + l_partkey * 1000000 + l_suppkey * 100 + CAST(l_quantity AS BIGINT))"
FIXTURES["cells"] = f"""
SELECT doc_id, 0 AS table_no, CAST(col AS BIGINT) AS seq, 0 AS row_index, col AS column_index,
       {case('col', ["'Description'", "'Qty'", "'Rate'", "'Amount'"])} AS content
FROM (SELECT o_orderkey AS doc_id, @explode(@array(0, 1, 2, 3)) AS col FROM {{orders}}) AS h
UNION ALL
SELECT l_orderkey AS doc_id, 0 AS table_no, {LINE_SEQ} * 10 + slot + 100 AS seq,
       CAST(l_linenumber AS INT) AS row_index, CASE WHEN slot = 4 THEN 0 ELSE slot END AS column_index,
       {case('slot', [f"'Part ' || {text('l_partkey')}", text('CAST(l_quantity AS BIGINT)'),
                      money_of(idiv(LINE_PAISE, 'l_quantity')), money_of(LINE_PAISE)],
             f"'Part, ' || {text('l_partkey')} || chr(10) || 'repeat'")} AS content
FROM (SELECT *, @explode(@array(0, 1, 2, 3, 4)) AS slot FROM {{lineitem}}) AS t
WHERE CASE slot WHEN 0 THEN true WHEN 1 THEN l_partkey % 11 <> 0 WHEN 2 THEN l_partkey % 11 <> 0
                WHEN 3 THEN l_partkey % 7 <> 0 AND l_partkey % 11 <> 0 ELSE l_partkey % 13 = 0 END"""

_BANK_ROWS = [
    ("'Banking Details'", "''"),
    ("CASE WHEN o_orderkey % 2 = 0 THEN 'Payable To:' ELSE 'Beneficiary' END", f"'Vendor ' || {text('o_custkey')}"),
    ("'PAN :'", damaged('pan_o', "o_orderkey")),
    ("'Bank Name'", "CASE WHEN o_orderkey % 5 = 0 THEN '' ELSE ' HDFC  Bank' END"),
    ("'Branch'", f"'Branch ' || {text('o_custkey % 50')}"),
    ("'Account No.'", f"'0012 ' || {text('o_orderkey')}"),
    ("'IFSC code'", damaged('ifsc_o', "o_orderkey")),
    ("'Bank account (old)'", "'999'"),
]
FIXTURES["bank_cells"] = f"""
SELECT o_orderkey AS doc_id, CASE WHEN o_orderkey % 9 = 0 THEN 0 ELSE 1 END AS table_no, slot AS seq,
       {idiv('slot', 2)} AS row_index, slot % 2 AS column_index,
       coalesce(CASE WHEN slot % 2 = 0 THEN {case(idiv('slot', 2), [a for a, _ in _BANK_ROWS])}
            ELSE {case(idiv('slot', 2), [b for _, b in _BANK_ROWS])} END, '') AS content
FROM (SELECT *, @explode(@array({', '.join(str(i) for i in range(2 * len(_BANK_ROWS)))})) AS slot FROM {ORDERS}) AS t
UNION ALL
SELECT l_orderkey AS doc_id, 2 AS table_no, {LINE_SEQ} AS seq,
       CAST(l_linenumber AS BIGINT) AS row_index, 0 AS column_index, 'Branch ' || {text('l_partkey')} AS content
FROM {{lineitem}}"""

# --- tax lines -----------------------------------------------------------------------------------

FIXTURES["tax_lines"] = f"""
SELECT l_orderkey AS doc_id, {LINE_SEQ} AS seq,
       {case('l_partkey % 8', ["'CGST'", "'SGST 9%'", "'IGST @ 18%'", "'Tax'", "' c gst '", "''", "'i-gst 150 %'"],
             "'Total'")} AS content,
       CASE WHEN l_suppkey % 3 = 0 THEN NULL WHEN l_suppkey % 7 = 1 THEN CAST(0 AS DECIMAL(18,2))
            ELSE CAST({money_of(f'CAST(round(l_extendedprice * l_tax * 100) AS BIGINT)')} AS DECIMAL(18,2)) END AS amount,
       {case('l_linenumber % 5', ["'18'", "'0'", "'9.00'", "'250'"])} AS rate
FROM {{lineitem}}"""

# --- invoice records -----------------------------------------------------------------------------

_DEC = "DECIMAL(18,2)"


def dec(expr) -> str:
    return f"CAST({expr} AS {_DEC})"


FIXTURES["invoice"] = f"""
SELECT o_orderkey AS doc_id, 'INV/' || {text('o_orderkey % 5000')} || ' ' || o_orderstatus AS Invoice_No,
       gstin_o AS Vendor_GSTIN,
       CASE o_orderkey % 3 WHEN 0 THEN gstin_o WHEN 1 THEN gstin_c ELSE NULL END AS Company_GSTIN,
       CASE WHEN o_orderkey % 13 = 0 THEN NULL ELSE {dec('total_text')} END AS Total_Payable,
       CASE WHEN o_orderkey % 17 = 0 THEN {dec('total_text')} ELSE NULL END AS TotalAmount,
       CASE o_orderkey % 4 WHEN 0 THEN {dec(money_of(idiv('paise', 2)))} WHEN 1 THEN {dec('0')} ELSE NULL END AS Amount_Before_GST,
       CASE WHEN o_orderkey % 19 = 0 THEN {dec('10')} ELSE NULL END AS Amount_Before_GST_1,
       CASE o_orderkey % 5 WHEN 0 THEN {dec(money_of(idiv('paise', 20)))} ELSE {dec('0')} END AS CGST,
       CASE o_orderkey % 5 WHEN 0 THEN {dec(money_of(idiv('paise', 20)))} ELSE {dec('0')} END AS SGST,
       CASE o_orderkey % 5 WHEN 1 THEN {dec(money_of(idiv('paise', 10)))} ELSE {dec('0')} END AS IGST,
       CASE WHEN o_orderkey % 23 = 0 THEN {dec('7.77')} ELSE CAST(NULL AS {_DEC}) END AS Total_Tax,
       CASE WHEN o_orderkey % 7 = 0 THEN {dec(money_of(idiv('paise', 9)))} ELSE CAST(NULL AS {_DEC}) END AS TotalTaxAmount,
       CASE o_orderkey % 6 WHEN 0 THEN CAST(18 AS DECIMAL(18,6)) WHEN 1 THEN CAST(9.5 AS DECIMAL(18,6)) ELSE NULL END AS rate,
       CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE date_text END AS Invoice_Date,
       CASE WHEN o_orderkey % 8 = 0 THEN pan_c ELSE '' END AS Vendor_PAN_No,
       CAST(NULL AS STRING) AS Company_PAN_No
FROM {ORDERS}"""

FIXTURES["invoice_pages"] = f"""
SELECT o_orderkey AS doc_id, seq + 1 AS page_no,
       CASE WHEN (o_orderkey + seq) % 3 = 0 THEN NULL WHEN (o_orderkey + seq) % 3 = 1 THEN '' ELSE 'Vendor ' || {text('seq')} END AS Vendor_Name,
       CASE WHEN (o_orderkey + seq) % 4 = 0 THEN '0' ELSE 'INV-' || {text('o_orderkey + seq')} END AS Invoice_No,
       CASE WHEN (o_custkey + seq) % 3 = 0 THEN {dec('0')} ELSE {dec(money_of(f'(paise + seq * 37)'))} END AS CGST,
       CASE WHEN (o_custkey + seq) % 5 = 0 THEN NULL ELSE {dec('0 - seq')} END AS IGST,
       CASE WHEN (o_orderkey + seq) % 2 = 0 THEN {dec('0')} ELSE {dec(money_of(f'(paise - seq)'))} END AS TotalAmount,
       CASE WHEN (o_orderkey + seq) % 3 = 2 THEN 'True' ELSE 'False' END AS IRN_Flag,
       (o_orderkey + seq) % 3 = 2 AS Digital_Signature_Val
FROM {_exploded(3)}"""

# --- running text ----------------------------------------------------------------------------------

NL = "chr(10)"
_K = "(doc_id * 37 + n_chars)"
_BLOCK = [
    f"CASE doc_id % 4 WHEN 0 THEN 'Place of Supply : Delhi' WHEN 1 THEN 'place of  supply - Tamil Nadu' ELSE 'Supplied' END",
    f"CASE doc_id % 5 WHEN 0 THEN 'Due Date : 10-08-2026' WHEN 1 THEN 'Payment Due: 10-Aug-2026' WHEN 2 THEN 'due by - 2026-08-11' ELSE 'Due soon' END",
    f"CASE doc_id % 4 WHEN 0 THEN 'Amount Due : Rs. 1,23,' || {text('100 + doc_id % 900')} || '.50' WHEN 1 THEN 'Net Payable INR ' || {text(_K)} ELSE '' END",
    f"CASE doc_id % 3 WHEN 0 THEN 'PO No. : PO-' || {text('doc_id')} WHEN 1 THEN 'Purchase Order - x/' || {text('doc_id')} ELSE 'PO' END",
    f"CASE doc_id % 3 WHEN 0 THEN 'Customer ID : C-' || {text('doc_id')} ELSE 'Client of ours' END",
    f"CASE doc_id % 6 WHEN 0 THEN 'Rupees One Lakh Two Thousand Only.' ELSE '123' END",
    f"CASE doc_id % 4 WHEN 0 THEN 'Annexure product BL 3.50 GL' WHEN 1 THEN 'payout PL' WHEN 2 THEN 'HL alone' ELSE 'disbursal' END",
    f"CASE doc_id % 3 WHEN 0 THEN 'DL/2627/' || lpad({text('doc_id')}, 6, '0') WHEN 1 THEN 'Sales Invoice No' || {NL} || 'AB-' || {text('doc_id')} ELSE 'no number' END",
    f"CASE doc_id % 5 WHEN 0 THEN 'Digitally e-signed, IRN 5' WHEN 1 THEN 'An e-Invoice' ELSE 'paper' END",
    f"CASE doc_id % 7 WHEN 0 THEN 'Unity Bank' ELSE 'Bank' END",
    f"CASE doc_id % 4 WHEN 3 THEN 'Account' ELSE 'Banking  Details' END",
    f"CASE doc_id % 3 WHEN 0 THEN 'Payable to : Vendor ' || {text('doc_id')} WHEN 1 THEN 'payable to- A & B' ELSE 'payable' END",
    f"CASE doc_id % 4 WHEN 0 THEN 'Pan: ' || lower({pan_of(_K)}) WHEN 1 THEN {pan_of(_K)} ELSE 'none' END",
    f"CASE doc_id % 5 WHEN 0 THEN 'IFSC Code: ' || {ifsc_of(_K)} WHEN 1 THEN 'ABCD0123456 x ' || {ifsc_of(_K)} WHEN 2 THEN lower({ifsc_of(_K)}) || ' neft' ELSE '' END",
    f"CASE doc_id % 3 WHEN 0 THEN 'GSTIN ' || {gstin_of(_K)} ELSE 'unregistered' END",
    f"CASE doc_id % 6 WHEN 0 THEN 'Your Aadhaar No. : ' || substr({aadhaar_of('doc_id')}, 1, 4) || ' ' || substr({aadhaar_of('doc_id')}, 5, 4) || ' ' || substr({aadhaar_of('doc_id')}, 9, 4)"
    f" WHEN 1 THEN 'Aadhaar No: xxxx xxxx ' || substr({aadhaar_of('doc_id')}, 9, 4) WHEN 2 THEN 'Aadhaar No. 1234 5678 90123' ELSE 'card' END",
    f"CASE doc_id % 4 WHEN 1 THEN 'ref 2345 6789 0123' ELSE '' END",
    f"CASE doc_id % 3 WHEN 0 THEN 'Enrolment No.: 1234/56789/' || {text('doc_id')} || ' VID : 91' || {text('doc_id')} ELSE '' END",
    f"CASE doc_id % 4 WHEN 0 THEN 'DOB: 01/02/1990' WHEN 1 THEN 'born 03/04/1985' ELSE 'DOB unknown' END",
    f"CASE doc_id % 3 WHEN 0 THEN 'S/O: Ram Kumar' WHEN 1 THEN 'w/o Sita' ELSE 'self' END",
    f"CASE doc_id % 3 WHEN 0 THEN 'Delhi 110' || lpad({text('doc_id % 1000')}, 3, '0') ELSE 'Delhi' END",
    f"CASE doc_id % 5 WHEN 0 THEN 'CIN L12345MH2001PLC' || lpad({text('doc_id')}, 6, '0') ELSE '' END",
    f"CASE doc_id % 4 WHEN 0 THEN 'Stamp Duty: Rs. 1,' || lpad({text('doc_id % 1000')}, 3, '0') ELSE 'Stamped' END",
    f"CASE doc_id % 6 WHEN 0 THEN 'Commission, for the month' || {NL} || 'x' || {NL} || 'y' || {NL} || 'May - 24' WHEN 1 THEN 'Service of the firm' || {NL} || 'a' || {NL} || 'b' || {NL} || 'c' || {NL} || 'd' || {NL} || 'June 2025' WHEN 2 THEN 'bill for July, 2026' ELSE 'bill' END",
]
FIXTURES["texts"] = f"""
SELECT doc_id, text || {NL} || {(' || ' + NL + ' || ').join('(' + b + ')' for b in _BLOCK)} || {NL} AS content,
       CASE doc_id % 3 WHEN 0 THEN {gstin_of(_K)} WHEN 1 THEN 'short' ELSE NULL END AS Company_GSTIN,
       CASE doc_id % 4 WHEN 0 THEN 'ACP/2627/BL/' || {text('doc_id')} WHEN 1 THEN '626/od/' || {text('doc_id')} ELSE NULL END AS Invoice_No,
       CASE doc_id % 5 WHEN 0 THEN ' gl ' WHEN 1 THEN 'zz' ELSE NULL END AS product_code,
       CASE doc_id % 3 WHEN 0 THEN 'Vendor ' || {text('doc_id')} ELSE 'Somebody' END AS Vendor_Name,
       CASE doc_id % 4 WHEN 0 THEN 'somebody ' WHEN 1 THEN 'Nominee ' || {text('doc_id')} ELSE NULL END AS named,
       CASE doc_id % 7 WHEN 0 THEN 'Payee' ELSE NULL END AS payble_to,
       CASE doc_id % 2 WHEN 0 THEN ' Remit ' ELSE NULL END AS Vendor_Name_2
FROM {{documents}}"""

# --- conversations as pages --------------------------------------------------------------------------

FIXTURES["page_texts"] = """
SELECT conv_id AS doc_id, turn AS page_no, text FROM {conversations}"""

# --- folders and files ---------------------------------------------------------------------------------

FOLDERS = [
    ("Aadhar", "aadhaar"), ("AAdhar cards", "aadhaar"), ("ADHAAR", "aadhaar"), ("PAN", "pan"), ("pann", "pan"),
    ("pan_cards", "pan"), ("Agreements", "agreement"), ("Aggrements", "agreement"), ("japan", "pan"),
    ("xyz", None), ("Invoices", None), ("2024", None), ("deeds", "agreement"), ("contractt", "agreement"),
    ("uidai", "aadhaar"), ("agreement-2024", "agreement"),
]
EXTENSIONS = [".pdf", ".PDF", ".jpg", ".Tiff", ".txt", ".tar.gz", "", ".", ".webp"]
FIXTURES["files"] = f"""
SELECT c_custkey AS doc_id,
       'file:/data/Documents/' || {case(f'c_custkey % {len(FOLDERS)}', [f"'{f}'" for f, _ in FOLDERS])}
       || '/' || CASE WHEN c_custkey % 21 = 0 THEN '.hidden' ELSE '' END || 'scan ' || {text('c_custkey')}
       || {case(f'c_custkey % {len(EXTENSIONS)}', [f"'{e}'" for e in EXTENSIONS])} AS path,
       CAST(round(c_acctbal * 100) AS BIGINT) * CAST(round(c_acctbal * 100) AS BIGINT) AS length
FROM {{customer}}"""
INPUT_FOLDERS = ["agreement", "Invoices", "pan", "Aadhar", "misc"]
FIXTURES["input_files"] = f"""
SELECT o_orderkey AS doc_id,
       'file:/data/Input/' || {case('o_orderkey % 5', [f"'{f}'" for f in INPUT_FOLDERS])} || '/'
       || CASE WHEN o_orderkey % 5 < 3 AND o_orderkey % 3 <> 0 THEN 'files/' ELSE '' END
       || CASE WHEN o_orderkey % 31 = 0 THEN 'old/' WHEN o_orderkey % 37 = 0 THEN 'Input/' ELSE '' END
       || 'doc-' || {text('o_orderkey')} || CASE o_orderkey % 7 WHEN 0 THEN '.PDF' WHEN 1 THEN '.txt' ELSE '.pdf' END AS path
FROM {{orders}}"""

# --- model answers ----------------------------------------------------------------------------------------

_OBJECT = (
    f"'{{{{\"invoice_number\": \"INV-' || {text('o_orderkey')} || '\", \"total\": ' || total_text"
    f" || ', \"nested\": {{{{\"status\": \"' || o_orderstatus || '\"}}}}' || CASE WHEN o_orderkey % 2 = 0 THEN ',' ELSE '' END || '}}}}'"
)
FIXTURES["answers"] = f"""
SELECT o_orderkey AS doc_id,
       CASE o_orderkey % 5
            WHEN 0 THEN '```json' || {NL} || {_OBJECT} || {NL} || '```'
            WHEN 1 THEN 'Here it is: ' || {_OBJECT} || ' and {{{{more}}}} later'
            WHEN 2 THEN '  ``` ' || {_OBJECT} || '```  '
            WHEN 3 THEN 'no object at all'
            ELSE {_OBJECT} END AS answer
FROM {ORDERS}"""

# --- analysis JSON ------------------------------------------------------------------------------------------


def jstr(expr) -> str:
    return f"'\"' || {expr} || '\"'"


def jcell(name, expr, kind="valueString", wrap=True) -> str:
    body = jstr(expr) if wrap else expr
    return f"'\"{name}\":{{{{\"type\":\"string\",\"{kind}\":' || {body} || '}}}}'"


def _join(parts, sep="','") -> str:
    return f" || {sep} || ".join(parts)


_FIELDS_JSON = _join([
    jcell("InvoiceId", f"'ACP/26/' || {text('o_orderkey')}"),
    jcell("VendorName", f"' Vendor  ' || {text('o_custkey')} || ' '"),
    jcell("VendorTaxId", f"CASE WHEN o_orderkey % 4 = 0 THEN pan_c ELSE 'GSTIN: ' || gstin_c END"),
    jcell("CustomerTaxId", f"CASE WHEN o_orderkey % 3 = 0 THEN 'n/a' ELSE gstin_o END"),
    jcell("InvoiceDate", f"{YEAR} || '-' || {MM} || '-' || {DD}", "valueDate"),
    f"'\"InvoiceTotal\":{{{{\"type\":\"currency\",\"valueCurrency\":{{{{\"amount\":' || total_text || '}}}}}}}}'",
    f"'\"SubTotal\":{{{{\"type\":\"currency\",\"content\":\"INR ' || total_text || '\"}}}}'",
    f"'\"VendorAddress\":{{{{\"type\":\"address\",\"content\":\"No. ' || {text('o_custkey')} || ',, Main  Road\"}}}}'",
    jcell("bank_account_no", f"'A/C 00-' || {text('o_orderkey')} || ' x'"),
    jcell("ifsc_code", f"'IFSC ' || ifsc_o"),
    jcell("vendor_pan_no", f"CASE WHEN o_orderkey % 5 = 0 THEN '' ELSE lower(pan_o) END"),
    f"'\"Legacy\":{{{{\"value\":' || {text('o_orderkey')} || '}}}}'",
])
_TABLE_JSON = (
    "'{{\"rowCount\":2,\"columnCount\":2,\"cells\":["
    "{{\"rowIndex\":0,\"columnIndex\":0,\"content\":\"Item\",\"rowSpan\":1,\"columnSpan\":1}},"
    "{{\"rowIndex\":0,\"columnIndex\":1,\"content\":\"Price\"}},"
    f"{{{{\"rowIndex\":1,\"columnIndex\":0,\"content\":\"Order ' || {text('o_orderkey')} || '\"}}}},"
    f"{{{{\"rowIndex\":1,\"columnIndex\":1,\"content\":\"' || total_text || '\"}}}}]}}}}'"
).replace("'{{\"rowCount", "'{{\"rowCount")
CONTENT = f"('Order ' || {text('o_orderkey')} || ' page one.' || 'Status ' || o_orderstatus || ' page two.')"
_LEN1 = f"length('Order ' || {text('o_orderkey')} || ' page one.')"
_LEN2 = "length('Status ' || o_orderstatus || ' page two.')"
_ANALYSIS = (
    f"'{{{{\"analyzeResult\":{{{{\"content\":' || {jstr(CONTENT)} || ',\"tables\":[' || {_TABLE_JSON} || '],'"
    f" || '\"keyValuePairs\":[{{{{\"key\":{{{{\"content\":\"Invoice No\"}}}},\"value\":{{{{\"content\":\"INV-' || {text('o_orderkey')} || '\"}}}}}}}},'"
    f" || '{{{{\"key\":{{{{\"content\":\"Total\"}}}},\"value\":{{{{\"content\":\"' || total_text || '\"}}}}}}}},'"
    f" || '{{{{\"key\":{{{{\"content\":\"Remarks\"}}}}}}}},'"
    f" || '{{{{\"key\":{{{{\"content\":\"Invoice No\"}}}},\"value\":{{{{\"content\":\"LAST-' || {text('o_orderkey')} || '\"}}}}}}}}],'"
    f" || '\"pages\":[{{{{\"pageNumber\":1,\"width\":8.5,\"height\":11.0,\"spans\":[{{{{\"offset\":0,\"length\":' || {text(_LEN1)} || '}}}}]}}}},'"
    f" || '{{{{\"pageNumber\":2,\"width\":8.5,\"height\":11.0,\"spans\":[{{{{\"offset\":' || {text(_LEN1)} || ',\"length\":6}}}},{{{{\"offset\":'"
    f" || {text(f'{_LEN1} + 6')} || ',\"length\":' || {text(f'{_LEN2} - 6')} || '}}}}]}}}}],'"
    f" || '\"paragraphs\":[{{{{\"content\":\"Title ' || {text('o_custkey')} || '\",\"role\":\"title\"}}}},{{{{\"content\":\"Body ' || o_orderpriority || '\"}}}}],'"
    f" || '\"documents\":[{{{{\"fields\":{{{{' || {_FIELDS_JSON} || '}}}}}}}}]}}}}}}}}'"
)
FIXTURES["analysis"] = f"""
SELECT o_orderkey AS doc_id, CASE WHEN o_orderkey % 29 = 0 THEN '{{{{broken' ELSE {_ANALYSIS} END AS json
FROM {ORDERS}""".replace("'{{{{broken'", "'{{broken'")
