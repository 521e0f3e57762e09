"""Tax lines, amount derivation and the page merge."""

from __future__ import annotations

from pyspark.sql import functions as F

from fieldloom.operators import pages, tax
from workload.base import query
from workload.q_checks import paise

KIND_SQL = """CASE WHEN regexp_matches(lower(trim(content)), 'cgst|csgt|c gst|c-gst|cg st') THEN 'CGST'
    WHEN regexp_matches(lower(trim(content)), 'sgst|s gst|s-gst|sg st') THEN 'SGST'
    WHEN regexp_matches(lower(trim(content)), 'igst|i gst|i-gst|ig st') THEN 'IGST' END"""


@query("g8_tax_from_lines", uses="tax_lines", sql=f"""
    WITH lines AS (SELECT doc_id, seq, {KIND_SQL} AS kind, amount FROM tax_lines),
    seg AS (SELECT *, count(kind) OVER (PARTITION BY doc_id ORDER BY seq) AS s,
                   max(kind) OVER (PARTITION BY doc_id ORDER BY seq ROWS BETWEEN CURRENT ROW AND CURRENT ROW) AS k FROM lines),
    heads AS (SELECT doc_id, s, max(kind) AS kind FROM seg WHERE kind IS NOT NULL GROUP BY ALL),
    claims AS (SELECT g.doc_id, g.s, arg_min(g.amount, g.seq) AS amount FROM seg g WHERE g.amount IS NOT NULL AND g.s > 0 GROUP BY ALL),
    first AS (SELECT h.doc_id, h.kind, arg_min(c.amount, c.s) AS amount FROM claims c JOIN heads h ON h.doc_id = c.doc_id AND h.s = c.s
              WHERE c.amount <> 0 GROUP BY ALL)
    SELECT d.doc_id, CAST(coalesce(max(amount) FILTER (kind = 'CGST'), 0) * 100 AS BIGINT) AS cgst,
           CAST(coalesce(max(amount) FILTER (kind = 'SGST'), 0) * 100 AS BIGINT) AS sgst,
           CAST(coalesce(max(amount) FILTER (kind = 'IGST'), 0) * 100 AS BIGINT) AS igst
    FROM (SELECT DISTINCT doc_id FROM tax_lines) d LEFT JOIN first f ON f.doc_id = d.doc_id GROUP BY d.doc_id""")
def _(i):
    return tax.tax_from_lines(i.fixture("tax_lines")).select(
        "doc_id", *[paise(F.col(k)).alias(k.lower()) for k in ("CGST", "SGST", "IGST")])


@query("m1_gst_rate", uses="tax_lines", sql=r"""
    WITH r AS (SELECT doc_id, seq, try_cast(rate AS DOUBLE) AS n, try_cast(nullif(regexp_extract(trim(content), '([0-9]+(?:\.[0-9]+)?)\s*%', 1), '') AS DOUBLE) AS p FROM tax_lines),
    u AS (SELECT doc_id, seq, coalesce(CASE WHEN n > 0 AND n <= 100 THEN n END, CASE WHEN p > 0 AND p <= 100 THEN p END) AS rate FROM r)
    SELECT doc_id, CAST(arg_min(rate, seq) FILTER (rate IS NOT NULL) * 100 AS BIGINT) AS rate FROM u GROUP BY doc_id""")
def _(i):
    return tax.rates_from_lines(i.fixture("tax_lines")).select("doc_id", paise(F.col("rate")).alias("rate"))


SAME = "(regexp_full_match(substr(Vendor_GSTIN, 1, 2), '[0-9]+') AND coalesce(substr(Vendor_GSTIN, 1, 2) = substr(Company_GSTIN, 1, 2), FALSE))"
M2_SQL = """SELECT * REPLACE (CASE WHEN Amount_Before_GST IS NULL AND Total_Payable > 0 AND CGST + SGST + IGST > 0 AND CGST + SGST + IGST < Total_Payable
    THEN Total_Payable - CGST - SGST - IGST ELSE Amount_Before_GST END AS Amount_Before_GST) FROM invoice"""
M3_SQL = f"""SELECT * EXCLUDE (go, base, half, tx) REPLACE (
    CASE WHEN go AND Amount_Before_GST IS NULL THEN base ELSE Amount_Before_GST END AS Amount_Before_GST,
    CASE WHEN go THEN CASE WHEN {SAME} THEN half ELSE 0 END ELSE CGST END AS CGST,
    CASE WHEN go THEN CASE WHEN {SAME} THEN half ELSE 0 END ELSE SGST END AS SGST,
    CASE WHEN go THEN CASE WHEN {SAME} THEN 0 ELSE tx END ELSE IGST END AS IGST)
  FROM (SELECT *, CAST(CAST((CAST(tx * 100 AS BIGINT) + 1) // 2 AS DECIMAL(18,0)) * 0.01 AS DECIMAL(18,2)) AS half FROM (
        SELECT *, Total_Payable - base AS tx FROM (
        SELECT *, CGST = 0 AND SGST = 0 AND IGST = 0 AND rate IS NOT NULL AND coalesce(Total_Payable > 0, FALSE) AS go,
               CAST(CAST((2000 * CAST(Total_Payable * 100 AS BIGINT) + 1000 + CAST(rate * 10 AS BIGINT)) // (2 * (1000 + CAST(rate * 10 AS BIGINT))) AS DECIMAL(18,0)) * 0.01 AS DECIMAL(18,2)) AS base FROM {{src}}) AS a) AS b) AS c"""
M4_SQL = f"""SELECT * EXCLUDE (tx, use) REPLACE (
    CASE WHEN use AND {SAME} THEN CAST(CAST((CAST(tx * 100 AS BIGINT) + 1) // 2 AS DECIMAL(18,0)) * 0.01 AS DECIMAL(18,2)) ELSE CGST END AS CGST,
    CASE WHEN use AND {SAME} THEN CAST(CAST((CAST(tx * 100 AS BIGINT) + 1) // 2 AS DECIMAL(18,0)) * 0.01 AS DECIMAL(18,2)) ELSE SGST END AS SGST,
    CASE WHEN use AND NOT {SAME} THEN tx ELSE IGST END AS IGST)
  FROM (SELECT *, CGST = 0 AND SGST = 0 AND IGST = 0 AND (rate IS NULL OR Total_Payable IS NULL) AND coalesce(tx, 0) <> 0 AS use FROM (
        SELECT *, coalesce(nullif(Total_Tax, 0), TotalTaxAmount,
            CASE WHEN coalesce(Total_Payable, TotalAmount) > Amount_Before_GST AND Amount_Before_GST <> 0
                 THEN coalesce(Total_Payable, TotalAmount) - Amount_Before_GST END) AS tx FROM {{src}}) AS a) AS b"""
OUT_SQL = """SELECT doc_id, CAST(Amount_Before_GST * 100 AS BIGINT) AS base, CAST(CGST * 100 AS BIGINT) AS cgst,
    CAST(SGST * 100 AS BIGINT) AS sgst, CAST(IGST * 100 AS BIGINT) AS igst FROM ({src}) AS answer"""


def _taxes(df):
    return df.select(
        "doc_id", paise(F.col("Amount_Before_GST")).alias("base"),
        *[paise(F.col(k)).alias(k.lower()) for k in ("CGST", "SGST", "IGST")])


@query("m2_base_from_tax", uses="invoice", sql=OUT_SQL.format(src=M2_SQL))
def _(i):
    return _taxes(tax.base_from_tax(i.fixture("invoice")))


@query("m3_split_by_rate", uses="invoice", sql=OUT_SQL.format(src=M3_SQL.format(src="invoice")))
def _(i):
    return _taxes(tax.split_by_rate(i.fixture("invoice")))


@query("m4_split_by_state", uses="invoice", sql=OUT_SQL.format(src=M4_SQL.format(src="invoice")))
def _(i):
    return _taxes(tax.split_by_state(i.fixture("invoice")))


GST_SQL = M4_SQL.format(src="(" + M3_SQL.format(src=f"({M2_SQL}) AS m2") + ") AS m3")


@query("m_gst_amounts", uses="invoice", sql=OUT_SQL.format(src=GST_SQL))
def _(i):
    return _taxes(tax.gst_amounts(i.fixture("invoice")))


M5_SQL = """
    SELECT *, CASE WHEN coalesce(TotalAmount, 0) = 0 THEN CASE WHEN coalesce(base2, 0) <> 0 AND coalesce(tt, 0) <> 0 THEN base2 + tt
                        WHEN coalesce(Total_Payable, 0) <> 0 THEN Total_Payable ELSE TotalAmount END ELSE TotalAmount END AS total2
    FROM (SELECT *, CASE WHEN coalesce(Amount_Before_GST, 0) = 0 AND coalesce(Amount_Before_GST_1, 0) = 0 AND coalesce(Total_Payable, 0) <> 0
                              AND (CGST > 0 OR SGST > 0 OR IGST > 0) AND Total_Payable - CGST - SGST - IGST > 0
                         THEN Total_Payable - CGST - SGST - IGST ELSE Amount_Before_GST END AS base2,
                    CASE WHEN coalesce(TotalTaxAmount, 0) = 0 AND coalesce(tt, 0) <> 0 THEN tt ELSE TotalTaxAmount END AS tta
          FROM (SELECT *, CASE WHEN coalesce(Total_Tax, 0) = 0 AND CGST + SGST + IGST > 0 THEN CGST + SGST + IGST ELSE Total_Tax END AS tt FROM invoice) AS a) AS b"""


@query("m5_derive_totals", uses="invoice", sql=f"""
    SELECT doc_id, CAST(tt * 100 AS BIGINT) AS total_tax, CAST(base2 * 100 AS BIGINT) AS base,
           CAST(tta * 100 AS BIGINT) AS tax_amount, CAST(total2 * 100 AS BIGINT) AS total FROM ({M5_SQL}) AS q""")
def _(i):
    return tax.derive_totals(i.fixture("invoice")).select(
        "doc_id", paise(F.col("Total_Tax")).alias("total_tax"), paise(F.col("Amount_Before_GST")).alias("base"),
        paise(F.col("TotalTaxAmount")).alias("tax_amount"), paise(F.col("TotalAmount")).alias("total"))


@query("m6_normal_dates", uses="invoice", sql=r"""
    SELECT doc_id, CASE WHEN Invoice_Date IS NULL THEN NULL WHEN try_strptime(Invoice_Date, '%Y-%m-%d') IS NOT NULL THEN Invoice_Date
        ELSE coalesce(CAST(CAST(coalesce(try_strptime(c, '%Y/%m/%d'), try_strptime(c, '%d/%m/%Y'), try_strptime(c, '%m/%d/%Y'), try_strptime(c, '%d-%m-%Y'),
             try_strptime(c, '%d.%m.%Y'), try_strptime(c, '%d %b %Y'), try_strptime(c, '%d %B %Y'), try_strptime(c, '%B %d, %Y')) AS DATE) AS VARCHAR), Invoice_Date) END AS d
    FROM (SELECT doc_id, Invoice_Date, regexp_extract(Invoice_Date, '\b([0-9]{4}[-/.][0-9]{2}[-/.][0-9]{2}|[0-9]{2}[-/.][0-9]{2}[-/.][0-9]{4}|[0-9]{2}[-/.][0-9]{2}[-/.][0-9]{2}|[0-9]{2}\s+(?:January|February|March|April|May|June|July|August|September|October|November|December),?\s+[0-9]{4}|[0-9]{1,2}\s+(?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)\s+[0-9]{4}|(?:January|February|March|April|May|June|July|August|September|October|November|December)\s+[0-9]{1,2},?\s*[0-9]{4})\b', 1) AS c FROM invoice) AS q""")
def _(i):
    return i.fixture("invoice").select("doc_id", tax.normal_date(F.col("Invoice_Date")).alias("d"))


@query("m7_company_override", uses="texts", sql="""
    SELECT doc_id, CASE WHEN contains(lower(content), 'unity') AND contains(lower(content), 'bank')
                        THEN 'Unity Small Finance bank limited' ELSE Vendor_Name END AS name FROM texts""")
def _(i):
    return i.fixture("texts").select(
        "doc_id", tax.company_name(F.col("Vendor_Name"), F.col("content")).alias("name"))


@query("m8_repair_then_pan", uses="invoice", sql="""
    SELECT doc_id, Vendor_GSTIN AS vendor_gstin, coalesce(nullif(Vendor_PAN_No, ''), substr(Vendor_GSTIN, 3, 10)) AS vendor_pan,
           substr(Company_GSTIN, 3, 10) AS company_pan FROM invoice""")
def _(i):
    # the repair has something to do: one character is read wrongly first
    inv = i.fixture("invoice")
    misread = inv.withColumn("Vendor_GSTIN", F.concat(
        F.substring("Vendor_GSTIN", 1, 13), F.lit("2"), F.substring("Vendor_GSTIN", 15, 1)))
    return tax.repair_identifiers(misread).select(
        "doc_id", F.col("Vendor_GSTIN").alias("vendor_gstin"), F.col("Vendor_PAN_No").alias("vendor_pan"),
        F.col("Company_PAN_No").alias("company_pan"))


@query("g7_page_merge", uses="invoice_pages", sql="""
    SELECT doc_id, coalesce(arg_min(Vendor_Name, page_no) FILTER (Vendor_Name NOT IN ('', '0', '0.0')), max(Vendor_Name) FILTER (page_no = 1)) AS vendor,
           coalesce(arg_min(Invoice_No, page_no) FILTER (Invoice_No NOT IN ('', '0', '0.0')), max(Invoice_No) FILTER (page_no = 1)) AS invoice_no,
           CAST(coalesce(max(CGST) FILTER (CGST <> 0), max(CGST) FILTER (page_no = 1)) * 100 AS BIGINT) AS cgst,
           CAST(coalesce(max(IGST) FILTER (IGST <> 0), max(IGST) FILTER (page_no = 1)) * 100 AS BIGINT) AS igst,
           CAST(coalesce(arg_min(TotalAmount, page_no) FILTER (TotalAmount <> 0), max(TotalAmount) FILTER (page_no = 1)) * 100 AS BIGINT) AS total,
           max(IRN_Flag) FILTER (page_no = 1) AS irn, bool_or(Digital_Signature_Val) AS signed
    FROM invoice_pages GROUP BY doc_id""")
def _(i):
    return pages.merge_pages(i.fixture("invoice_pages")).select(
        "doc_id", F.col("Vendor_Name").alias("vendor"), F.col("Invoice_No").alias("invoice_no"),
        paise(F.col("CGST")).alias("cgst"), paise(F.col("IGST")).alias("igst"), paise(F.col("TotalAmount")).alias("total"),
        F.col("IRN_Flag").alias("irn"), F.col("Digital_Signature_Val").alias("signed"))


@query("u1_concat_page_items", sql="""
    SELECT l_orderkey AS doc_id, l_partkey, 1 AS page_no, l_quantity AS quantity, NULL AS discount FROM lineitem WHERE l_returnflag = 'A'
    UNION ALL SELECT l_orderkey, l_partkey, 2, NULL, l_discount FROM lineitem WHERE l_returnflag <> 'A'""")
def _(i):
    li = i.table("lineitem").withColumnRenamed("l_orderkey", "doc_id")
    one = li.where("l_returnflag = 'A'").select("doc_id", "l_partkey", F.lit(1).alias("page_no"), F.col("l_quantity").alias("quantity"))
    two = li.where("l_returnflag <> 'A'").select("doc_id", "l_partkey", F.lit(2).alias("page_no"), F.col("l_discount").alias("discount"))
    return pages.union_items(one, two)


