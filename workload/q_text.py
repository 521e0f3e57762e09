"""Values found in running text (whole documents plus rendered lines)."""

from __future__ import annotations

from pyspark.sql import functions as F

from fieldloom import rules
from fieldloom.functions.pyfuncs import map_model, pattern_fields, pattern_model
from fieldloom.operators import content, pages, reports, schemas
from fieldloom.plans import identity
from workload.base import FIXTURES, query, values
from workload.q_checks import paise

P = rules.TEXT_PATTERNS


def rx(name: str) -> str:
    """Pattern for an oracle string literal."""
    return P[name].replace("'", "''")


def found(name: str, column: str = "content", group: int = 1) -> str:
    return f"nullif(regexp_extract({column}, '{rx(name)}', {group}), '')"


def clean_sql(expr: str) -> str:
    return (f"nullif(trim(regexp_replace(regexp_replace(trim({expr}, E' \\t\\n\\r'), '\\s+', ' ', 'g'), "
            f"'([!?.,;:]){{2,}}', '\\1', 'g')), '')")


@query("x19_document_flags", uses="texts", sql="""
    SELECT doc_id, CASE WHEN contains(lower(content), 'irn') THEN 'True' ELSE 'False' END AS irn,
           CASE WHEN contains(lower(content), 'e-invoice') THEN 'True' ELSE 'False' END AS e_invoice,
           contains(lower(content), 'digitally') OR contains(lower(content), 'signed') AS signed FROM texts""")
def _(i):
    flags = content.document_flags(F.col("content"))
    return i.fixture("texts").select(
        "doc_id", flags["IRN_Flag"].alias("irn"), flags["E_Invoice_Flag"].alias("e_invoice"),
        flags["Digital_Signature_Val"].alias("signed"))


_MONTHS_SQL = "|".join(f"{m[:3]}(?:{m[3:]})?" if len(m) > 3 else m for m in rules.MONTHS)
_TOKENS = [m + y for m in dict.fromkeys([m.lower() for m in rules.MONTHS] + [m[:3].lower() for m in rules.MONTHS])
           for y in ("2026", "26", "2025", "25")]


@query("x20_commission_month", uses="texts", sql=rf"""
    WITH paras AS (SELECT doc_id, seq, piece FROM (SELECT doc_id, unnest(string_split(content, chr(10))) AS piece,
                          generate_subscripts(string_split(content, chr(10)), 1) - 1 AS seq FROM texts) AS s),
    ahead AS (SELECT doc_id, seq, string_agg(piece, ' ') OVER (PARTITION BY doc_id ORDER BY seq ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING) AS txt,
                     upper(regexp_replace(piece, '[^A-Za-z0-9]', ' ', 'g')) AS w FROM paras),
    hits AS (SELECT doc_id, seq, regexp_extract(txt, '(?i)\b({_MONTHS_SQL})\s*[-,]?\s*([0-9]{{2,4}})\b', 1) AS m,
                    regexp_extract(txt, '(?i)\b({_MONTHS_SQL})\s*[-,]?\s*([0-9]{{2,4}})\b', 2) AS y
             FROM ahead WHERE (contains(w, 'SERVICE') OR contains(w, 'COMMISSION')) AND (contains(w, 'OF') OR contains(w, 'FOR')) AND contains(w, 'THE')),
    best AS (SELECT doc_id, arg_min(upper(m) || ' ' || y, seq) AS month FROM hits WHERE m <> '' GROUP BY doc_id),
    scan AS (SELECT doc_id, regexp_replace(lower(content), '[^a-z0-9]', '', 'g') AS t FROM texts)
    SELECT s.doc_id, coalesce(b.month, (SELECT arg_min(upper(token), pos) FROM {values(list(enumerate(_TOKENS)), 'k(pos, token)')}
                                       WHERE contains(s.t, token))) AS Commission_Month
    FROM scan s LEFT JOIN best b USING (doc_id)""")
def _(i):
    texts = i.fixture("texts").select("doc_id", "content")
    return texts.select("doc_id", content.commission_month_of(F.split("content", "\n"), F.col("content"), 2026).alias("Commission_Month"))


@query("w5_look_ahead", uses="texts", sql=r"""
    WITH paras AS (SELECT doc_id, unnest(string_split(content, chr(10))) AS piece,
                          generate_subscripts(string_split(content, chr(10)), 1) - 1 AS seq FROM texts)
    SELECT doc_id, seq, ahead FROM (SELECT doc_id, seq, string_agg(piece, ' ') OVER (PARTITION BY doc_id ORDER BY seq
           ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING) AS ahead, piece FROM paras) AS q WHERE contains(piece, 'ank')""")
def _(i):
    paras = i.fixture("texts").select("doc_id", F.posexplode(F.split("content", "\n")).alias("seq", "content"))
    return content.look_ahead(paras, F.col("content").contains("ank"), 5).select(
        "doc_id", F.col("start").alias("seq"), F.col("text").alias("ahead"))


STATES_SQL = values(list(rules.STATE_NAMES.items()), "s(code, state)")


@query("x21_place_of_supply", uses="texts", sql=f"""
    SELECT doc_id, coalesce({clean_sql(found('place_of_supply'))},
           (SELECT state FROM {STATES_SQL} WHERE length(Company_GSTIN) = 15 AND code = substr(Company_GSTIN, 1, 2))) AS place FROM texts""")
def _(i):
    return i.fixture("texts").select(
        "doc_id", content.place_of_supply(F.col("content"), F.col("Company_GSTIN")).alias("place"))


@query("j6_state_of_gstin", uses="ids", sql=f"""
    SELECT k, state FROM ids LEFT JOIN {STATES_SQL} ON length(gstin) = 15 AND code = substr(gstin, 1, 2)""")
def _(i):
    return i.fixture("ids").select("k", content.state_name(F.col("gstin")).alias("state"))


_CODES = "|".join(rules.LOAN_CODES)


@query("x22_loan_type", uses="texts", sql=rf"""
    SELECT doc_id, coalesce(CASE WHEN upper(trim(product_code)) IN {tuple(rules.LOAN_CODES)} THEN upper(trim(product_code)) END,
           CASE WHEN regexp_matches(content, '(?i)(product|disbursal|annexure|payout)')
                THEN list_min(regexp_extract_all(content, '\b({_CODES})\b')) END,
           nullif(upper(regexp_extract(Invoice_No, '(?i)/({_CODES})/', 1)), '')) AS loan_type FROM texts""")
def _(i):
    return i.fixture("texts").select(
        "doc_id", content.loan_type(F.col("product_code"), F.col("content"), F.col("Invoice_No")).alias("loan_type"))


@query("x23_annexure_invoice_no", uses="texts", sql=f"""
    SELECT doc_id, coalesce({found('annexure_number')}, {found('sales_invoice_number')}) AS invoice_no FROM texts""")
def _(i):
    return i.fixture("texts").select("doc_id", content.annexure_invoice_no(F.col("content")).alias("invoice_no"))


@query("x24_content_fallbacks", uses="texts", sql=rf"""
    SELECT doc_id, CASE WHEN raw = '10-Aug-2026' THEN '10--2026' WHEN raw = '10-08-2026' THEN '2026-08-10' ELSE raw END AS due_date,
           CAST(try_cast(replace({found('amount_due')}, ',', '') AS DECIMAL(18,2)) * 100 AS BIGINT) AS amount_due,
           {found('po_number')} AS po_number, {found('customer_id')} AS customer_id,
           CASE WHEN length({clean_sql(found('amount_in_words', group=0))}) > 5 THEN {clean_sql(found('amount_in_words', group=0))} END AS words
    FROM (SELECT *, {found('due_date')} AS raw FROM texts) AS q""")
def _(i):
    c = F.col("content")
    return i.fixture("texts").select(
        "doc_id", content.due_date(c).alias("due_date"), paise(content.amount_due(c)).alias("amount_due"),
        content.po_number(c).alias("po_number"), content.customer_id(c).alias("customer_id"),
        content.amount_in_words(c).alias("words"))


@query("x25_beneficiary", uses="texts", sql=f"""
    SELECT doc_id, coalesce(
        CASE WHEN upper(trim(named)) <> upper(trim(Vendor_Name)) THEN trim(named) END, payble_to,
        CASE WHEN upper(trim(Vendor_Name_2)) <> upper(trim(Vendor_Name)) THEN trim(Vendor_Name_2) END,
        CASE WHEN upper(pay) <> upper(trim(Vendor_Name)) THEN pay END) AS payee
    FROM (SELECT *, {clean_sql(found('payable_to'))} AS pay FROM texts) AS q""")
def _(i):
    return i.fixture("texts").withColumn("in_text", content.payable_to_in_text(F.col("content"))).select(
        "doc_id", content.beneficiary(
            F.col("named"), F.col("payble_to"), F.col("Vendor_Name_2"), F.col("in_text"), F.col("Vendor_Name"),
            F.lit(None).cast("string")).alias("payee"))


def _far(content: str) -> str:
    return f"CASE WHEN doc_id % 3 = 0 THEN 'Banking Details ' || repeat('no number ', 300) || 'PAN: ABCDE1234F' ELSE {content} END"


@query("x28_banking_block_pan", uses="texts", sql=rf"""
    SELECT doc_id, coalesce(nullif(upper(regexp_extract(section, '{rx('labelled_pan')}', 1)), ''),
                            nullif(regexp_extract(upper(section), '\b({rules.PAN_PATTERN})\b', 1), '')) AS pan
    FROM (SELECT doc_id, coalesce(nullif(regexp_extract(content, '(?is)Banking\s+Details.*'), ''), content) AS section
          FROM (SELECT doc_id, {_far('content')} AS content FROM texts) AS t) AS q""")
def _(i):
    # every third text names its PAN far behind the heading
    return i.fixture("texts").selectExpr("doc_id", _far("content") + " AS content").select("doc_id", content.pan_in_banking_block(F.col("content")).alias("pan"))


@query("x35_aadhaar_fallbacks", uses="texts", sql=rf"""
    SELECT doc_id, CASE WHEN contains(lower(c), 'x') THEN replace(c, 'x', 'X') WHEN length(d) = 12 THEN 'xxxx xxxx ' || right(d, 4) END AS masked,
           CASE WHEN contains(lower(c), 'x') THEN replace({found('twelve_digits')}, ' ', '') WHEN length(d) = 12 THEN d END AS unmasked,
           {found('enrolment_no')} AS enrolment, {found('virtual_id')} AS vid, {found('birth_date')} AS dob,
           upper({found('guardian')}) || ': ' || trim({found('guardian', group=2)}, E' \n') AS guardian, {found('pin_code')} AS pincode
    FROM (SELECT *, regexp_replace(c, '[^0-9]', '', 'g') AS d FROM (
          SELECT *, regexp_replace(trim(coalesce({found('your_aadhaar_no')}, {found('aadhaar_no')}), E' \n'), '\s+', ' ', 'g') AS c FROM texts) AS a) AS b""")
def _(i):
    c, none = F.col("content"), F.lit(None).cast("string")
    numbers = content.aadhaar_fallbacks(c, none, none)
    return i.fixture("texts").select(
        "doc_id", numbers["aadhaar_number_masked"].alias("masked"), numbers["aadhaar_number_unmasked"].alias("unmasked"),
        content.enrolment_no(c).alias("enrolment"), content.virtual_id(c).alias("vid"),
        content.birth_date(c).alias("dob"), content.guardian(c).alias("guardian"), content.pin_code(c).alias("pincode"))


@query("x36_pan_fallbacks", uses="texts", sql=rf"""
    SELECT doc_id, nullif(regexp_extract(upper(content), '\b({rules.PAN_PATTERN})\b', 1), '') AS pan_number,
           CASE WHEN doc_id % 2 = 0 THEN '05/06/2007' ELSE {found('slash_date')} END AS date_of_birth FROM texts""")
def _(i):
    c = F.col("content")
    known = F.when(F.col("doc_id") % 2 == 0, "05/06/2007").otherwise("")
    return i.fixture("texts").select(
        "doc_id", content.pan_in_text(c).alias("pan_number"),
        F.nullif(content.or_else(known, content.slash_date_in_text(c)), F.lit("")).alias("date_of_birth"))


@query("x37_agreement_fallbacks", uses="texts", sql=rf"""
    SELECT doc_id, nullif(regexp_extract(upper(content), '\b({rules.PAN_PATTERN})\b', 1), '') AS company_pan,
           nullif(regexp_extract(upper(content), '\b({rules.PAN_PATTERN})\b', 1), '') AS provider_pan,
           nullif(regexp_extract(upper(content), '{rx('agreement_gstin')}', 1), '') AS gstin,
           nullif(regexp_extract(upper(content), '\b({rules.IFSC_PATTERN})\b', 1), '') AS ifsc,
           nullif(regexp_extract(upper(content), '{rx('cin')}', 1), '') AS cin,
           CASE WHEN {found('any_date')} IS NULL THEN 0 ELSE 1 END AS n_dates, {found('any_date')} AS first_date,
           CASE WHEN {found('stamp_duty')} IS NULL THEN 0 ELSE 1 END AS n_values, trim({found('stamp_duty')}) AS stamp_duty FROM texts""")
def _(i):
    c = F.col("content")
    no_dates = F.array().cast("array<struct<date_type:string,date_value:string,date_text_original:string>>")
    no_values = F.array().cast("array<struct<amount_text:string,amount_type:string,currency:string>>")
    df = i.fixture("texts").withColumns({
        "dates": content.with_first_date(no_dates, c), "money": content.with_stamp_duty(no_values, c)})
    return df.select(
        "doc_id", content.pan_in_text(c).alias("company_pan"), content.pan_in_text(c).alias("provider_pan"),
        content.gstin_in_text(c).alias("gstin"), content.ifsc_in_text(c).alias("ifsc"), content.cin_in_text(c).alias("cin"),
        F.size("dates").alias("n_dates"), F.get("dates", F.lit(0))["date_text_original"].alias("first_date"),
        F.size("money").alias("n_values"), F.get("money", F.lit(0))["amount_text"].alias("stamp_duty"))


# --- pages -----------------------------------------------------------------------------------

@query("x34_page_text_combine", uses="page_texts", sql="""
    SELECT doc_id, page_no, CASE WHEN page_no = min(page_no) OVER (PARTITION BY doc_id) THEN '' ELSE chr(10) || chr(10) END || coalesce(text, '') AS text
    FROM page_texts""")
def _(i):
    return pages.combine_texts(i.fixture("page_texts"))


@query("x34_page_break_marker", uses="page_texts", sql="""
    SELECT doc_id, count(*) AS pages, length(string_agg(text, chr(10) || '----- PAGE BREAK -----' || chr(10) ORDER BY page_no)) AS n
    FROM page_texts GROUP BY doc_id""")
def _(i):
    p = i.fixture("page_texts")
    parts = pages.combine_texts(p, "\n----- PAGE BREAK -----\n")
    return parts.groupBy("doc_id").agg(F.sum(F.length("text")).alias("n")).join(pages.page_counts(p), "doc_id")


@query("k6_text_lines", sql="""
    SELECT doc_id, line_no, text FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS text,
           generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line_no, len(string_split(text, chr(10))) AS n FROM documents) AS q
    WHERE NOT (text = '' AND line_no = n - 1)""")
def _(i):
    return i.table("documents").select("doc_id", F.posexplode(reports.split_lines(F.col("text"))).alias("line_no", "text"))


# --- model answers ------------------------------------------------------------------------------

@query("x8_answer_fences", uses="answers", sql="""
    SELECT doc_id, CASE WHEN contains(answer, '```json') THEN trim(string_split(string_split(answer, '```json')[2], '```')[1], E' \\n')
                        WHEN contains(answer, '```') THEN trim(string_split(string_split(answer, '```')[2], '```')[1], E' \\n')
                        ELSE answer END AS body FROM answers""")
def _(i):
    return i.fixture("answers").select("doc_id", content.fenced_answer(F.col("answer")).alias("body"))


@query("x9_answer_json", sql="""
    SELECT o_orderkey AS doc_id, CASE WHEN o_orderkey % 5 <> 3 THEN 'INV-' || o_orderkey END AS invoice_number,
           CASE WHEN o_orderkey % 5 <> 3 THEN CAST(round(o_totalprice * 100) AS BIGINT) END AS total,
           CASE WHEN o_orderkey % 5 <> 3 THEN o_orderstatus END AS status FROM orders""")
def _(i):
    body = F.try_parse_json(content.answer_json(F.col("answer")))
    parsed = i.fixture("answers").select("doc_id", body.alias("v"))
    return parsed.select(
        "doc_id", F.try_variant_get("v", "$.invoice_number", "string").alias("invoice_number"),
        paise(F.try_variant_get("v", "$.total", "decimal(18,2)")).alias("total"),
        F.try_variant_get("v", "$.nested.status", "string").alias("status"))


# --- typed agreement records -----------------------------------------------------------------------

FIXTURES["agreements"] = """
SELECT o_orderkey AS doc_id,
       '{{"document_type":"x","unknown":1,"service_provider":{{"pan":" abcde1234f ","aadhaar":"1234 5678 9012","name":"P' || CAST(o_custkey AS STRING)
       || '"}},"payment_terms":{{"ifsc":"' || CASE WHEN o_orderkey % 2 = 0 THEN 'hdfc0001234' ELSE 'bad' END || '","invoice_required":"yes"}},"stamp":{{"stamp_present":true}},'
       || '"dates":[{{"date_type":"agreement_date","date_value":"01/02/2024","page_number":3}},{{"date_type":"end_date","date_value":"2024-05-01"}}],'
       || '"monetary_values":[{{"amount":"INR ' || CAST(o_orderkey AS STRING) || '.50","amount_type":"FIXED_FEE"}},{{"amount":-5,"amount_type":"TAX","currency":"USD"}}],'
       || '"percentage_fees":[{{"percentage_value":"2.5 %","percentage_of":"loan"}}],"page_count":4}}' AS json
FROM {orders}"""


@query("v31_agreement_records", uses="agreements", sql="""
    SELECT doc_id, 'ABCDE1234F' AS provider_pan, '123456789012' AS provider_aadhaar, CASE WHEN doc_id % 2 = 0 THEN 'HDFC0001234' END AS ifsc,
           TRUE AS invoice_required, TRUE AS stamp_present, CAST(NULL AS BOOLEAN) AS notary_present, 'INR' AS stamp_currency,
           4 AS page_count, 2 AS n_dates, 0 AS n_schedules FROM agreements""")
def _(i):
    a = schemas.agreement_documents(i.fixture("agreements"), "json")
    return a.select(
        "doc_id", F.try_element_at("service_provider", F.lit("pan")).alias("provider_pan"),
        F.try_element_at("service_provider", F.lit("aadhaar")).alias("provider_aadhaar"),
        F.try_element_at("payment_terms", F.lit("ifsc")).alias("ifsc"),
        F.col("`payment_terms.invoice_required`").alias("invoice_required"),
        F.col("`stamp.stamp_present`").alias("stamp_present"), F.col("`stamp.notary_present`").alias("notary_present"),
        F.col("`stamp.stamp_currency`").alias("stamp_currency"), "page_count", F.size("dates").alias("n_dates"),
        F.size("schedules").alias("n_schedules"))


@query("g9_agreement_lists", uses="agreements", sql="""
    SELECT doc_id, 'date' AS list, 0 AS seq, 'agreement_date' AS kind, '01/02/2024' AS value, 3 AS number FROM agreements
    UNION ALL SELECT doc_id, 'date', 1, 'end_date', NULL, NULL FROM agreements
    UNION ALL SELECT doc_id, 'money', 0, 'FIXED_FEE', 'INR', doc_id + 0.5 FROM agreements
    UNION ALL SELECT doc_id, 'money', 1, 'TAX', 'USD', -5 FROM agreements
    UNION ALL SELECT doc_id, 'fee', 0, 'loan', NULL, 2.5 FROM agreements""".replace("3 AS number", "3::DOUBLE AS number"))
def _(i):
    a = schemas.agreement_documents(i.fixture("agreements"), "json")
    row = lambda section, kind, value, number, name: schemas.entries(a, section).select(
        "doc_id", F.lit(name).alias("list"), "seq", F.col(kind).alias("kind"), value.alias("value"),
        F.col(number).cast("double").alias("number"))
    none = F.lit(None).cast("string")
    return row("dates", "date_type", F.col("date_value"), "page_number", "date").unionByName(
        row("monetary_values", "amount_type", F.col("currency"), "amount", "money")
    ).unionByName(row("percentage_fees", "percentage_of", none, "percentage_value", "fee"))


# --- the identity run ------------------------------------------------------------------------------

_PAGES_SQL = """SELECT o_orderkey AS doc_id, CAST(n + 1 AS INT) AS page_no, CASE n WHEN 0 THEN 'front of ' || CAST(o_custkey AS STRING)
    ELSE 'Permanent account ABCDE1234' || chr(CAST(65 + o_orderkey % 26 AS INT)) || ' born 01/02/1990, Enrolment No: 12/34' END AS text
    FROM (SELECT *, @explode(@array(0, 1)) AS n FROM {orders}) AS t"""
_ANSWERS_SQL = """SELECT o_orderkey AS doc_id, CASE o_orderkey % 3 WHEN 0 THEN '{{"name":"N ' || CAST(o_orderkey AS STRING) || '","pan_number":"zzzzz9999z"}}'
    WHEN 1 THEN 'no answer' ELSE NULL END AS answer FROM {orders}"""


@query("f2_extractors_by_type", sql="""
    SELECT doc_id, field_name, value FROM (
        SELECT o_orderkey AS doc_id, unnest(['name', 'pan_number', 'date_of_birth']) AS field_name,
               unnest([CASE WHEN o_orderkey % 3 = 0 THEN 'N ' || o_orderkey END,
                       CASE WHEN o_orderkey % 3 = 0 THEN 'ZZZZZ9999Z' ELSE 'ABCDE1234' || chr(CAST(65 + o_orderkey % 26 AS INT)) END, '01/02/1990']) AS value
        FROM orders WHERE o_orderkey % 4 = 2
        UNION ALL SELECT o_orderkey, unnest(['name', 'enrolment_number']), unnest([CASE WHEN o_orderkey % 3 = 0 THEN 'N ' || o_orderkey END, '12/34'])
        FROM orders WHERE o_orderkey % 4 = 3
        UNION ALL SELECT o_orderkey, unnest(['company.pan', 'dates']),
               unnest(['ABCDE1234' || chr(CAST(65 + o_orderkey % 26 AS INT)), '[{"date_type":"agreement_date","date_text_original":"01/02/1990"}]'])
        FROM orders WHERE o_orderkey % 4 = 0
        UNION ALL SELECT o_orderkey, 'priority', o_orderkey || '' FROM orders WHERE o_orderkey % 4 = 1 AND o_custkey % 2 = 0
        UNION ALL SELECT o_orderkey, 'error', 'Unsupported document type: memo' FROM orders WHERE o_orderkey % 4 = 1 AND o_custkey % 2 = 1) AS q""")
def _(i):
    docs = i.sql("""SELECT o_orderkey AS doc_id, CASE o_orderkey % 4 WHEN 0 THEN 'agreement' WHEN 2 THEN 'PAN' WHEN 3 THEN 'aadhaar'
        ELSE CASE WHEN o_custkey % 2 = 0 THEN 'receipt' ELSE 'memo' END END AS document_type FROM {orders}""")
    receipts = lambda rows: identity.as_fields(rows, {"priority": F.col("doc_id")})
    fields, errors = identity.process(docs, i.sql(_PAGES_SQL), i.sql(_ANSWERS_SQL), identity.STANDARD.register("Receipt", receipts))
    shown = ["name", "pan_number", "date_of_birth", "enrolment_number", "company.pan", "dates", "priority"]
    kind = docs.select(F.col("doc_id").alias("k"), F.lower("document_type").alias("t"))
    rows = fields.join(kind, F.col("k") == F.col("doc_id")).where(
        F.col("field_name").isin(shown) & ~((F.col("t") == "aadhaar") & (F.col("field_name") == "date_of_birth")))
    return rows.select("doc_id", "field_name", F.col("field_value").alias("value")).unionByName(
        errors.select("doc_id", F.lit("error").alias("field_name"), F.col("error").alias("value")))


# --- injected model -----------------------------------------------------------------------------------

_WORDS = pattern_model({"word": "[A-Z][a-z]+"})


_MODEL_SQL = """
    SELECT page_id AS doc_id, CASE WHEN page_id % 7 = 0 THEN NULL ELSE nullif(regexp_extract(url, '[A-Z][a-z]+'), '') END AS word,
           CASE WHEN page_id % 7 = 0 THEN 'empty text' END AS error FROM pages"""


def _modelled(i):
    texts = i.table("pages").select(
        F.col("page_id").alias("doc_id"), F.when(F.col("page_id") % 7 == 0, "").otherwise(F.col("url")).alias("text"))
    return map_model(texts, _WORDS, "doc_id long, word string, error string")


@query("f3_text_model", sql="""
    SELECT doc_id, nullif(regexp_extract(content, '[A-Z][a-z]+'), '') AS word, CAST(NULL AS VARCHAR) AS error FROM texts""", uses="texts")
def _(i):
    return pattern_fields(i.fixture("texts").select("doc_id", F.col("content").alias("text")), {"word": "[A-Z][a-z]+"})


@query("f4_batch_with_failures", sql=_MODEL_SQL)
def _(i):
    return _modelled(i)


@query("f5_ok_and_failed_rows", sql=f"""
    SELECT CASE WHEN error IS NULL THEN 'ok' ELSE 'failed' END AS outcome, count(*) AS n FROM ({_MODEL_SQL}) AS m GROUP BY 1""")
def _(i):
    return _modelled(i).groupBy(
        F.when(F.col("error").isNull(), "ok").otherwise("failed").alias("outcome")).agg(F.count(F.lit(1)).alias("n"))
