"""Cleaners, validators, masks and formats over rendered identifiers."""

from __future__ import annotations

from pyspark.sql import functions as F

from fieldloom import rules
from fieldloom.functions import checks, dates, text
from fieldloom.operators import schemas, validate
from workload.base import query

PAISE = "CAST(round({c} * 100) AS BIGINT)"


def paise(c):
    return (c * 100).cast("bigint")


@query("v1_sanitize", uses="fields", sql="""
    SELECT doc_id, seq, field_name,
           CASE value_type WHEN 'str' THEN trim(field_value)
                WHEN 'list' THEN CAST(to_json(list_transform(from_json(CAST(field_value AS JSON), '["VARCHAR"]'),
                                                            lambda x: trim(x))) AS VARCHAR)
                ELSE field_value END AS field_value
    FROM fields""")
def _(i):
    return validate.sanitize(i.fixture("fields")).select("doc_id", "seq", "field_name", "field_value")


CHECK_SQL = {
    "pan": "coalesce(regexp_full_match(upper(replace({c}, ' ', '')), '[A-Z]{{5}}[0-9]{{4}}[A-Z]'), FALSE)",
    "aadhaar": "coalesce(regexp_full_match(replace(replace({c}, ' ', ''), '-', ''), '[0-9]{{12}}'), FALSE)",
    "email": "coalesce(regexp_full_match({c}, '[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\\.[a-zA-Z]{{2,}}'), FALSE)",
    "phone": ("coalesce(regexp_full_match(regexp_replace(regexp_replace({c}, '[ ()-]', '', 'g'), '^\\+91', ''),"
              " '[0-9]{{10,15}}'), FALSE)"),
    "date": ("(try_strptime({c}, ['%Y-%m-%d', '%d-%m-%Y', '%Y/%m/%d', '%d/%m/%Y', '%m/%d/%Y', '%d %B %Y',"
             " '%B %d, %Y']) IS NOT NULL)"),
    "amount": ("coalesce(try_cast(replace(trim(replace(regexp_replace({c}, '[,$€£₹]', '', 'g'), 'INR', '')), '_', '')"
               " AS DOUBLE) >= 0 AND NOT isnan(try_cast(replace(trim(replace(regexp_replace({c}, '[,$€£₹]', '', 'g'),"
               " 'INR', '')), '_', '') AS DOUBLE)), FALSE)"),
}


def check_sql(kind, column):
    return CHECK_SQL[kind].format(c=column)


def _single(name, kind, column, check):
    @query(name, uses="ids", sql=f"SELECT k, {column}, {check_sql(kind, column)} AS ok FROM ids")
    def _(i):
        return i.fixture("ids").select("k", column, check(F.col(column)).alias("ok"))


_single("v6_pan_check", "pan", "pan", checks.is_pan_number)
_single("v7_aadhaar_check", "aadhaar", "aadhaar", checks.is_aadhaar_number)
_single("v8_email_check", "email", "email", checks.is_email)
_single("v9_phone_check", "phone", "phone", checks.is_phone)
_single("v10_date_check", "date", "date_text", checks.is_date)
_single("v11_amount_check", "amount", "amount_text", checks.is_amount_text)

TRUTHY_SQL = """CASE WHEN field_value IS NULL OR value_type = 'NoneType' THEN FALSE
    WHEN value_type = 'bool' THEN lower(field_value) = 'true'
    WHEN value_type IN ('int', 'float') THEN CAST(field_value AS DOUBLE) <> 0
    WHEN value_type IN ('list', 'dict') THEN field_value NOT IN ('[]', '{}')
    ELSE field_value <> '' END"""

OK_SQL = f"""CASE WHEN NOT ({TRUTHY_SQL}) THEN TRUE
    WHEN lower(field_name) LIKE '%pan%' AND lower(field_name) LIKE '%number%' THEN value_type = 'str' AND {check_sql('pan', 'field_value')}
    WHEN regexp_matches(lower(field_name), 'aadhaar|uid') THEN value_type = 'str' AND {check_sql('aadhaar', 'field_value')}
    WHEN lower(field_name) LIKE '%email%' THEN value_type = 'str' AND {check_sql('email', 'field_value')}
    WHEN regexp_matches(lower(field_name), 'phone|mobile|contact') THEN value_type = 'str' AND {check_sql('phone', 'field_value')}
    WHEN lower(field_name) LIKE '%date%' AND lower(field_name) NOT LIKE '%birth%' THEN value_type = 'str' AND {check_sql('date', 'field_value')}
    WHEN regexp_matches(lower(field_name), 'amount|price|cost') THEN
         CASE WHEN value_type IN ('int', 'float') THEN CAST(field_value AS DOUBLE) >= 0 WHEN value_type = 'bool' THEN TRUE
              ELSE {check_sql('amount', 'field_value')} END
    ELSE TRUE END"""


@query("v5_field_dispatch", uses="fields", sql=f"""
    SELECT doc_id, seq, field_name, field_value, {TRUTHY_SQL} AS present, {OK_SQL} AS ok FROM fields""")
def _(i):
    return validate.with_checks(i.fixture("fields")).select(
        "doc_id", "seq", "field_name", "field_value", "present", "ok")


@query("v12_present_check", uses="fields", sql="""
    SELECT doc_id, seq, CASE WHEN field_value IS NULL OR value_type = 'NoneType' THEN FALSE
           WHEN value_type = 'str' THEN length(trim(field_value)) > 0
           WHEN value_type IN ('list', 'dict') THEN field_value NOT IN ('[]', '{}') ELSE TRUE END AS present
    FROM fields""")
def _(i):
    return i.fixture("fields").select(
        "doc_id", "seq", checks.is_present(F.col("field_value"), F.col("value_type")).alias("present"))


@query("v14_mask_by_type", uses="fields", sql="""
    SELECT doc_id, seq, field_name,
           CASE WHEN length(field_value) > 0 AND (field_name IN ('password', 'pin', 'ssn', 'credit_card')
                     OR document_type = 'pan' AND field_name IN ('pan_number', 'pan')
                     OR document_type = 'aadhaar' AND field_name IN ('aadhaar_number', 'aadhaar', 'uid'))
                THEN CASE WHEN length(field_value) > 4
                     THEN substr(field_value, 1, 2) || repeat('*', length(field_value) - 4) || right(field_value, 2)
                     ELSE repeat('*', length(field_value)) END
                ELSE field_value END AS field_value
    FROM fields""")
def _(i):
    return i.fixture("fields").select(
        "doc_id", "seq", "field_name",
        text.mask_field(F.col("field_name"), F.col("field_value"), F.col("document_type")).alias("field_value"))


@query("v15_mask_value", uses="ids", sql="""
    SELECT k, CASE WHEN pan IS NULL THEN '' WHEN length(pan) <= 6 THEN repeat('*', length(pan))
                   ELSE left(pan, 3) || repeat('*', length(pan) - 6) || right(pan, 3) END AS masked
    FROM ids""")
def _(i):
    return i.fixture("ids").select("k", text.mask(F.col("pan"), 3).alias("masked"))


@query("v16_truncate", sql="""
    SELECT doc_id, CASE WHEN length(text) <= 80 THEN text ELSE substr(text, 1, 77) || '...' END AS short FROM documents""")
def _(i):
    return i.table("documents").select("doc_id", text.truncate(F.col("text"), 80).alias("short"))


@query("v17_file_name_sanitise", sql="""
    SELECT page_id, regexp_replace(url, '[<>:"/\\\\|?*]', '_', 'g') AS name FROM pages""")
def _(i):
    return i.table("pages").select("page_id", text.safe_file_name(F.col("url")).alias("name"))


@query("v18_file_size", uses="files", sql="""
    SELECT doc_id, length, CASE WHEN length < 1024 THEN printf('%.2f B', CAST(length AS DOUBLE))
        WHEN length < power(1024, 2) THEN printf('%.2f KB', length / 1024.0::DOUBLE)
        WHEN length < power(1024, 3) THEN printf('%.2f MB', length / power(1024.0, 2))
        WHEN length < power(1024, 4) THEN printf('%.2f GB', length / power(1024.0, 3))
        WHEN length < power(1024, 5) THEN printf('%.2f TB', length / power(1024.0, 4))
        ELSE printf('%.2f PB', length / power(1024.0, 5)) END AS size
    FROM files""")
def _(i):
    return i.fixture("files").select("doc_id", "length", text.file_size(F.col("length")).alias("size"))


@query("v19_text_clean", sql=r"""
    SELECT doc_id, nullif(trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(
               trim(text, E' \t\n\r\x0B\x0C'), '[\s\x0B]+', ' ', 'g'), '["“”‘’`´]', '', 'g'), '[•●○◦▪▫]', '', 'g'),
               '[\x00-\x1f\x7f-\x{9f}]', '', 'g'), '([!?.,;:]){2,}', '\1', 'g')), '') AS cleaned
    FROM documents""")
def _(i):
    return i.table("documents").select("doc_id", text.clean(F.col("text")).alias("cleaned"))


@query("v19_numeric_clean", uses="ids", sql=r"""
    SELECT k, nullif(CASE WHEN strpos(n, '.') > 0
           THEN split_part(n, '.', 1) || '.' || replace(substr(n, strpos(n, '.') + 1), '.', '') ELSE n END, '') AS number
    FROM (SELECT k, regexp_replace('Rs. ' || amount_text, '[^0-9.\-]', '', 'g') AS n FROM ids) AS q""")
def _(i):
    return i.fixture("ids").select(
        "k", text.clean(F.concat(F.lit("Rs. "), F.col("amount_text")), "numeric").alias("number"))


@query("v19_date_clean", uses="ids", sql=r"""
    SELECT k, CASE WHEN trim(d) <> '' THEN trim(d) ELSE nullif(d, '') END AS cleaned
    FROM (SELECT k, regexp_replace(trim(date_text), '[^0-9\-/.\s]', '', 'g') AS d FROM ids) AS q""")
def _(i):
    return i.fixture("ids").select("k", text.clean(F.col("date_text"), "date").alias("cleaned"))


@query("v19_bank_account_clean", uses="ids", sql=r"""
    SELECT k, nullif(regexp_replace('A/C ' || phone, '[^0-9\-]', '', 'g'), '') AS account FROM ids""")
def _(i):
    return i.fixture("ids").select(
        "k", text.clean(F.concat(F.lit("A/C "), F.col("phone")), "bank_account").alias("account"))


@query("v20_gstin_clean", uses="ids", sql=r"""
    SELECT k, nullif(regexp_extract(regexp_replace(upper(regexp_replace(trim(raw),
           '(?i)^(gstin|gst)\s*(no\.?)?\s*[:\-\s]?\s*', '')), '[^A-Z0-9]', '', 'g'),
           '[0-9]{2}[A-Z]{5}[0-9]{4}[A-Z][0-9][A-Z][A-Z0-9]'), '') AS gstin
    FROM (SELECT k, CASE WHEN k % 3 = 0 THEN 'GSTIN No.: ' || gstin ELSE gstin END AS raw FROM ids) AS q""")
def _(i):
    raw = F.when(F.col("k") % 3 == 0, F.concat(F.lit("GSTIN No.: "), F.col("gstin"))).otherwise(F.col("gstin"))
    return i.fixture("ids").select("k", text.gstin(raw).alias("gstin"))


def _repair_sql():
    to_digit, to_letter = ("'OILZSBGDQT', '0112586007'", "'0125867', 'OIZSBGT'")
    parts = []
    for pos, rule in enumerate("DDLLLLLDDDDLDZX", start=1):
        ch = f"substr(gstin, {pos}, 1)"
        parts.append({"D": f"translate({ch}, {to_digit})", "L": f"translate({ch}, {to_letter})",
                      "Z": "'Z'", "X": ch}[rule])
    return "CASE WHEN length(gstin) = 15 THEN " + " || ".join(parts) + " ELSE gstin END"


@query("v21_gstin_repair", uses="ids", sql=f"SELECT k, {_repair_sql()} AS repaired FROM ids")
def _(i):
    return i.fixture("ids").select("k", checks.repair_gstin(F.col("gstin")).alias("repaired"))


@query("v22_pan_from_gstin", uses="ids", sql=f"""
    SELECT k, CASE WHEN length(gstin) = 15 AND regexp_full_match(substr(gstin, 3, 10), '{rules.PAN_PATTERN}')
                   THEN substr(gstin, 3, 10) END AS pan FROM ids""")
def _(i):
    return i.fixture("ids").select("k", checks.pan_from_gstin(F.col("gstin")).alias("pan"))


@query("v23_pan_clean", uses="ids", sql=f"""
    SELECT k, nullif(regexp_replace(upper(pan), '[^A-Z0-9]', '', 'g'), '') AS cleaned,
           coalesce(regexp_full_match(regexp_replace(upper(pan), '[^A-Z0-9]', '', 'g'), '{rules.PAN_PATTERN}'), FALSE) AS valid
    FROM ids""")
def _(i):
    return i.fixture("ids").select(
        "k", text.clean(F.col("pan"), "pan").alias("cleaned"), checks.is_pan(F.col("pan")).alias("valid"))


@query("v24_ifsc_clean", uses="ids", sql=f"""
    SELECT k, cleaned, coalesce(regexp_full_match(cleaned, '{rules.IFSC_PATTERN}'), FALSE) AS valid FROM (
        SELECT k, CASE WHEN regexp_matches(t, '{rules.IFSC_PATTERN}') THEN regexp_extract(t, '{rules.IFSC_PATTERN}')
                       ELSE nullif(t, '') END AS cleaned
        FROM (SELECT k, regexp_replace(upper('code ' || ifsc), '[^A-Z0-9]', '', 'g') AS t FROM ids) AS a) AS b""")
def _(i):
    cleaned = text.clean(F.concat(F.lit("code "), F.col("ifsc")), "ifsc")
    return i.fixture("ids").select("k", cleaned.alias("cleaned")).select(
        "*", checks.is_ifsc(F.col("cleaned")).alias("valid"))


@query("v25_ifsc_scan", uses="texts", sql=rf"""
    SELECT doc_id, coalesce(
        nullif(upper(regexp_extract(content, '(?i)(?:IFSC|IFS|RTGS|NEFT)\s*(?:Code)?\s*[:\-]?\s*({rules.IFSC_PATTERN})', 1)), ''),
        nullif(upper(regexp_extract(content, '(?i)({rules.IFSC_PATTERN})\s*(?:IFSC|IFS|RTGS|NEFT)', 1)), ''),
        list_filter(codes, lambda x: list_contains({list(rules.IFSC_BANK_CODES)}, substr(x, 1, 4)))[1], codes[1]) AS ifsc
    FROM (SELECT doc_id, content, regexp_extract_all(upper(content), '\b{rules.IFSC_PATTERN}\b') AS codes FROM texts) AS q""")
def _(i):
    return i.fixture("texts").select("doc_id", checks.find_ifsc(F.col("content")).alias("ifsc"))


@query("v26_date_finder", uses="ids", sql=r"""
    SELECT k, CAST(CAST(coalesce(
        try_strptime(c, '%Y-%m-%d'), try_strptime(c, '%d/%m/%Y'), try_strptime(c, '%m/%d/%Y'), try_strptime(c, '%d-%m-%Y'),
        try_strptime(c, '%m-%d-%Y'), try_strptime(c, '%Y/%m/%d'), try_strptime(c, '%d.%m.%Y'), try_strptime(c, '%Y.%m.%d'),
        try_strptime(c, '%d %b %Y'), try_strptime(c, '%d %B, %Y'), try_strptime(c, '%d %B %Y'), try_strptime(c, '%B %d, %Y'),
        try_strptime(c, '%B %d,%Y')) AS DATE) AS VARCHAR) AS found
    FROM (SELECT k, regexp_extract('dated ' || date_text || '.',
        '\b([0-9]{4}[-/.][0-9]{2}[-/.][0-9]{2}|[0-9]{2}[-/.][0-9]{2}[-/.][0-9]{4}|[0-9]{2}[-/.][0-9]{2}[-/.][0-9]{2}|[0-9]{2}\s+(?:January|February|March|April|May|June|July|August|September|October|November|December),?\s+[0-9]{4}|[0-9]{1,2}\s+(?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)\s+[0-9]{4}|(?:January|February|March|April|May|June|July|August|September|October|November|December)\s+[0-9]{1,2},?\s*[0-9]{4})\b', 1) AS c
        FROM ids) AS q""")
def _(i):
    return i.fixture("ids").select(
        "k", dates.find_date(F.concat(F.lit("dated "), F.col("date_text"), F.lit("."))).alias("found"))


@query("v27_to_money", uses="ids", sql="""
    SELECT k, CAST(try_cast(CASE WHEN amount_text = '1_000' THEN NULL ELSE trim(replace(amount_text, ',', '')) END
                            AS DECIMAL(18,2)) * 100 AS BIGINT) AS paise FROM ids""")
def _(i):
    return i.fixture("ids").select("k", paise(checks.to_money(F.col("amount_text"))).alias("paise"))


@query("v28_lenient_bool", uses="ids", sql=f"""
    SELECT k, flag_text, CASE WHEN lower(trim(flag_text)) IN {tuple(rules.TRUE_WORDS)} THEN TRUE
              WHEN lower(trim(flag_text)) IN {tuple(rules.FALSE_WORDS)} THEN FALSE END AS flag, k % 3 <> 0 AS number_flag FROM ids""")
def _(i):
    number = (F.col("k") % 3).cast("string")
    return i.fixture("ids").select(
        "k", "flag_text", checks.lenient_bool(F.col("flag_text")).alias("flag"), checks.lenient_bool(number, F.lit(True)).alias("number_flag"))


@query("v29_identity_checks", uses="ids", sql=f"""
    SELECT k, CASE WHEN length(regexp_replace(aadhaar, '[^0-9]', '', 'g')) = 12 THEN regexp_replace(aadhaar, '[^0-9]', '', 'g') END AS aadhaar,
           CASE WHEN regexp_full_match(right(phone, 6), '[0-9]{{6}}') THEN right(phone, 6) END AS pincode,
           CASE WHEN regexp_full_match(date_text, '[0-9]{{2}}/[0-9]{{2}}/[0-9]{{4}}') THEN date_text END AS dob,
           CASE WHEN regexp_full_match(replace(upper(trim(pan)), ' ', ''), '{rules.PAN_PATTERN}') THEN replace(upper(trim(pan)), ' ', '') END AS pan
    FROM ids""")
def _(i):
    return i.fixture("ids").select(
        "k", checks.twelve_digits(F.col("aadhaar")).alias("aadhaar"),
        checks.six_digits(F.right(F.col("phone"), F.lit(6))).alias("pincode"),
        checks.slash_date(F.col("date_text")).alias("dob"), checks.strict_pan(F.col("pan")).alias("pan"))


@query("v30_agreement_checks", uses="ids", sql=f"""
    SELECT k, CASE WHEN length(regexp_replace(aadhaar, '[^0-9]', '', 'g')) = 12 THEN regexp_replace(aadhaar, '[^0-9]', '', 'g') ELSE aadhaar END AS aadhaar,
           CASE WHEN regexp_full_match(upper(trim(ifsc)), '{rules.IFSC_PATTERN}') THEN upper(trim(ifsc)) END AS ifsc,
           CASE WHEN regexp_full_match(date_text, '[0-9]{{2}}/[0-9]{{2}}/[0-9]{{4}}') THEN date_text END AS date_value,
           try_cast(nullif(regexp_replace(amount_text, '[^0-9.]', '', 'g'), '') AS DOUBLE) AS amount
    FROM ids""")
def _(i):
    return i.fixture("ids").select(
        "k", checks.aadhaar_or_masked(F.col("aadhaar")).alias("aadhaar"),
        checks.strict_ifsc(F.col("ifsc")).alias("ifsc"), checks.slash_date(F.col("date_text")).alias("date_value"),
        checks.loose_number(F.col("amount_text")).alias("amount"))


_IDENTITY_JSON = """'{"name":"P ' || k || '","pan_number":' || coalesce('"' || pan || '"', 'null') || ',"date_of_birth":"' || date_text
    || '","signature_present":"' || coalesce(flag_text, 'x') || '","aadhaar_number_unmasked":' || coalesce('"' || aadhaar || '"', 'null')
    || ',"pincode":"' || right('000000' || k, 6) || '","extra":1}'"""


def _identity_json():
    c = F.col
    quoted = lambda x: F.coalesce(F.concat(F.lit('"'), x, F.lit('"')), F.lit("null"))
    return F.concat(
        F.lit('{"name":"P '), c("k").cast("string"), F.lit('","pan_number":'), quoted(c("pan")),
        F.lit(',"date_of_birth":"'), c("date_text"), F.lit('","signature_present":"'),
        F.coalesce("flag_text", F.lit("x")), F.lit('","aadhaar_number_unmasked":'), quoted(c("aadhaar")),
        F.lit(',"pincode":"'), F.right(F.concat(F.lit("000000"), c("k").cast("string")), F.lit(6)),
        F.lit('","extra":1}'))


@query("v31_identity_records", uses="ids", sql=f"""
    SELECT k, 'pan' AS pan_type, 'P ' || k AS name,
           CASE WHEN regexp_full_match(replace(upper(trim(pan)), ' ', ''), '{rules.PAN_PATTERN}') THEN replace(upper(trim(pan)), ' ', '') END AS pan_number,
           CASE WHEN regexp_full_match(date_text, '[0-9]{{2}}/[0-9]{{2}}/[0-9]{{4}}') THEN date_text END AS date_of_birth,
           CASE WHEN lower(trim(coalesce(flag_text, 'x'))) IN {tuple(rules.TRUE_WORDS)} THEN TRUE
                WHEN lower(trim(coalesce(flag_text, 'x'))) IN {tuple(rules.FALSE_WORDS)} THEN FALSE END AS signature_present,
           CASE WHEN length(regexp_replace(aadhaar, '[^0-9]', '', 'g')) = 12 THEN regexp_replace(aadhaar, '[^0-9]', '', 'g') END AS aadhaar_number,
           right('000000' || k, 6) AS pincode, CAST(NULL AS VARCHAR) AS address
    FROM ids""")
def _(i):
    df = i.fixture("ids").withColumn("json", _identity_json())
    both = df.withColumns({"p": schemas.pan_document(F.col("json")), "a": schemas.aadhaar_document(F.col("json"))})
    return both.select(
        "k", F.col("p.document_type").alias("pan_type"), "p.name", "p.pan_number", "p.date_of_birth",
        "p.signature_present", F.col("a.aadhaar_number_unmasked").alias("aadhaar_number"), "a.pincode", "a.address")


@query("v31_vocabularies", uses="ids", sql=f"""
    SELECT k, kind, kind IN {tuple(rules.DATE_TYPES)} AS known_date, upper(kind) IN {tuple(rules.MONEY_TYPES)} AS known_money
    FROM (SELECT k, CASE k % 5 WHEN 0 THEN 'agreement_date' WHEN 1 THEN 'stamp_duty' WHEN 2 THEN 'renewal_date'
                                WHEN 3 THEN 'gst' ELSE 'other_date' END AS kind FROM ids) AS q""")
def _(i):
    kind = F.element_at(
        F.array(*[F.lit(x) for x in ("agreement_date", "stamp_duty", "renewal_date", "gst", "other_date")]),
        (F.col("k") % 5 + 1).cast("int"))
    return i.fixture("ids").select("k", kind.alias("kind")).select(
        "k", "kind", F.col("kind").isin(rules.DATE_TYPES).alias("known_date"),
        F.upper("kind").isin(rules.MONEY_TYPES).alias("known_money"))


