"""Typed schemas: identity cards and agreements.

JSON is read with an explicit schema, which drops unknown keys; missing keys are
null or take the section's default.  Agreements have many sections whose fields
are all plain text; those are read as a map of the section's own keys, optionally
limited to a field list given by the caller.  Only fields that are not plain text,
have a default or a check are named here.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldloom.functions import checks

# --------------------------------------------------------------------------
# Fixed values.
# --------------------------------------------------------------------------
AADHAAR_FIELDS = [
    "name", "guardian_name", "date_of_birth", "gender", "aadhaar_number_masked",
    "aadhaar_number_unmasked", "vid", "address", "pincode", "enrolment_number",
    "barcode_qr_code", "barcode_qr_raw_data", "photo_path",
]
PAN_FIELDS = [
    "name", "father_name", "date_of_birth", "pan_number", "signature_present",
    "barcode_qr_code", "barcode_qr_raw_data", "photo_path",
]
TEXT_SECTIONS = [
    "document_info", "company", "service_provider", "term_and_renewal", "services", "referrals",
    "loan_information", "payment_terms", "taxes", "obligations_rights_conditions",
    "representations_warranties", "confidentiality", "data_privacy", "intellectual_property",
    "audit", "compliance", "indemnification", "liability", "insurance", "force_majeure",
    "termination", "notices", "assignment_subcontracting", "dispute_resolution", "governing_law",
    "miscellaneous", "code_of_conduct", "stamp", "signatures", "document_metadata",
]
LIST_SECTIONS = {
    "party_representatives": ["role", "name", "designation", "contact"],
    "dates": [
        "date_type", "date_value", "date_text_original", "related_clause", "event", "page_number",
        "clause_number", "date_confidence",
    ],
    "monetary_values": [
        "amount", "currency", "amount_text", "amount_type", "payment_direction", "frequency", "basis",
        "tax_treatment", "page", "clause",
    ],
    "percentage_fees": [
        "fee_percentage", "percentage_value", "percentage_basis", "percentage_of",
        "fee_calculation_method", "condition",
    ],
    "schedules": ["schedule_type", "schedule_number", "schedule_title", "schedule_content"],
    "clause_metadata": ["clause_number", "clause_title", "page_number", "extraction_evidence"],
}
FLAT_FIELDS = ["barcode_qr_code", "barcode_qr_raw_data", "photo_path", "page_count"]
YES_NO_FIELDS = {
    "term_and_renewal": ["automatic_renewal"],
    "payment_terms": ["invoice_required"],
    "taxes": ["tax_applicable", "gst_applicable", "tds_applicable"],
    "indemnification": ["indemnity_exists"],
    "liability": ["unlimited_liability"],
    "insurance": ["insurance_required"],
    "force_majeure": ["force_majeure_applicable"],
    "termination": ["termination_allowed"],
    "notices": ["notice_required"],
    "assignment_subcontracting": ["assignment_allowed", "prior_consent_required", "subcontracting_allowed"],
    "governing_law": ["exclusive_jurisdiction"],
    "stamp": ["stamp_present", "notary_present"],
    "signatures": [
        "witness_1_signature", "witness_2_signature", "rubber_stamp_present", "company_stamp_present",
        "service_provider_stamp_present",
    ],
    "code_of_conduct": ["misrepresentation_prohibited", "false_promise_prohibited"],
}
CURRENCY_FIELDS = {
    "loan_information": "loan_currency",
    "liability": "liability_cap_currency",
    "insurance": "coverage_currency",
    "stamp": "stamp_currency",
}
DEFAULT_CURRENCY = "INR"
# --------------------------------------------------------------------------
# End of fixed values.
# --------------------------------------------------------------------------


def _text_struct(names: list[str]) -> str:
    return "struct<" + ",".join(f"{n}:string" for n in names) + ">"


def _is_number(json: Column, path: str) -> Column:
    """True where the JSON holds a number, not a text, at ``path``."""
    kind = F.schema_of_variant(F.try_variant_get(F.try_parse_json(json), path, "variant"))
    return F.coalesce(kind.rlike("^(BIGINT|INT|DECIMAL|DOUBLE|FLOAT)"), F.lit(False))


def aadhaar_document(json: Column) -> Column:
    """Aadhaar record; malformed number, PIN code and birth date become null."""
    d = F.from_json(json, _text_struct(AADHAAR_FIELDS))
    checked = {
        "aadhaar_number_unmasked": checks.twelve_digits,
        "pincode": checks.six_digits,
        "date_of_birth": checks.slash_date,
    }
    return F.struct(
        F.lit("aadhaar").alias("document_type"),
        *[checked.get(n, lambda c: c)(d[n]).alias(n) for n in AADHAAR_FIELDS],
    )


def pan_document(json: Column) -> Column:
    """PAN record; the signature flag is a lenient boolean."""
    d = F.from_json(json, _text_struct(PAN_FIELDS))
    checked = {
        "pan_number": checks.strict_pan,
        "date_of_birth": checks.slash_date,
        "signature_present": lambda c: checks.lenient_bool(c, _is_number(json, "$.signature_present")),
    }
    return F.struct(
        F.lit("pan").alias("document_type"),
        *[checked.get(n, lambda c: c)(d[n]).alias(n) for n in PAN_FIELDS],
    )


NUMBER_FIELDS = ["amount", "percentage_value"]


def _entry_struct(names: list[str]) -> str:
    """List entries are text but for numbers, which may come as number or text."""
    return "struct<" + ",".join(f"{n}:{'variant' if n in NUMBER_FIELDS else 'string'}" for n in names) + ">"


def number_value(v: Column) -> Column:
    """A JSON number as it is, a text by its digits and dots."""
    kind = F.schema_of_variant(v)
    return F.when(kind == "STRING", checks.loose_number(F.try_variant_get(v, "$", "string"))).otherwise(
        F.try_variant_get(v, "$", "double")
    )


def agreement_type() -> str:
    """Raw agreement type: text sections as maps, list sections as structs."""
    parts = [f"{s}:map<string,string>" for s in TEXT_SECTIONS]
    parts += [f"{s}:array<{_entry_struct(names)}>" for s, names in LIST_SECTIONS.items()]
    parts += [f"{n}:string" for n in FLAT_FIELDS]
    return f"struct<{','.join(parts)}>"


def _section_value(d: Column, section: str, name: str) -> Column:
    return F.try_element_at(d[section], F.lit(name))


def _only_keys(values: Column, names: list[str]) -> Column:
    return F.map_filter(values, lambda k, v: k.isin(names))


def _checked_key(values: Column, name: str, check) -> Column:
    return F.transform_values(values, lambda k, v: F.when(k == name, check(v)).otherwise(v))


def _typed_entries(items: Column, names: list[str], typed: dict) -> Column:
    return F.transform(
        items, lambda x: F.struct(*[typed.get(n, lambda c: c)(x[n]).alias(n) for n in names])
    )


def agreement_sections(json: Column, text_fields: dict[str, list[str]] | None = None) -> dict[str, Column]:
    """Sections of an agreement record as columns.

    Text sections stay maps (limited to ``text_fields[section]`` where given);
    identifiers in them are checked in place, list entries are typed.
    """
    d = F.from_json(json, agreement_type())
    out: dict[str, Column] = {"document_type": F.lit("agreement")}
    fixed = {
        ("service_provider", "pan"): checks.strict_pan,
        ("service_provider", "aadhaar"): checks.aadhaar_or_masked,
        ("payment_terms", "ifsc"): checks.strict_ifsc,
    }
    for section in TEXT_SECTIONS:
        values = F.coalesce(d[section], F.from_json(F.lit("{}"), "map<string,string>"))
        allowed = (text_fields or {}).get(section)
        if allowed:
            values = _only_keys(values, allowed)
        for (owner, name), check in fixed.items():
            if owner == section:
                values = _checked_key(values, name, check)
        out[section] = values
    for section, names in YES_NO_FIELDS.items():
        for name in names:
            out[f"{section}.{name}"] = checks.lenient_bool(
                _section_value(d, section, name), _is_number(json, f"$.{section}.{name}"))
    for section, name in CURRENCY_FIELDS.items():
        out[f"{section}.{name}"] = F.coalesce(_section_value(d, section, name), F.lit(DEFAULT_CURRENCY))
    typed = {
        ("dates", "date_value"): checks.slash_date,
        ("dates", "page_number"): lambda c: c.try_cast("int"),
        ("monetary_values", "amount"): number_value,
        ("monetary_values", "currency"): lambda c: F.coalesce(c, F.lit(DEFAULT_CURRENCY)),
        ("percentage_fees", "percentage_value"): number_value,
        ("clause_metadata", "page_number"): lambda c: c.try_cast("int"),
    }
    for section, names in LIST_SECTIONS.items():
        items = F.coalesce(d[section], F.array().cast(f"array<{_entry_struct(names)}>"))
        out[section] = _typed_entries(items, names, {n: f for (s, n), f in typed.items() if s == section})
    for name in FLAT_FIELDS:
        out[name] = d[name].try_cast("int") if name == "page_count" else d[name]
    return out


def agreement_documents(df: DataFrame, json_column: str, text_fields: dict[str, list[str]] | None = None) -> DataFrame:
    """Agreement rows; derived scalar fields are named ``section.field``."""
    return df.withColumns(agreement_sections(F.col(json_column), text_fields))


def entries(agreements: DataFrame, section: str) -> DataFrame:
    """Entries of a list section (dates, amounts, fees) as rows in list order."""
    return agreements.select("doc_id", F.posexplode(section).alias("seq", "entry")).select("doc_id", "seq", "entry.*")
