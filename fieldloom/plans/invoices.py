"""Invoice plan: analysis JSON per page -> 53-column record and item rows.

Everything a page's JSON holds is computed inside its row, from one parse of the
parts needed.  Shuffles are left for what crosses rows: the page merge and the join
of items with their document's number.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldloom import rules
from fieldloom.functions import checks
from fieldloom.functions.text import clean, keep_letters_digits
from fieldloom.operators import content, pages, tables, tax
from fieldloom.sources import analysis

MONEY = tax.MONEY
COLUMNS = [target for _, target, *_ in rules.INVOICE_FIELDS] + [name for name, *_ in rules.INVOICE_DERIVED]


def blank_columns(known: list[str]) -> dict[str, Column]:
    """Defaults for record columns that are not in ``known``."""
    kinds = {target: MONEY if kind == "numeric" else "string" for _, target, kind, _ in rules.INVOICE_FIELDS}
    defaults = {name: F.lit(None).cast(kind) for name, kind in kinds.items()}
    defaults |= {name: F.lit(value).cast(kind) for name, kind, value in rules.INVOICE_DERIVED}
    return {name: c for name, c in defaults.items() if name not in known}


def complete_record(df: DataFrame) -> DataFrame:
    """Add every missing column with its default; nulls in given columns with a
    default take it too."""
    filled = {
        name: F.coalesce(F.col(name), F.lit(value).cast(kind))
        for name, kind, value in rules.INVOICE_DERIVED if value is not None and name in df.columns
    }
    return df.withColumns({**filled, **blank_columns(df.columns)})


def primary_fields(df: DataFrame, fields: str = "f") -> DataFrame:
    """Add the record columns of the rule table from the typed field struct.

    A tax id that is no GSTIN but a valid PAN goes to the PAN column of its side,
    unless that has a value from an earlier rule.  Picking and cleaning are two
    projections, so that each value is computed once.
    """
    picked = df.withColumns({
        f"_raw_{source}": analysis.pick_field(f"{fields}.{source}")
        for source, *_ in rules.INVOICE_FIELDS
    })
    cleaned = picked.withColumns({
        target: clean(F.col(f"_raw_{source}"), kind) for source, target, kind, _ in rules.INVOICE_FIELDS
    })
    final = {
        target: checks.to_money(F.col(target)) for _, target, kind, _ in rules.INVOICE_FIELDS if kind == "numeric"
    }
    targets = [target for _, target, *_ in rules.INVOICE_FIELDS]
    for source, target, _, _ in rules.INVOICE_FIELDS:
        if source in rules.TAX_ID_PAN_COLUMN:
            column = rules.TAX_ID_PAN_COLUMN[source]
            bare = keep_letters_digits(F.col(f"_raw_{source}"))
            candidate = F.when(F.col(target).isNull() & checks.is_pan(bare), bare)
            final[column] = F.coalesce(F.col(column), candidate) if column in targets else candidate
    return cleaned.withColumns(final).drop(*[f"_raw_{source}" for source, *_ in rules.INVOICE_FIELDS])


def missing_required(fields: str = "f") -> Column:
    """Names of required source fields without a value."""
    wanted = [source for source, _, _, required in rules.INVOICE_FIELDS if required]
    names = F.array(*[F.when(analysis.pick_field(f"{fields}.{s}").isNull(), F.lit(s)) for s in wanted])
    return F.filter(names, lambda n: n.isNotNull())


def parsed_pages(raw: DataFrame) -> DataFrame:
    """Pages ``doc_id, page_no, json`` with the analysis parsed.

    ``doc_id`` becomes the (document, page) key; unreadable pages are left out.
    """
    keyed = raw.withColumn("doc_id", F.struct("doc_id", "page_no"))
    typed = analysis.parse(keyed, parts=("content", "pages", "tables", "documents")).where(F.col("a").isNotNull())
    return typed.withColumns({
        "f": analysis.first_fields(),
        "markdown": analysis.markdown_of(F.col("json"), F.col("a")),
        "paragraphs": analysis.paragraphs_of(F.col("json"), F.col("a")),
    })


def _from_fields(rows: DataFrame, as_of_year: int) -> DataFrame:
    """Rule-table columns, flags, commission month and tax amounts."""
    start = primary_fields(rows).withColumns({
        **content.document_flags(F.col("json")),
        "Commission_Month": content.commission_month_of(F.col("paragraphs"), F.col("markdown"), as_of_year),
        "_tax": tax.tax_from_array(F.col("f.TaxDetails.valueArray")),
        "rate": tax.rate_from_array(F.col("f.TaxDetails.valueArray")),
    })
    with_tax = start.withColumns({k: F.col(f"_tax.{k}") for k in ("CGST", "SGST", "IGST")}).drop("_tax")
    return tax.gst_amounts(complete_record(with_tax))


def _with_text_finds(rows: DataFrame) -> DataFrame:
    """Candidates from the running text, one column each, not yet decided upon."""
    text = F.coalesce("a.content", F.lit(""))
    codes = F.filter(
        F.transform(
            F.col("f.Items.valueArray"),
            lambda i: F.upper(F.trim(analysis.pick_struct(F.try_element_at(i["valueObject"], F.lit("ProductCode"))))),
        ),
        lambda c: c.isin(rules.LOAN_CODES),
    )
    return rows.withColumns({
        "_named": analysis.pick_field("f.Beneficiary_name"),
        "_payble_to": analysis.pick_field("f.payble_to"),
        "_payable_to": content.payable_to_in_text(text),
        "_ifsc": checks.find_ifsc(text),
        "_pan": content.pan_in_banking_block(text),
        "Place_Of_Supply": content.place_of_supply(text, F.col("Company_GSTIN")),
        "LOAN_TYPE": content.loan_type(F.get(codes, F.lit(0)), text, F.col("Invoice_No")),
        "Invoice_No": content.or_else(F.col("Invoice_No"), content.annexure_invoice_no(text)),
        "DueDate": content.or_else(F.col("DueDate"), content.due_date(text)),
        "AmountDue": F.coalesce("AmountDue", content.amount_due(text)),
        "PONumber": content.or_else(F.col("PONumber"), content.po_number(text)),
        "CustomerId": content.or_else(F.col("CustomerId"), content.customer_id(text)),
        "Total_Amount_In_Words": content.amount_in_words(text),
        "Company_Name": tax.company_name(F.col("Company_Name"), F.col("json")),
    })


def page_records(raw: DataFrame, as_of_year: int, invoice_type: str | None = None,
                 inserted_at: str | None = None) -> DataFrame:
    """One 53-column record per page, keyed by the (document, page) struct ``doc_id``.

    ``as_of_year`` and ``inserted_at`` replace the clock, so a re-run gives the
    same record.
    """
    rows = parsed_pages(raw)
    found = _with_text_finds(_from_fields(rows, as_of_year)).select(
        "doc_id", *[c for c in COLUMNS if c not in ("Invoice_Type", "Insertion_Date")],
        "_named", "_payble_to", "_payable_to", "_ifsc", "_pan",
        tables.classified_tables(F.col("markdown"))["bank"].alias("_bank"),
        tables.bank_hits(F.col("a.tables")).alias("_cells"),
    )
    banked = found.withColumns({
        name: F.coalesce(value, F.col(name))
        for name, value in tables.bank_fields_from_html(F.col("_bank")).items()
    }).drop("_bank")
    # a page whose bank is known keeps all its own bank columns
    known = F.coalesce(F.length("Bank_Name") > 0, F.lit(False))
    banked = banked.withColumns({
        name: F.when(known, F.col(name)).otherwise(content.or_else(F.col(name), tables.first_hit(F.col("_cells"), name)))
        for name in rules.BANK_ALIASES
    }).drop("_cells")
    decided = banked.withColumns({
        "Bank_Payable_To": content.beneficiary(
            F.col("_named"), F.col("_payble_to"), F.col("Vendor_Name_2"), F.col("_payable_to"),
            F.col("Vendor_Name"), F.col("Bank_Payable_To"),
        ),
        "Bank_IFSC_Code": F.when(checks.is_ifsc(F.col("Bank_IFSC_Code")), F.col("Bank_IFSC_Code")).otherwise(
            F.coalesce("_ifsc", "Bank_IFSC_Code")),
        "Vendor_PAN_No": F.when(checks.is_pan(F.col("Vendor_PAN_No")), F.col("Vendor_PAN_No")).otherwise(
            F.coalesce("_pan", "Vendor_PAN_No")),
        "Invoice_Type": F.lit(invoice_type).cast("string"),
        "Insertion_Date": F.lit(inserted_at).cast("string"),
    })
    fixed = tax.derive_totals(tax.repair_identifiers(decided)).withColumns({
        "Invoice_Date": tax.normal_date(F.col("Invoice_Date")),
        "DueDate": tax.normal_date(F.col("DueDate")),
    })
    return fixed.select("doc_id", *COLUMNS)


def invoice_records(page_level: DataFrame) -> DataFrame:
    """Pages merged to one record per document."""
    return pages.merge_pages(
        page_level.select(F.col("doc_id.doc_id").alias("doc_id"), F.col("doc_id.page_no").alias("page_no"), *COLUMNS)
    )


def invoice_items(raw: DataFrame, records: DataFrame) -> DataFrame:
    """Item rows of all pages with the merged invoice number of their document."""
    rows = parsed_pages(raw).withColumn("Invoice_No", clean(analysis.pick_field("f.InvoiceId")))
    structured = tables.items_from_array(rows.select(
        "doc_id", "Invoice_No", F.col("f.Items.valueArray").alias("items")
    ))
    # a page's own list decides, so the choice needs no join
    without = F.coalesce(F.size("f.Items.valueArray"), F.lit(0)) <= 0
    with_table = rows.where(without).select(
        "doc_id", "Invoice_No", tables.classified_tables(F.col("markdown"))["invoice"].alias("table")
    )
    from_html = tables.items_from_html(with_table, F.col("table"))
    chosen = structured.unionByName(from_html.select("doc_id", "Invoice_No", *[
        F.col(c).cast("string") if structured_type.get(c) == "string" else F.col(c).cast(structured_type.get(c, MONEY))
        for structured_type in [dict(structured.dtypes)]
        for c in from_html.columns if c not in ("doc_id", "Invoice_No")
    ]), allowMissingColumns=True)
    by_document = chosen.withColumns({
        "page_no": F.col("doc_id.page_no"), "doc_id": F.col("doc_id.doc_id"),
    })
    return tables.with_invoice_number(by_document, records.select("doc_id", "Invoice_No"))
