"""Rule tables: fixed values and the user-extensible rule book.

Everything here is data.  Operators turn these tables into column expressions
(``CASE`` chains and literal maps), so a rule lookup never becomes a join.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

# --------------------------------------------------------------------------
# Fixed values.  Order is significant wherever a "first match" rule reads them.
# --------------------------------------------------------------------------

# label pattern -> field, first pattern contained in the lower-cased label wins
LABEL_PATTERNS = {
    "agreement": [
        ("date", "agreement_date"),
        ("agreement date", "agreement_date"),
        ("effective date", "effective_date"),
        ("expiry date", "expiry_date"),
        ("parties", "parties"),
        ("party", "parties"),
        ("type", "agreement_type"),
        ("agreement type", "agreement_type"),
        ("consideration", "consideration"),
        ("governing law", "governing_law"),
        ("jurisdiction", "jurisdiction"),
    ],
    "invoice": [
        ("invoice number", "invoice_number"),
        ("invoice #", "invoice_number"),
        ("invoice no", "invoice_number"),
        ("invoice date", "invoice_date"),
        ("date", "invoice_date"),
        ("total", "total_amount"),
        ("total amount", "total_amount"),
        ("amount", "total_amount"),
        ("due date", "due_date"),
        ("vendor", "vendor_name"),
        ("supplier", "vendor_name"),
        ("customer", "customer_name"),
        ("bill to", "customer_name"),
        ("tax", "tax_amount"),
        ("vat", "tax_amount"),
        ("currency", "currency"),
    ],
    "pan": [
        ("pan number", "pan_number"),
        ("pan", "pan_number"),
        ("permanent account number", "pan_number"),
        ("name", "name"),
        ("father name", "father_name"),
        ("father's name", "father_name"),
        ("date of birth", "date_of_birth"),
        ("dob", "date_of_birth"),
        ("gender", "gender"),
    ],
    "aadhaar": [
        ("aadhaar number", "aadhaar_number"),
        ("aadhaar no", "aadhaar_number"),
        ("uid", "aadhaar_number"),
        ("name", "name"),
        ("date of birth", "date_of_birth"),
        ("dob", "date_of_birth"),
        ("gender", "gender"),
        ("address", "address"),
    ],
}

REQUIRED_FIELDS = {
    "agreement": ["agreement_date", "parties", "agreement_type"],
    "invoice": ["invoice_number", "invoice_date", "total_amount"],
    "pan": ["pan_number", "name"],
    "aadhaar": ["aadhaar_number", "name"],
}

OPTIONAL_FIELDS = {
    "agreement": [
        "effective_date", "expiry_date", "termination_clause", "governing_law",
        "jurisdiction", "consideration", "obligations", "signatures",
    ],
    "invoice": [
        "due_date", "vendor_name", "customer_name", "line_items",
        "tax_amount", "discount_amount", "payment_terms", "currency",
    ],
    "pan": ["father_name", "date_of_birth", "gender"],
    "aadhaar": ["date_of_birth", "gender", "address"],
}

# parent folder name -> document type; anything else is DEFAULT_TYPE
PARENT_FOLDER_TYPES = {
    "agreement": "agreement",
    "agreements": "agreement",
    "invoice": "invoice",
    "invoices": "invoice",
    "pan": "pan",
    "pancard": "pan",
    "aadhaar": "aadhaar",
    "aadhar": "aadhaar",
}
DEFAULT_TYPE = "agreement"

# archive folder keywords, compared as letters only
FOLDER_KEYWORDS = {
    "aadhaar": ["aadhaar", "aadhar", "adhaar", "adhar", "aadharcard", "uidai"],
    "pan": ["pan", "pancard", "pannumber"],
    "agreement": ["agreement", "agreements", "aggrement", "aggrements", "agrement", "contract", "deed"],
}
FOLDER_CUTOFF = 0.72

IMAGE_EXTENSIONS = [".png", ".jpg", ".jpeg", ".bmp", ".tiff", ".tif", ".webp", ".gif"]
PDF_EXTENSIONS = [".pdf"]

# keys that describe a record and are never stored as fields
METADATA_KEYS = ["document_type", "source_file", "validation"]
# keys that reports leave out
REPORT_HIDDEN_KEYS = ["created_at", "updated_at", "id", "validation"]

MASKED_FIELDS = {
    "pan": ["pan_number", "pan"],
    "aadhaar": ["aadhaar_number", "aadhaar", "uid"],
}
MASKED_ALWAYS = ["password", "pin", "ssn", "credit_card"]

TRUE_WORDS = ["true", "yes", "y", "1", "present", "applicable", "allowed", "required", "detected"]
FALSE_WORDS = [
    "false", "no", "n", "0", "", "not present", "not applicable", "not allowed", "not required", "absent",
]

# (source field, record column, cleaner, required)
INVOICE_FIELDS = [
    ("BillingAddress", "Company_Address", "address", False),
    ("BillingAddressRecipient", "Company_Name", "text", False),
    ("CustomerName", "Company_Name_1", "text", False),
    ("CustomerTaxId", "Company_GSTIN", "gstin", False),
    ("InvoiceDate", "Invoice_Date", "date", False),
    ("InvoiceId", "Invoice_No", "text", True),
    ("InvoiceTotal", "Total_Payable", "numeric", False),
    ("ShippingAddress", "Company_Address_1", "address", False),
    ("ShippingAddressRecipient", "Company_Address_2", "text", False),
    ("SubTotal", "Amount_Before_GST", "numeric", False),
    ("VendorAddress", "Vendor_Address", "address", False),
    ("VendorName", "Vendor_Name", "text", False),
    ("VendorAddressRecipient", "Vendor_Name_1", "text", False),
    ("VendorTaxId", "Vendor_GSTIN", "gstin", False),
    ("CustomerAddress", "Company_Address_3", "address", False),
    ("TotalAmount", "TotalAmount", "numeric", False),
    ("AmountDue", "AmountDue", "numeric", False),
    ("BalanceForward", "BalanceForward", "numeric", False),
    ("CountryRegion", "CountryRegion", "text", False),
    ("CustomerId", "CustomerId", "text", False),
    ("DueDate", "DueDate", "date", False),
    ("PONumber", "PONumber", "text", False),
    ("RemittanceAddress", "RemittanceAddress", "address", False),
    ("RemittanceAddressRecipient", "Vendor_Name_2", "text", False),
    ("ServiceAddress", "ServiceAddress", "address", False),
    ("ServiceAddressRecipient", "ServiceAddressRecipient", "text", False),
    ("SubtotalAmount", "Amount_Before_GST_1", "numeric", False),
    ("TotalDiscountAmount", "TotalDiscountAmount", "numeric", False),
    ("TotalTaxAmount", "TotalTaxAmount", "numeric", False),
    ("IRN", "IRN", "text", False),
    ("bank_account_no", "Bank_Account_No", "bank_account", False),
    ("bank_branch", "Bank_Branch", "text", False),
    ("bank_name", "Bank_Name", "text", False),
    ("ifsc_code", "Bank_IFSC_Code", "ifsc", False),
    ("vendor_pan_no", "Vendor_PAN_No", "pan", False),
]

# a tax id that is no GSTIN but a valid PAN goes to this column instead
TAX_ID_PAN_COLUMN = {"VendorTaxId": "Vendor_PAN_No", "CustomerTaxId": "Company_PAN_No"}

# derived record columns: (name, type, default)
INVOICE_DERIVED = [
    ("Commission_Month", "string", None),
    ("IGST", "decimal(18,2)", "0"),
    ("CGST", "decimal(18,2)", "0"),
    ("SGST", "decimal(18,2)", "0"),
    ("Total_Tax", "decimal(18,2)", None),
    ("Company_PAN_No", "string", None),
    ("Total_Amount_In_Words", "string", None),
    ("Bank_Payable_To", "string", None),
    ("E_way_bill_No", "string", None),
    ("E_way_bill_No_Flag", "boolean", False),
    ("IRN_Flag", "string", "False"),
    ("E_Invoice_Flag", "string", "False"),
    ("Digital_Signature_Val", "boolean", False),
    ("File_Name", "string", None),
    ("Invoice_Type", "string", None),
    ("Insertion_Date", "string", None),
    ("Place_Of_Supply", "string", None),
    ("LOAN_TYPE", "string", None),
]

# page merge: these take the larger value, all others the first meaningful one
LARGEST_WINS = ["CGST", "SGST", "IGST", "Total_Tax"]
# text that counts as empty in the page merge
EMPTY_TEXT = ["", "0", "0.0"]

TAX_LABELS = [
    ("CGST", ["cgst", "csgt", "c gst", "c-gst", "cg st"]),
    ("SGST", ["sgst", "s gst", "s-gst", "sg st"]),
    ("IGST", ["igst", "i gst", "i-gst", "ig st"]),
]

LOAN_CODES = ["AL", "BL", "CC", "GL", "HL", "LAP", "OD", "PL", "SC", "TL", "WC"]

IFSC_BANK_CODES = [
    "ICIC", "HDFC", "SBIN", "UTIB", "KKBK", "YESB", "IDIB", "PUNB", "BARB", "BKID",
    "CNRB", "UBIN", "IOBA", "CBIN", "SYNB", "ALLA", "ANDB", "CITI", "SCBL", "HSBC",
    "DEUT", "KARB", "MAHB", "FDRL", "TMBL", "RATN", "INDB", "VIJB", "PYTM", "AIRP",
    "IDFB", "UNBA",
]

STATE_NAMES = {
    "01": "Jammu and Kashmir", "02": "Himachal Pradesh", "03": "Punjab", "04": "Chandigarh",
    "05": "Uttarakhand", "06": "Haryana", "07": "Delhi", "08": "Rajasthan",
    "09": "Uttar Pradesh", "10": "Bihar", "11": "Sikkim", "12": "Arunachal Pradesh",
    "13": "Nagaland", "14": "Manipur", "15": "Mizoram", "16": "Tripura",
    "17": "Meghalaya", "18": "Assam", "19": "West Bengal", "20": "Jharkhand",
    "21": "Odisha", "22": "Chhattisgarh", "23": "Madhya Pradesh", "24": "Gujarat",
    "27": "Maharashtra", "28": "Andhra Pradesh", "29": "Karnataka", "30": "Goa",
    "31": "Lakshadweep", "32": "Kerala", "33": "Tamil Nadu", "34": "Puducherry",
    "35": "Andaman and Nicobar Islands", "36": "Telangana", "37": "Andhra Pradesh",
    "38": "Ladakh",
}

# item column -> header aliases, first alias with a value wins
ITEM_ALIASES = {
    "Item_Description": ["item_description", "description", "particulars", "particular", "service", "product"],
    "Region": ["region", "state", "location"],
    "Disbursement_Amount": ["disbursement_amount", "amount", "total_amount", "grand_total", "net_amount"],
    "ROI_Percent": ["roi_percent", "roi", "interest", "rate"],
    "PF_Percent": ["pf_percent", "pf"],
    "Payout_Percent": ["payout_percent", "payout"],
    "Subvention_Percent": ["subvention_percent", "subvention"],
    "HSN_Code": ["hsn_code", "hsn", "sac", "code"],
    "Quantity": ["quantity", "qty"],
    "Unit": ["unit", "uom"],
    "Unit_Amount": ["unit_amount", "unit price", "unitprice", "rate", "price"],
    "Discount_Amount": ["discount_amount", "discount"],
    "Taxable_Amount": ["taxable_amount", "taxable", "amount_before_gst", "assessable_amount"],
    "Total_Amount": ["total_amount", "amount", "line_total", "net_amount"],
    "Total_Payout": ["total_payout", "payout"],
    "Invoice_Type": ["invoice_type", "type"],
}
ITEM_TEXT_COLUMNS = ["Item_Description", "Region", "HSN_Code", "Unit", "Invoice_Type"]

# bank column -> header aliases (header lower-cased, spaces removed)
BANK_ALIASES = {
    "Bank_Name": ["bankname", "bank", "name"],
    "Bank_Branch": ["branch", "bankbranch", "branchname"],
    "Bank_Account_No": ["accountno", "accountnumber", "account", "acno", "a/cno"],
    "Bank_IFSC_Code": ["ifsccode", "ifsc", "ifsccodertgsneft", "rtgs/neft"],
    "Bank_Payable_To": ["payableto", "beneficiary", "beneficiaryname", "accountholder"],
    "Vendor_PAN_No": ["pan", "panno", "pannumber", "pancard", "pancardno"],
}
# label cell key -> bank column, first key contained in the label wins
BANK_LABELS = [
    ("payable", "Bank_Payable_To"),
    ("beneficiary", "Bank_Payable_To"),
    ("bankname", "Bank_Name"),
    ("branch", "Bank_Branch"),
    ("account", "Bank_Account_No"),
    ("ifsc", "Bank_IFSC_Code"),
    ("pan", "Vendor_PAN_No"),
]
BANK_CLEANERS = {"Bank_Account_No": "bank_account", "Bank_IFSC_Code": "ifsc", "Vendor_PAN_No": "pan"}
BANK_UPDATE_COLUMNS = ["Bank_Name", "Bank_Payable_To", "Bank_Branch", "Bank_Account_No", "Bank_IFSC_Code"]

MONTHS = [
    "January", "February", "March", "April", "May", "June", "July",
    "August", "September", "October", "November", "December",
]

PAN_PATTERN = "[A-Z]{5}[0-9]{4}[A-Z]"
GSTIN_PATTERN = "[0-9]{2}[A-Z]{5}[0-9]{4}[A-Z][0-9][A-Z][A-Z0-9]"
IFSC_PATTERN = "[A-Z]{4}0[A-Z0-9]{6}"

# patterns searched in running text; one capture group unless noted
TEXT_PATTERNS = {
    "place_of_supply": r"(?i)Place\s+of\s+Supply\s*[:\-]\s*([A-Za-z][A-Za-z ]{1,30}?)(?:\n|\z)",
    "annexure_number": r"\b([A-Z]{2}/[0-9]{4}/[0-9]{4,})\b",
    "sales_invoice_number": r"(?i)Sales\s+Invoice\s+No\s*\n([A-Z0-9/\-]+)",
    "due_date": (
        r"(?i)(?:Due\s+Date|Payment\s+Due|Due\s+By|Last\s+(?:Date|Payment)\s+Date?)\s*[:\-]\s*"
        r"([0-9]{1,2}[-/.][\p{L}\p{N}_]+[-/.][0-9]{2,4}|[0-9]{4}[-/.][0-9]{2}[-/.][0-9]{2}"
        r"|[0-9]{1,2}\s+[\p{L}\p{N}_]+\s+[0-9]{4})"
    ),
    "amount_due": (
        r"(?i)(?:Amount\s+Due|Balance\s+Due|Net\s+Payable|Total\s+Due|Total\s+Payable\s+Amount)\s*[:\-]?\s*"
        r"(?:Rs\.?|INR)?\s*([0-9,]+(?:\.[0-9]{1,2})?)"
    ),
    "po_number": r"(?i)(?:PO\s*No\.?|Purchase\s+Order\s*(?:No\.?)?|P\.O\.\s*No\.?)\s*[:\-]\s*([A-Z0-9\-/]{3,30})",
    "customer_id": r"(?i)(?:Customer\s*(?:ID|No\.?|Code)|Client\s*(?:ID|Code))\s*[:\-]\s*([A-Z0-9\-/]{3,30})",
    # whole match
    "amount_in_words": r"(?:Rupees\s+)?([A-Z][A-Za-z ,]+(?:Hundred|Thousand|Lakh|Crore|Only)[A-Za-z ,]*\.?)",
    "payable_to": r"[Pp]ayable\s+to\s*[:\-]\s*([A-Za-z0-9 .&,'\-/]+)",
    # whole match, bounded tail
    "banking_block": r"(?is)Banking\s+Details.*",
    "labelled_pan": r"(?i)PAN\s*[:\-]?\s*([A-Z]{5}[0-9]{4}[A-Z])",
    "labelled_ifsc": r"(?i)(?:IFSC|IFS|RTGS|NEFT)\s*(?:Code)?\s*[:\-]?\s*([A-Z]{4}0[A-Z0-9]{6})",
    "ifsc_then_label": r"(?i)([A-Z]{4}0[A-Z0-9]{6})\s*(?:IFSC|IFS|RTGS|NEFT)",
    "gstin_label": r"(?i)^(gstin|gst)\s*(no\.?)?\s*[:\-\s]?\s*",
    "your_aadhaar_no": r"(?i)(?:Your Aadhaar No\.)\s*:?\s*([0-9X\s]{12,17})",
    "aadhaar_no": r"(?i)Aadhaar\s*No\.?\s*:?\s*([0-9X\s]{12,17})",
    "twelve_digits": r"\b([0-9]{4}\s*[0-9]{4}\s*[0-9]{4})\b",
    "enrolment_no": r"(?i)Enrolment No\.?\s*:?\s*([0-9/]+)",
    "virtual_id": r"(?i)VID\s*:?\s*([0-9]+)",
    "birth_date": r"(?i)DOB\s*:?\s*([0-9]{2}/[0-9]{2}/[0-9]{4})",
    # relation, name
    "guardian": r"(?i)(S/O|D/O|W/O|C/O)\s*:?\s*([A-Za-z\s]+?)(?:\n|\z)",
    "pin_code": r"\b([0-9]{6})\b",
    "slash_date": r"\b([0-9]{2}/[0-9]{2}/[0-9]{4})\b",
    "any_date": r"\b([0-9]{1,2}[/\-.][0-9]{1,2}[/\-.][0-9]{2,4})\b",
    "stamp_duty": r"(?i)Stamp\s*Duty[^0-9]{0,10}(Rs\.?\s*[0-9,]+)",
    "agreement_gstin": r"\b([0-9]{2}[A-Z]{5}[0-9]{4}[A-Z][0-9]Z[A-Z0-9])\b",
    "cin": r"\b([LU][0-9]{5}[A-Z]{2}[0-9]{4}[A-Z]{3}[0-9]{6})\b",
}

DATE_TYPES = [
    "agreement_date", "execution_date", "effective_date", "commencement_date", "start_date",
    "end_date", "expiry_date", "termination_date", "renewal_date", "renewal_effective_date",
    "company_signature_date", "service_provider_signature_date", "authorized_signatory_signature_date",
    "witness_signature_date", "stamp_date", "board_resolution_date", "power_of_attorney_date",
    "partner_authorization_date", "designated_partner_resolution_date", "invoice_date",
    "invoice_submission_date", "payment_due_date", "payment_date", "payment_cycle_date",
    "month_end_date", "tax_deduction_date", "notice_date", "notice_effective_date",
    "notice_period_start_date", "notice_period_end_date", "termination_notice_date", "audit_date",
    "inspection_date", "review_date", "kyc_review_date", "periodic_review_date",
    "compliance_deadline", "service_start_date", "service_completion_date",
    "loan_disbursement_date", "referral_date", "lead_date", "customer_contact_date",
    "approval_date", "amendment_date", "variation_date", "supplement_date", "novation_date",
    "renewal_agreement_date",
]

MONEY_TYPES = [
    "STAMP_DUTY", "REGISTRATION_FEE", "SERVICE_FEE", "SERVICE_CHARGE", "REFERRAL_FEE",
    "COMMISSION", "PROCESSING_FEE", "PROFESSIONAL_FEE", "FIXED_FEE", "VARIABLE_FEE",
    "PERCENTAGE_FEE", "LOAN_AMOUNT", "DISBURSEMENT_AMOUNT", "CUSTOMER_PAYMENT",
    "REIMBURSEMENT", "EXPENSE", "PENALTY", "LIQUIDATED_DAMAGES", "INTEREST", "TAX", "GST",
    "TDS", "WITHHOLDING_TAX", "SECURITY_DEPOSIT", "ADVANCE", "REFUND", "CREDIT", "DEBIT",
    "OTHER",
]

# words of a table's header and cells, by the kind of table they show
TABLE_WORDS = {
    "bank": ["bank", "account", "ifsc"],
    "gst": ["cgst", "sgst", "igst"],
    "invoice": ["disb", "roi", "payout", "region", "pf"],
}

# item column: source field
ITEM_VALUES = {
    "HSN_Code": "ProductCode",
    "Quantity": "Quantity",
    "Unit": "Unit",
    "Unit_Amount": "UnitPrice",
    "Discount_Amount": "DiscountAmount",
    "Taxable_Amount": "TaxableAmount",
    "Total_Payout": "TotalPayout",
    "Invoice_Type": "InvoiceType",
}

# letters read for digits and digits read for letters in a tax id, and what they stand for
DIGIT_REPAIR = ("OILZSBGDQT", "0112586007")
LETTER_REPAIR = ("0125867", "OIZSBGT")

LENDER_WORDS = ["unity", "bank"]
LENDER_NAME = "Unity Small Finance bank limited"

MONTH_YEAR_PATTERN = r"(?i)\b(Jan(?:uary)?|Feb(?:ruary)?|Mar(?:ch)?|Apr(?:il)?|May|Jun(?:e)?|Jul(?:y)?|Aug(?:ust)?|Sep(?:tember)?|Oct(?:ober)?|Nov(?:ember)?|Dec(?:ember)?)\s*[-,]?\s*([0-9]{2,4})\b"

# dates in running text, longest numeric shape first
DATE_FINDER = (
    r"\b([0-9]{4}[-/.][0-9]{2}[-/.][0-9]{2}|[0-9]{2}[-/.][0-9]{2}[-/.][0-9]{4}|[0-9]{2}[-/.][0-9]{2}[-/.][0-9]{2}"
    r"|[0-9]{2}\s+(?:January|February|March|April|May|June|July|August|September|October|November|December),?\s+[0-9]{4}"
    r"|[0-9]{1,2}\s+(?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)\s+[0-9]{4}"
    r"|(?:January|February|March|April|May|June|July|August|September|October|November|December)\s+[0-9]{1,2},?\s*[0-9]{4})\b"
)
# --------------------------------------------------------------------------
# End of fixed values.
# --------------------------------------------------------------------------

CATALOG_SCHEMA = "document_type string, field_name string, required boolean, ordinal int"


@dataclass
class DocumentRules:
    """What one document type needs: fields in order and label patterns in order."""

    required: list[str]
    optional: list[str] = field(default_factory=list)
    patterns: list[tuple[str, str]] = field(default_factory=list)
    # field -> predicate over the raw column, in addition to the name-based checks
    checks: dict = field(default_factory=dict)

    @property
    def fields(self) -> list[str]:
        return list(dict.fromkeys(self.required + self.optional))


class RuleBook:
    """Document types known to a run.  Register a type to extend every operator."""

    def __init__(self, types: dict[str, DocumentRules] | None = None):
        self.types = dict(types or {})

    @classmethod
    def standard(cls) -> "RuleBook":
        return cls({
            name: DocumentRules(REQUIRED_FIELDS[name], OPTIONAL_FIELDS[name], LABEL_PATTERNS[name])
            for name in REQUIRED_FIELDS
        })

    def register(self, name: str, rules: DocumentRules) -> "RuleBook":
        return RuleBook({**self.types, name.lower(): rules})

    def field_names(self) -> list[str]:
        """Every field any type can carry; the width bound of a record."""
        names: dict[str, None] = {}
        for rules in self.types.values():
            names.update(dict.fromkeys(rules.fields))
            names.update(dict.fromkeys(f for _, f in rules.patterns))
        return list(names)

    def catalog(self, spark: SparkSession) -> DataFrame:
        """``field_catalog``: one row per (type, field), required fields first."""
        rows = [
            (name, f, f in rules.required, i)
            for name, rules in self.types.items()
            for i, f in enumerate(rules.fields)
        ]
        return spark.createDataFrame(rows, CATALOG_SCHEMA)


STANDARD = RuleBook.standard()
