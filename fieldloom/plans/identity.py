"""Identity cards and agreements: page texts and a model's answers to stored fields.

The steps in order: pages to one text, the answer's JSON, the typed schema of the
document's type, fall-backs from the text, then fields as the store takes them.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldloom.operators import content, schemas
from fieldloom.session import written

FIELDS = ["doc_id", "seq", "field_name", "field_value", "value_type"]


class Extractors:
    """Document types and what extracts them.

    An extractor takes ``doc_id, text, answer`` of its type's documents and returns
    field rows (``FIELDS``).  Register a type to extend the plan.
    """

    def __init__(self, by_type: dict[str, Callable[[DataFrame], DataFrame]] | None = None):
        self.by_type = dict(by_type or {})

    def register(self, document_type: str, extract: Callable[[DataFrame], DataFrame]) -> "Extractors":
        return Extractors({**self.by_type, document_type.lower(): extract})

    def fields(self, texts: DataFrame) -> tuple[DataFrame, DataFrame]:
        """(fields, errors) of ``doc_id, document_type, text, answer``; a document of a type
        that nobody registered is an error row, and the run goes on."""
        kind = F.lower("document_type")
        out = None
        for name, extract in self.by_type.items():
            rows = extract(texts.where(kind == name).select("doc_id", "text", "answer")).select(*FIELDS)
            out = rows if out is None else out.unionByName(rows)
        unknown = texts.where(~F.coalesce(kind.isin(list(self.by_type)), F.lit(False))).select(
            "doc_id", F.concat(F.lit("Unsupported document type: "), F.coalesce("document_type", F.lit("None"))).alias("error"))
        return out, unknown


def whole_texts(pages: DataFrame, separator: str = "\n\n") -> DataFrame:
    """One text per document, ``doc_id, text``: the patterns need it whole.  For cards and
    agreements, whose text is one value of a few pages."""
    ordered = F.sort_array(F.collect_list(F.struct("page_no", F.coalesce("text", F.lit("")).alias("text"))))
    return pages.groupBy("doc_id").agg(ordered.alias("p")).select(
        "doc_id", F.array_join(F.transform("p", lambda x: x["text"]), separator).alias("text"))


def as_fields(rows: DataFrame, values: dict[str, Column]) -> DataFrame:
    """Named columns as field rows in their order; arrays are kept as JSON, booleans as words."""
    # the values are columns before they become rows, so that each is computed once
    own = rows.select("doc_id", *[c.alias(f"v{n}") for n, c in enumerate(values.values())])
    dtypes = dict(zip(values, (kind for _, kind in own.dtypes[1:])))

    def field(seq: int, name: str, value: Column) -> Column:
        if dtypes[name].startswith("array"):
            shown, kind = F.to_json(value), "list"
        elif dtypes[name] == "boolean":
            shown, kind = F.when(value, "True").when(~value, "False"), "bool"
        else:
            shown, kind = value.cast("string"), "int" if dtypes[name] in ("int", "bigint") else "str"
        return F.struct(
            F.lit(seq).cast("bigint").alias("seq"), F.lit(name).alias("field_name"), shown.alias("field_value"),
            F.when(shown.isNull(), "NoneType").otherwise(kind).alias("value_type"))

    return own.select("doc_id", F.inline(F.array(*[field(n, name, F.col(f"v{n}")) for n, name in enumerate(values)])))


def _typed(texts: DataFrame, document: Callable[[Column], Column]) -> DataFrame:
    answer = texts.withColumn("json", content.answer_json(F.col("answer")))
    return answer.withColumn("d", document(F.col("json")))


def aadhaar_fields(texts: DataFrame) -> DataFrame:
    rows = _typed(texts, schemas.aadhaar_document)
    d, text = lambda n: F.col(f"d.{n}"), F.coalesce("text", F.lit(""))
    found = content.aadhaar_fallbacks(text, d("aadhaar_number_masked"), d("aadhaar_number_unmasked")) | {
        "enrolment_number": content.or_else(d("enrolment_number"), content.enrolment_no(text)),
        "vid": content.or_else(d("vid"), content.virtual_id(text)),
        "date_of_birth": content.or_else(d("date_of_birth"), content.birth_date(text)),
        "guardian_name": content.or_else(d("guardian_name"), content.guardian(text)),
        "pincode": content.or_else(d("pincode"), content.pin_code(text)),
    }
    return as_fields(rows, {n: found.get(n, d(n)) for n in schemas.AADHAAR_FIELDS})


def pan_fields(texts: DataFrame) -> DataFrame:
    rows = _typed(texts, schemas.pan_document)
    d, text = lambda n: F.col(f"d.{n}"), F.coalesce("text", F.lit(""))
    found = {
        "pan_number": content.or_else(d("pan_number"), content.pan_in_text(text)),
        "date_of_birth": content.or_else(d("date_of_birth"), content.slash_date_in_text(text)),
    }
    return as_fields(rows, {n: found.get(n, d(n)) for n in schemas.PAN_FIELDS})


def agreement_fields(texts: DataFrame) -> DataFrame:
    """Identifiers with their fall-backs, the list sections as JSON, and the plain fields."""
    rows = schemas.agreement_documents(texts.withColumn("json", content.answer_json(F.col("answer"))), "json")
    text = F.coalesce("text", F.lit(""))
    at = lambda section, name: F.try_element_at(F.col(section), F.lit(name))
    dates = F.transform("dates", lambda x: F.struct(*[x[n].alias(n) for n in ("date_type", "date_value", "date_text_original")]))
    amounts = F.transform("monetary_values", lambda x: F.struct(*[x[n].alias(n) for n in ("amount_text", "amount_type", "currency")]))
    return as_fields(rows, {
        "company.pan": content.or_else(at("company", "pan"), content.pan_in_text(text)),
        "company.gstin": content.or_else(at("company", "gstin"), content.gstin_in_text(text)),
        "service_provider.pan": content.or_else(at("service_provider", "pan"), content.pan_in_text(text)),
        "service_provider.company.cin": content.cin_in_text(text),
        "payment_terms.ifsc": content.or_else(at("payment_terms", "ifsc"), content.ifsc_in_text(text)),
        "dates": content.with_first_date(dates, text),
        "monetary_values": content.with_stamp_duty(amounts, text),
        "page_count": F.col("page_count"),
    })


STANDARD = Extractors({"aadhaar": aadhaar_fields, "pan": pan_fields, "agreement": agreement_fields})


def process(docs: DataFrame, pages: DataFrame, answers: DataFrame, extractors: Extractors = STANDARD) -> tuple[DataFrame, DataFrame]:
    """(fields, errors) of ``docs`` (``doc_id, document_type``), ``pages`` (``doc_id, page_no,
    text``) and the model's ``answers`` (``doc_id, answer``); either may be missing."""
    texts = docs.select("doc_id", "document_type").join(whole_texts(pages), "doc_id", "left").join(
        answers.select("doc_id", "answer"), "doc_id", "left")
    # every type reads them: pages are put together once, and not once a type
    return extractors.fields(written(texts, "identity-texts"))
