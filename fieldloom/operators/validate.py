"""Record validation on the long form: per-field checks, errors, verdicts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldloom.functions import checks
from fieldloom.functions.text import strip
from fieldloom.rules import STANDARD, RuleBook
from fieldloom.session import written

MISSING = "Missing required field: "
BAD_VALUE = "Invalid value for field: "
BAD_FORMAT = "Invalid format for field: "


def sanitize(fields: DataFrame) -> DataFrame:
    """Trim text values; list values have their text items trimmed.

    A nested object is a struct or its own rows in this model, so it is reached
    by applying the same expression to its leaves.
    """
    items = F.try_variant_get(F.try_parse_json("field_value"), "$", "array<variant>")
    trim_item = lambda x: F.when(
        F.schema_of_variant(x) == "STRING", strip(F.variant_get(x, "$", "string")).cast("variant")
    ).otherwise(x)
    trimmed = F.when(F.col("value_type") == "str", strip(F.col("field_value"))).when(
        F.col("value_type") == "list", F.coalesce(F.to_json(F.transform(items, trim_item)), F.col("field_value"))
    ).otherwise(F.col("field_value"))
    return fields.withColumn("field_value", trimmed)


def with_checks(fields: DataFrame, docs: DataFrame | None = None, book: RuleBook = STANDARD) -> DataFrame:
    """Add ``present`` and ``ok`` to every field row; no shuffle.

    Only a book whose types register validators of their own needs ``docs`` (``doc_id,
    document_type``): a present field must then pass its type's validator as well.
    """
    checked = fields.withColumn("_low", F.lower("field_name")).withColumns({
        "present": checks.is_truthy(F.col("field_value"), F.col("value_type")),
        "ok": checks.named_ok(F.col("_low"), F.col("field_value"), F.col("value_type")),
    }).drop("_low")
    own = [(kind, name, check) for kind, spec in book.types.items() for name, check in spec.checks.items()]
    if docs is None or not own:
        return checked
    passed = F.lit(True)
    for kind, name, check in own:
        here = (F.col("_type") == kind) & (F.col("field_name") == name) & F.col("present")
        passed = F.when(here, F.coalesce(check(F.col("field_value")), F.lit(False))).otherwise(passed)
    typed = checked.join(docs.select("doc_id", F.col("document_type").alias("_type")), "doc_id", "left")
    return typed.withColumn("ok", F.col("ok") & passed).drop("_type")


def checked_once(fields: DataFrame, docs: DataFrame | None = None, book: RuleBook = STANDARD) -> DataFrame:
    """The present fields with their ``ok``, written without their values.

    Errors by phase and verdicts all need them: where they are asked for together the
    fields are made and checked once.  An absent field is told by having no row.
    """
    checked = with_checks(fields, docs, book).where("present")
    return written(checked.select("doc_id", "seq", "field_name", "present", "ok"), "checked")


# names in one bit set; a bigint has room for them without its sign
BITS = 62


def _required_flags(book: RuleBook) -> tuple[list[str], list[Column]]:
    """Required names of all types, and for each ``BITS`` of them two bit sets: present, and present but bad.

    Two numbers a document, however many names the book has: read from narrow files a task
    combines very many documents before the shuffle.
    """
    wanted = list(dict.fromkeys(f for spec in book.types.values() for f in spec.required))
    flags = []
    for n in range(0, len(wanted), BITS):
        bit = reduce(lambda chain, f: chain.when(F.col("field_name") == f[1], F.lit(1 << f[0]).cast("bigint")), enumerate(wanted[n:n + BITS]), F)
        flags.append(F.bit_or(F.when(F.col("present"), bit)).alias(f"p{n // BITS}"))
        flags.append(F.bit_or(F.when(F.col("present") & ~F.col("ok"), bit)).alias(f"b{n // BITS}"))
    return wanted, flags


def _has(kind: str, i: int) -> Column:
    """Whether name ``i`` is in the document's bit set ``kind`` (p: present, b: present but bad)."""
    return F.coalesce(F.col(f"{kind}{i // BITS}").bitwiseAND(F.lit(1 << i % BITS).cast("bigint")) != 0, F.lit(False))


def _record_state(docs: DataFrame, checked: DataFrame, flags: list[Column], *more: Column) -> DataFrame:
    """One row per document with its flags.

    Flags are bit sets over a fixed list of names, so the aggregate
    combines on the map side and never holds a document's rows together.
    """
    state = checked.groupBy("doc_id").agg(*flags, *more)
    return docs.select("doc_id", "document_type").join(state, "doc_id", "left")


def required_errors(docs: DataFrame, fields: DataFrame, book: RuleBook = STANDARD, checked: DataFrame | None = None) -> DataFrame:
    """Missing and bad required fields, in catalog order; ``checked`` as in ``record_errors``."""
    wanted, flags = _required_flags(book)
    needed = F.col("field_name").isin(wanted)
    checked = with_checks(fields.where(needed), docs, book) if checked is None else checked.where(needed)
    state = _record_state(docs, checked, flags)
    index = {f: i for i, f in enumerate(wanted)}
    rows = []
    for name, spec in book.types.items():
        for position, f in enumerate(spec.required):
            i = index[f]
            present, bad = _has("p", i), _has("b", i)
            prefix = F.when(~present, MISSING).when(bad, BAD_VALUE)
            rows.append(
                F.when(
                    (F.col("document_type") == name) & prefix.isNotNull(),
                    F.struct(
                        F.lit(1).alias("phase"), F.lit(position).cast("bigint").alias("seq"),
                        F.lit(f).alias("field_name"), F.concat(prefix, F.lit(f)).alias("message"),
                    ),
                )
            )
    listed = F.filter(F.array(*rows), lambda e: e.isNotNull())
    return state.select("doc_id", F.inline(listed))


def format_errors(fields: DataFrame, docs: DataFrame | None = None, book: RuleBook = STANDARD, checked: DataFrame | None = None) -> DataFrame:
    """Every present field that fails its check, in record order; ``checked`` as in ``record_errors``."""
    checked = with_checks(fields, docs, book) if checked is None else checked
    return checked.where(F.col("present") & ~F.col("ok")).select(
        "doc_id", F.lit(2).alias("phase"), "seq", "field_name",
        F.concat(F.lit(BAD_FORMAT), F.col("field_name")).alias("message"),
    )


def record_errors(docs: DataFrame, fields: DataFrame, book: RuleBook = STANDARD, checked: DataFrame | None = None) -> DataFrame:
    """All errors ``doc_id, phase, seq, field_name, message``: required first.

    A bad required field is reported twice, once per phase.  Both phases read ``checked``
    (the fields ``with_checks`` or ``checked_once``; by default they are written here).
    """
    checked = checked_once(fields, docs, book) if checked is None else checked
    return required_errors(docs, fields, book, checked).unionByName(format_errors(fields, docs, book, checked))


def missing_fields(docs: DataFrame, fields: DataFrame, catalog: DataFrame) -> DataFrame:
    """Required (document, field) pairs that have no row at all."""
    wanted = docs.select("doc_id", "document_type").join(
        F.broadcast(catalog.where("required").select("document_type", "field_name", "ordinal")), "document_type"
    )
    return wanted.join(fields.select("doc_id", "field_name"), ["doc_id", "field_name"], "left_anti")


def verdicts(docs: DataFrame, fields: DataFrame, book: RuleBook = STANDARD, checked: DataFrame | None = None) -> DataFrame:
    """One row per document: valid exactly when it has no error; ``checked`` as in ``record_errors``.

    One aggregate over the fields gives required flags and format faults
    together; the messages stay in their own long table.
    """
    wanted, flags = _required_flags(book)
    bad = F.count_if(F.col("present") & ~F.col("ok")).alias("bad")
    state = _record_state(docs, with_checks(fields, docs, book) if checked is None else checked, flags, bad)
    index = {f: i for i, f in enumerate(wanted)}
    faults = F.lit(0)
    for name, spec in book.types.items():
        own = F.lit(0)
        for f in spec.required:
            broken = ~_has("p", index[f]) | _has("b", index[f])
            own = own + broken.cast("int")
        faults = faults + F.when(F.col("document_type") == name, own).otherwise(0)
    return state.select(
        "doc_id", "document_type", (faults + F.coalesce("bad", F.lit(0))).cast("bigint").alias("n_errors")
    ).withColumn("is_valid", F.col("n_errors") == 0)


def document_valid(docs: DataFrame, fields: DataFrame, book: RuleBook = STANDARD) -> DataFrame:
    """The per-type document check: every required field is present, a PAN number
    has ten raw characters, an Aadhaar number twelve digits."""
    wanted, flags = _required_flags(book)
    index = {f: i for i, f in enumerate(wanted)}
    shapes = [
        F.bool_or((F.col("field_name") == "pan_number") & (F.length("field_value") == 10)).alias("pan_shape"),
        F.bool_or(
            (F.col("field_name") == "aadhaar_number") & checks.is_aadhaar_number(F.col("field_value"))
        ).alias("aadhaar_shape"),
    ]
    state = _record_state(docs, with_checks(fields.where(F.col("field_name").isin(wanted))), flags, *shapes)
    chain = None
    for name, spec in book.types.items():
        ok = F.lit(True)
        for f in spec.required:
            ok = ok & _has("p", index[f])
        if name in ("pan", "aadhaar"):
            ok = ok & F.coalesce(F.col(f"{name}_shape"), F.lit(False))
        chain = F.when(F.col("document_type") == name, ok) if chain is None else chain.when(
            F.col("document_type") == name, ok)
    return state.select("doc_id", "document_type", F.coalesce(chain, F.lit(True)).alias("is_valid"))
