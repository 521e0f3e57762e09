"""The three-table store: documents, extractions, validation errors.

Tables are DataFrames (parquet on disk).  Keys are hashes of the natural key, so
a repeated task writes the same ids.  Maintenance returns new table states; the
caller writes them, one document-type partition at a time.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldloom import rules
from fieldloom.functions import checks
from fieldloom.operators.validate import checked_once, record_errors, sanitize, verdicts, with_checks
from fieldloom.rules import STANDARD, RuleBook
from fieldloom.session import written
from fieldloom.sources.versions import Change


@dataclass
class Store:
    documents: DataFrame
    extractions: DataFrame
    errors: DataFrame


def stored_fields(fields: DataFrame) -> DataFrame:
    """Fields without the metadata keys of a record."""
    return fields.where(~F.col("field_name").isin(rules.METADATA_KEYS))


# --- record -> rows ------------------------------------------------------------------

def json_value(value: Column, value_type: Column) -> Column:
    """A field's value as JSON text by its type; text that is no JSON stays text."""
    inner = F.to_json(F.array(value))
    quoted = F.substring(inner, F.lit(2), F.length(inner) - 2)
    typed = F.when(value_type == "bool", F.lower(value)).when(value_type.isin("int", "float", "list", "dict"), value)
    return (
        F.when(value.isNull(), "null")
        .when(F.try_parse_json(typed).isNotNull(), typed)
        .otherwise(quoted)
    )


def record_json(fields: DataFrame) -> DataFrame:
    """One JSON object per document: all its fields in their order, with their types.

    Fields are unique per document after the merge, so the object is as wide as the
    record itself.
    """
    pair = F.concat(
        F.substring(F.to_json(F.array("field_name")), F.lit(2), F.length(F.to_json(F.array("field_name"))) - 2),
        F.lit(":"), json_value(F.col("field_value"), F.col("value_type")),
    )
    return fields.select("doc_id", F.struct("seq", "field_name", pair.alias("pair")).alias("f")).groupBy("doc_id").agg(
        F.sort_array(F.collect_list("f")).alias("f")
    ).select(
        "doc_id", F.concat(F.lit("{"), F.array_join(F.transform("f", lambda x: x["pair"]), ","), F.lit("}")).alias("record")
    )


def field_rows(fields: DataFrame, docs: DataFrame | None = None, book: RuleBook = STANDARD) -> DataFrame:
    """Extraction rows: falsy values become null, the type is the value's own.

    With ``docs`` (``doc_id, document_type, created_at``) ``is_required``, ``is_valid``
    and ``created_at`` are really filled; without, they hold the defaults 0, 1 and null.
    """
    kept = stored_fields(fields)
    value = F.when(checks.is_truthy(F.col("field_value"), F.col("value_type")), F.col("field_value"))
    if docs is None:
        flags = [F.lit(0).alias("is_required"), F.lit(1).alias("is_valid"), F.lit(None).cast("timestamp").alias("created_at")]
    else:
        kept = with_checks(kept).join(docs.select("doc_id", "document_type", "created_at"), "doc_id")
        required = F.lit(False)
        for name, spec in book.types.items():
            required = required | ((F.col("document_type") == name) & F.col("field_name").isin(spec.required))
        flags = [required.cast("int").alias("is_required"), F.col("ok").cast("int").alias("is_valid"), "created_at"]
    return kept.select(
        F.xxhash64("doc_id", "field_name").alias("id"), F.col("doc_id").alias("document_id"), "seq",
        "field_name", value.alias("field_value"), F.col("value_type").alias("field_type"), *flags,
    )


def document_rows(docs: DataFrame, records: DataFrame, checked: DataFrame) -> DataFrame:
    """Document rows: ``docs`` needs ``doc_id, document_name, document_type,
    file_path, created_at``; ``records`` the JSON; ``checked`` the verdicts."""
    return (
        docs.join(records, "doc_id", "left")
        .join(checked.select("doc_id", "is_valid"), "doc_id", "left")
        .select(
            F.col("doc_id").alias("id"), "document_name", "document_type", "file_path", "created_at",
            F.col("created_at").alias("updated_at"),
            F.lit("completed").alias("extraction_status"),
            F.when(F.coalesce("is_valid", F.lit(False)), "valid").otherwise("invalid").alias("validation_status"),
            F.lit(None).cast("string").alias("raw_data"),
            F.coalesce("record", F.lit("{}")).alias("extracted_data"),
        )
    )


def error_rows(errors: DataFrame, docs: DataFrame | None = None) -> DataFrame:
    """Error rows; ``field_name`` is kept, which the message repeats.  ``created_at`` is
    the document's (``docs``: ``doc_id, created_at``), null without."""
    if docs is None:
        dated = errors.withColumn("created_at", F.lit(None).cast("timestamp"))
    else:
        dated = errors.join(docs.select("doc_id", "created_at"), "doc_id", "left")
    return dated.select(
        F.xxhash64("doc_id", "phase", "seq", "message").alias("id"), F.col("doc_id").alias("document_id"),
        "phase", "seq", F.col("message").alias("error_message"), "field_name", "created_at",
    )


def save_documents(docs: DataFrame, fields: DataFrame, book: RuleBook = STANDARD) -> Store:
    """All three tables for new documents."""
    # routed, merged and sanitised once, and checked once; all tables and verdicts read them back
    fields = written(fields, "fields")
    checked = checked_once(fields, docs, book)
    rows = field_rows(fields).drop("created_at").join(
        docs.select(F.col("doc_id").alias("document_id"), "created_at"), "document_id")
    return Store(
        document_rows(docs, record_json(fields), verdicts(docs, fields, book, checked)), rows,
        error_rows(record_errors(docs, fields, book, checked), docs),
    )


# --- queries -------------------------------------------------------------------------

def latest_by_name(documents: DataFrame) -> DataFrame:
    """Newest document of every name (ties: larger id).

    An aggregate, not a window: one hot name is reduced before the shuffle.
    """
    columns = [c for c in documents.columns if c != "document_name"]
    newest = documents.groupBy("document_name").agg(
        F.max_by(F.struct(*columns), F.struct("created_at", "id")).alias("d")
    )
    return newest.select("document_name", "d.*").select(*documents.columns)


def by_type(documents: DataFrame, document_type: str) -> DataFrame:
    return documents.where(F.col("document_type") == document_type).orderBy(
        F.col("created_at").desc(), F.col("id").desc()
    )


def by_id(table: DataFrame, document_id: int, key: str = "id") -> DataFrame:
    return table.where(F.col(key) == document_id)


def statistics(documents: DataFrame) -> DataFrame:
    """Total, per type and per status from one scan: ``dimension, value, n``."""
    return _dimensions(documents.groupBy("document_type", "validation_status").agg(F.count(F.lit(1)).alias("n")))


def committed_statistics(spark: SparkSession, counts: dict[tuple, int]) -> DataFrame:
    """The same from the counters of a store's commits (type, status), without reading a document."""
    rows = [(*k, n) for k, n in counts.items()]
    return _dimensions(spark.createDataFrame(rows, "document_type string, validation_status string, n bigint"))


def _dimensions(base: DataFrame) -> DataFrame:
    sets = base.groupingSets(
        [[], ["document_type"], ["validation_status"]], "document_type", "validation_status"
    ).agg(F.sum("n").alias("n"), F.grouping_id().alias("g"))
    return sets.select(
        F.when(F.col("g") == 3, "total").when(F.col("g") == 1, "document_type").otherwise("validation_status")
        .alias("dimension"),
        F.coalesce("document_type", "validation_status", F.lit("")).alias("value"),
        F.coalesce("n", F.lit(0)).cast("bigint").alias("n"),
    )


# --- maintenance -----------------------------------------------------------------------

def replace_records(store: Store, changed: Store) -> Store:
    """Update documents that exist and replace their fields and errors.

    ``created_at`` stays, ``updated_at`` comes from the change.  Of several changes of
    one document the newest counts (ties: the larger data), and equal children are one.
    Changes for unknown documents are left out.
    """
    ids = changed.documents.select("id").distinct()
    last = F.max(F.struct("updated_at", "extracted_data", "validation_status")).alias("_c")
    new = changed.documents.groupBy("id").agg(last).select(
        "id", F.col("_c.extracted_data").alias("_data"), F.col("_c.validation_status").alias("_status"),
        F.col("_c.updated_at").alias("_at"),
    )
    hit = F.col("_at").isNotNull()
    documents = store.documents.join(new, "id", "left").withColumns({
        "extracted_data": F.when(hit, F.col("_data")).otherwise(F.col("extracted_data")),
        "validation_status": F.when(hit, F.col("_status")).otherwise(F.col("validation_status")),
        "updated_at": F.when(hit, F.col("_at")).otherwise(F.col("updated_at")),
    }).select(*store.documents.columns)
    known = store.documents.select(F.col("id").alias("document_id"))

    def children(old: DataFrame, fresh: DataFrame) -> DataFrame:
        kept = old.join(ids.withColumnRenamed("id", "document_id"), "document_id", "left_anti")
        added = fresh.select(*old.columns).distinct().join(known, "document_id", "left_semi")
        return kept.select(*old.columns).unionByName(added.select(*old.columns))

    return Store(
        documents, children(store.extractions, changed.extractions), children(store.errors, changed.errors)
    )


def delete_documents(store: Store, ids: DataFrame) -> Store:
    """Remove documents and all their children."""
    keys = ids.select(F.col("id").alias("document_id"))
    return Store(
        store.documents.join(ids.select("id"), "id", "left_anti").select(*store.documents.columns),
        store.extractions.join(keys, "document_id", "left_anti").select(*store.extractions.columns),
        store.errors.join(keys, "document_id", "left_anti").select(*store.errors.columns),
    )


def replacement(tables: dict[str, DataFrame], changed: Store) -> Change:
    """The rows that ``replace_records`` would change, for a store that is changed by key.

    Only documents that exist are touched; their old rows are joined by the bucketed key.
    """
    last = F.max(F.struct("updated_at", "extracted_data", "validation_status")).alias("_c")
    new = changed.documents.groupBy(F.col("id").alias("_id")).agg(last)
    old = tables["documents"]
    documents = written(old.join(new, old["id"] == new["_id"]).withColumns({
        "extracted_data": F.col("_c.extracted_data"), "validation_status": F.col("_c.validation_status"), "updated_at": F.col("_c.updated_at"),
    }).select(*old.columns), "replaced")
    known = documents.select(F.col("id").alias("document_id"))
    fresh = lambda name: getattr(changed, name).select(*tables[name].columns).distinct().join(known, "document_id", "left_semi").select(
        *tables[name].columns)
    return Change(
        {"documents": documents, "extractions": fresh("extractions"), "errors": fresh("errors")}, documents.select(F.col("id").alias("key")))


def deletion(tables: dict[str, DataFrame], ids: DataFrame) -> Change:
    """Documents and all their children go; ids that are not there touch nothing."""
    old = tables["documents"]
    gone = ids.select(F.col("id").alias("key"))
    return Change({}, old.join(gone, old["id"] == gone["key"], "left_semi").select(F.col("id").alias("key")))


def insertion(saved: Store) -> Change:
    """New documents with their children, as ``save_documents`` makes them."""
    return Change(
        {"documents": saved.documents, "extractions": saved.extractions, "errors": saved.errors}, saved.documents.select(F.col("id").alias("key")))


def export_lines(store: Store) -> DataFrame:
    """The export as lines: ``document_id, kind, phase, seq, json``.

    Sorted by these columns a document's line (kind 0) is followed by its field
    lines (1) and its error lines (2).  Every child carries its parent's key, so no
    row grows with the number of children, and one shape serves every document.
    Children without a document are left out.
    """
    def lines(table: DataFrame, key: str, kind: int, phase: Column, seq: Column) -> DataFrame:
        return table.select(
            F.col(key).alias("document_id"), F.lit(kind).alias("kind"), phase.cast("int").alias("phase"),
            seq.cast("bigint").alias("seq"), F.to_json(F.struct(*table.columns), {"ignoreNullFields": "false"}).alias("json"),
        )

    known = store.documents.select(F.col("id").alias("document_id"))
    none = F.lit(0)
    children = lines(store.extractions, "document_id", 1, none, F.col("seq")).unionByName(
        lines(store.errors, "document_id", 2, F.col("phase"), F.col("seq")))
    return lines(store.documents, "id", 0, none, none).unionByName(children.join(known, "document_id", "left_semi"))


def reprocess(docs: DataFrame, stored: DataFrame, extracted: DataFrame | None = None,
              book: RuleBook = STANDARD) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Check stored records again: (fields, errors, verdicts).

    ``extracted`` holds fresh fields of documents whose source is still there;
    they replace the stored ones.  A previous verdict is not part of a record.
    """
    old = stored.where(F.col("field_name") != "validation")
    if extracted is not None:
        fresh = extracted.select("doc_id").distinct()
        old = old.join(fresh, "doc_id", "left_anti").select(*stored.columns).unionByName(
            extracted.select(*stored.columns)
        )
    fields = written(sanitize(old), "fields")
    checked = with_checks(fields, docs, book)
    return fields, record_errors(docs, fields, book, checked), verdicts(docs, fields, book, checked)


# --- wide-table upserts -------------------------------------------------------------------

def insertable(df: DataFrame, target_columns: list[str]) -> DataFrame:
    """Columns the target has, empty text as null; rows with no value are left out."""
    shared = [c for c in df.columns if c in target_columns]
    if not shared:
        return df.limit(0).select()
    text = {c for c, t in df.dtypes if t == "string"}
    cleaned = df.select(*[
        (F.when(F.col(c) != "", F.col(c)) if c in text else F.col(c)).alias(c) for c in shared
    ])
    return cleaned.where(F.coalesce(*[F.col(c).cast("string") for c in shared]).isNotNull())


def _last_values(changes: DataFrame, key: str, columns: dict[str, Column], order: tuple[str, ...]) -> DataFrame:
    """One row per key: of each column the last value in ``order`` that is not null
    (ties: the larger value)."""
    return changes.groupBy(key).agg(*[
        F.max_by(value, F.when(value.isNotNull(), F.struct(*[F.col(c) for c in order], value))).alias(f"_{name}")
        for name, value in columns.items()
    ])


def _new_values(changes: DataFrame, target_columns: list[str], key: str, order: tuple[str, ...]) -> tuple[DataFrame, list[str]]:
    columns = [c for c in changes.columns if c in target_columns and c != key]
    text = {c for c, t in changes.dtypes if t == "string"}
    value = lambda c: F.when(F.col(c) != "", F.col(c)) if c in text else F.col(c)
    return _last_values(changes, key, {c: value(c) for c in columns}, order), columns


def update_known_values(
    target: DataFrame, changes: DataFrame, key: str = "Invoice_No", order: tuple[str, ...] = ()
) -> DataFrame:
    """Every column of the change that holds a value overwrites; nulls never do.

    Several changes of one key are applied in ``order``, so each column takes the
    last value that is not null; a target row stays one row.
    """
    new, columns = _new_values(changes, target.columns, key, order)
    merged = target.join(new, key, "left")
    return merged.select(*[
        (F.coalesce(f"_{c}", c).alias(c) if c in columns else F.col(c)) for c in target.columns
    ])


def _new_bank(changes: DataFrame, key: str, order: tuple[str, ...]) -> DataFrame:
    last = F.max(F.struct(*[F.col(c) for c in order], *[F.col(c).alias(f"_{c}") for c in rules.BANK_UPDATE_COLUMNS])).alias("_c")
    return changes.groupBy(key).agg(F.lit(True).alias("_hit"), last)


def update_bank_columns(
    target: DataFrame, changes: DataFrame, key: str = "Invoice_No", order: tuple[str, ...] = ()
) -> DataFrame:
    """The five bank columns are set as given for every changed invoice, nulls too.

    Of several changes of one key the last in ``order`` counts as a whole.
    """
    names = rules.BANK_UPDATE_COLUMNS
    merged = target.join(_new_bank(changes, key, order), key, "left")
    return merged.select(*[
        (F.when(F.col("_hit"), F.col(f"_c._{c}")).otherwise(F.col(c)).alias(c) if c in names else F.col(c))
        for c in target.columns
    ])


def known_value_change(table: str, target: DataFrame, changes: DataFrame, key: str = "Invoice_No", order: tuple[str, ...] = ()) -> Change:
    """``update_known_values`` as the rows that change, for a table that is changed by key.

    The changes are brought to the buckets of the target; the target is read where it lies.
    """
    new, columns = _new_values(changes, target.columns, key, order)
    hit = target.join(new, key).select(*[F.coalesce(f"_{c}", c).alias(c) if c in columns else F.col(c) for c in target.columns])
    rows = written(hit, "upserted")
    return Change({table: rows}, rows.select(F.col(key).alias("key")))


def bank_column_change(table: str, target: DataFrame, changes: DataFrame, key: str = "Invoice_No", order: tuple[str, ...] = ()) -> Change:
    """``update_bank_columns`` as the rows that change, for a table that is changed by key."""
    names = rules.BANK_UPDATE_COLUMNS
    hit = target.join(_new_bank(changes, key, order), key).select(*[F.col(f"_c._{c}").alias(c) if c in names else F.col(c) for c in target.columns])
    rows = written(hit, "upserted")
    return Change({table: rows}, rows.select(F.col(key).alias("key")))
