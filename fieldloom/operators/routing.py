"""Label routing, layered merge and document-type detection.

Long form used throughout: ``doc_id, seq, field_name, field_value, value_type``.
``seq`` carries the order in which a field first appeared in its record.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fieldloom import rules
from fieldloom.rules import STANDARD, RuleBook


def first_match(text: Column, pairs) -> Column:
    """Result of the first pair whose pattern is contained in ``text``.

    A ``CASE`` chain: rule order is evaluation order and no join is needed.
    """
    chain = None
    for pattern, result in pairs:
        hit = text.contains(pattern)
        chain = F.when(hit, F.lit(result)) if chain is None else chain.when(hit, F.lit(result))
    return F.lit(None).cast("string") if chain is None else chain


def _by_type(document_type: str | Column, book: RuleBook, make) -> Column:
    """``make(rules)`` of the document's type; null for unknown types."""
    if isinstance(document_type, str):
        return make(book.types[document_type])
    chain = None
    for name, spec in book.types.items():
        chain = F.when(document_type == name, make(spec)) if chain is None else chain.when(
            document_type == name, make(spec))
    return chain


def _route(low: Column, document_type: str | Column, book: RuleBook) -> Column:
    return _by_type(document_type, book, lambda spec: first_match(low, spec.patterns))


def route_label(label: Column, document_type: str | Column, book: RuleBook = STANDARD) -> Column:
    """Canonical field for a label; null when no pattern of the type matches."""
    return _route(F.lower(label), document_type, book)


def known_label(label: Column, document_type: str | Column, book: RuleBook = STANDARD) -> Column:
    """True when some pattern of the type is contained in the label: one regex
    pass, so that unrouted pairs are dropped before the rule chain runs."""
    low = F.lower(label)
    return _by_type(
        document_type, book, lambda spec: low.rlike("|".join(re.escape(p) for p, _ in spec.patterns) or r"\z\A.")
    )


def _routed(kv: DataFrame, document_type: str | Column, book: RuleBook) -> DataFrame:
    """Pairs whose label is known, with ``field_name``.  The lowered label is a column of its own:
    written into the rule chain it would be made again for every rule that is tried."""
    known = kv.where(known_label(F.col("label"), document_type, book))
    return known.withColumn("_low", F.lower("label")).withColumn("field_name", _route(F.col("_low"), document_type, book))


def routed_rows(kv: DataFrame, document_type: str | Column, book: RuleBook = STANDARD) -> DataFrame:
    """Every pair whose label is known as a field row, repeats included: a layer for ``merge_layers``."""
    return _routed(kv, document_type, book).select(
        "doc_id", "seq", "field_name", F.col("value").alias("field_value"),
        F.when(F.col("value").isNull(), "NoneType").otherwise("str").alias("value_type"),
    )


def route_fields(kv: DataFrame, document_type: str | Column, book: RuleBook = STANDARD) -> DataFrame:
    """Key/value pairs ``doc_id, seq, label, value`` to fields; the last label wins.

    One shuffle on (document, field) with map-side combine, so one document with
    very many pairs is reduced to its few fields before it moves.
    """
    return _routed(kv, document_type, book).groupBy("doc_id", "field_name").agg(
        F.min("seq").cast("bigint").alias("seq"),
        F.max_by("value", "seq").alias("field_value"),
    ).select(
        "doc_id", "seq", "field_name", "field_value",
        F.when(F.col("field_value").isNull(), "NoneType").otherwise("str").alias("value_type"),
    )


def merge_layers(*layers: DataFrame) -> DataFrame:
    """Later layers overwrite earlier ones field by field, and later rows of a layer its
    earlier ones; a field keeps the position where it first appeared.

    Positions of the result are numbered from 0 in each document; the window holds
    one row for each field of a record.
    """
    tagged = [
        layer.select(
            "doc_id", "field_name", "field_value", "value_type",
            F.struct(F.lit(i).alias("layer"), F.col("seq").cast("bigint").alias("seq")).alias("at"),
        )
        for i, layer in enumerate(layers)
    ]
    merged = reduce(DataFrame.unionByName, tagged).groupBy("doc_id", "field_name").agg(
        F.min("at").alias("at"),
        F.max_by(F.struct("field_value", "value_type"), "at").alias("last"),
    )
    seq = F.row_number().over(Window.partitionBy("doc_id").orderBy("at", "field_name")) - 1
    return merged.select("doc_id", seq.cast("bigint").alias("seq"), "field_name", "last.field_value", "last.value_type")


def metadata_layer(docs: DataFrame, **values: Column) -> DataFrame:
    """Constant or computed metadata (type, file, origin) as a layer of fields."""
    pairs = F.array(*[
        F.struct(F.lit(i).cast("bigint").alias("seq"), F.lit(name).alias("field_name"),
                 value.cast("string").alias("field_value"))
        for i, (name, value) in enumerate(values.items())
    ])
    return docs.select("doc_id", F.inline(pairs)).select(
        "*", F.when(F.col("field_value").isNull(), "NoneType").otherwise("str").alias("value_type")
    )


def tag_origin(df: DataFrame, source: str, document_type: str | Column, source_file: Column | None = None) -> DataFrame:
    """Mark where a record came from: saved analysis JSON or free text."""
    kind = F.lit(document_type) if isinstance(document_type, str) else document_type
    tags = {"document_type": kind, "source": F.lit(source)}
    if source_file is not None:
        tags["source_file"] = source_file
    return df.withColumns(tags)


# --- document types ------------------------------------------------------------

def type_from_path(path: Column) -> Column:
    """Document type from the file's parent folder; unknown names are the default."""
    parent = F.lower(F.get(F.reverse(F.split(path, "/")), F.lit(1)))
    chain = None
    for folder, name in rules.PARENT_FOLDER_TYPES.items():
        chain = F.when(parent == folder, name) if chain is None else chain.when(parent == folder, name)
    return chain.otherwise(rules.DEFAULT_TYPE)


# --- schema and prompt text ----------------------------------------------------

def field_schema(catalog: DataFrame) -> DataFrame:
    """Extraction schema rows: required fields first, description from the name."""
    from fieldloom.functions.text import title_words

    return catalog.select(
        "document_type", "ordinal", "field_name",
        F.lit("string").alias("field_type"),
        title_words(F.col("field_name")).alias("description"),
        "required",
    )


def prompt_schema(document_type: Column, book: RuleBook = STANDARD) -> Column:
    """Schema text for a document type, built from the rule book as a literal."""
    chain = None
    for name, spec in book.types.items():
        lines = "\n".join(
            f"- {f} (string): {f.replace('_', ' ').title()} {'(required)' if f in spec.required else '(optional)'}"
            for f in spec.fields
        )
        chain = F.when(document_type == name, lines) if chain is None else chain.when(document_type == name, lines)
    return chain


# --- nested records --------------------------------------------------------------

def flatten_struct(df: DataFrame, sep: str = ".") -> DataFrame:
    """Nested struct columns to flat columns named by path; lists stay as they are."""

    def walk(schema: T.StructType, prefix: str, path: str):
        for f in schema.fields:
            name = f"{prefix}{sep}{f.name}" if prefix else f.name
            here = f"{path}.`{f.name}`" if path else f"`{f.name}`"
            if isinstance(f.dataType, T.StructType):
                yield from walk(f.dataType, name, here)
            else:
                yield F.col(here).alias(name)

    return df.select(*walk(df.schema, "", ""))


def flatten_json(df: DataFrame, json_column: str, sep: str = ".") -> DataFrame:
    """JSON text to long form ``doc_id, path, value``, objects of any depth.

    Empty objects and unreadable texts give no row; lists stay JSON text.  One pass in
    Arrow batches, as the depth is known only from the data.
    """
    from fieldloom.functions.pyfuncs import flat_pairs

    return df.select("doc_id", F.inline(flat_pairs(F.col(json_column), F.lit(sep))))
