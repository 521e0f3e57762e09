"""Batch plan for routed documents: pairs -> fields -> checks -> store."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldloom.operators import routing, store, validate
from fieldloom.rules import STANDARD, RuleBook


def extract_fields(
    docs: DataFrame, kv: DataFrame, model_fields: DataFrame | None = None, book: RuleBook = STANDARD
) -> DataFrame:
    """Fields of every document: analysis pairs, then model fields, then metadata.

    ``docs``: ``doc_id, document_type, file_path``; ``kv``: ``doc_id,
    document_type, seq, label, value``.
    """
    # pairs are not reduced on their own first: the merge keeps the last of a layer
    layers = [routing.routed_rows(kv, F.col("document_type"), book)]
    if model_fields is not None:
        layers.append(model_fields)
    layers.append(routing.metadata_layer(
        docs, document_type=F.col("document_type"), source_file=F.col("file_path")
    ))
    return routing.merge_layers(*layers)


def process(
    docs: DataFrame, kv: DataFrame, model_fields: DataFrame | None = None, book: RuleBook = STANDARD
) -> store.Store:
    """The whole run: extract, sanitise, validate and build the three tables."""
    fields = validate.sanitize(extract_fields(docs, kv, model_fields, book))
    return store.save_documents(docs, fields, book)


def verdict_counts(docs: DataFrame, kv: DataFrame, book: RuleBook = STANDARD) -> DataFrame:
    """Valid and invalid documents per type."""
    fields = validate.sanitize(routing.route_fields(kv, F.col("document_type"), book))
    checked = validate.verdicts(docs, fields, book)
    return checked.groupBy(
        "document_type", F.when(F.col("is_valid"), "valid").otherwise("invalid").alias("validation_status")
    ).agg(F.count(F.lit(1)).alias("n_documents"), F.sum("n_errors").cast("bigint").alias("n_errors"))
