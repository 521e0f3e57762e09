"""The corpus pipeline: quality rules, line dedup, near-dedup, decontamination, packing."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldloom.llm.common import stored, table
from fieldloom.llm.decontamination import leaks
from fieldloom.llm.line_dedup import line_dedup
from fieldloom.llm.packing import pack
from fieldloom.llm.quality import quality_rules
from fieldloom.llm.simhash import near_duplicates

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


KEY = ("none", "of", "text_hash", "blank")


def keyed(docs: DataFrame) -> DataFrame:
    """Rows with a key of id and text, as columns and as the struct ``row``, in which rows without an id come last.

    Stages decide by this key, so rows that share an id, or have none, are judged apart.
    """
    rows = docs.select(
        *COLUMNS, F.col("doc_id").isNull().alias("none"), F.coalesce("doc_id", F.lit(0)).alias("of"),
        F.coalesce(F.xxhash64("text"), F.lit(0)).alias("text_hash"), F.col("text").isNull().alias("blank"))
    return rows.withColumn("row", F.struct(*KEY))


def chosen(rows: DataFrame, keys: DataFrame, how: str, also: tuple[str, ...] = ()) -> DataFrame:
    """Semi- or anti-join of keyed rows by their key and by further columns, null-safe."""
    own = keys.select(*[F.col(f"row.{c}").alias(f"key_{c}") for c in KEY], *[F.col(c).alias(f"key_{c}") for c in also]).distinct()
    on = [F.col(c) == F.col(f"key_{c}") for c in KEY] + [F.col(c).eqNullSafe(F.col(f"key_{c}")) for c in also]
    return rows.join(own, on, how)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep, row by row.

    A verdict hangs on text, language and source, so rows that share them and their id have the same.
    """
    rows = keyed(docs)
    kept = quality_rules(rows, id_col="row", carry=("lang", "source")).where("kept")
    return chosen(rows, kept, "left_semi", ("lang", "source")).select(*COLUMNS)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the lines that repeat in five documents or more."""
    rows = line_dedup(docs, carry=("lang", "source"), min_chars=40, min_docs=5)
    return rows.select("doc_id", "text", "lang", "source", F.length("text").cast("long").alias("n_chars"))


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the smallest doc_id, of each group whose fingerprints link at four bits or fewer.

    Line dedup can leave a document empty; such documents are one group.  Of a group without
    any id, and of rows that share id and text, one row stays.
    """
    rows = keyed(docs)
    first = near_duplicates(rows, id_col="row").where("row = component_id")
    kept = chosen(rows, first, "left_semi")
    return kept.dropDuplicates(list(KEY)).select(*COLUMNS)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    rows = keyed(docs)
    held = leaks(rows, table(spark, sf_dir, "benchmark"), id_col="row")
    return chosen(rows, held, "left_anti").select(*COLUMNS)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' pieces in length buckets and batches."""
    return pack(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality rules", quality),
    ("line dedup", lines),
    ("SimHash near-dedup", near),
    ("benchmark decontamination", decontaminate),
    ("packing", packing),
]

# fingerprints, decontamination and optimal buckets have no SQL; tests/llm compares the stages with brute force
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each stage's rows are written and read again."""
    docs = table(spark, sf_dir, "documents")
    for n, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if n + 1 < len(STAGES):
            docs = stored(docs, f"stage{n}")
    return docs
