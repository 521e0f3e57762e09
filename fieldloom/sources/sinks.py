"""Writers: records, reports and tables.

Spark writes one folder per table, partitioned by document type, instead of one
file per document; the document name is a column of every row.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fieldloom.functions.text import WS
from fieldloom.operators.ranking import number_in_group


def verdict_json(record: Column, is_valid: Column, errors: Column) -> Column:
    """Record JSON with ``validation {is_valid, errors}`` added."""
    verdict = F.to_json(F.struct(is_valid.alias("is_valid"), errors.alias("errors")))
    body = F.regexp_replace(record, r"\}\s*\z", "")
    comma = F.when(F.trim(body) == "{", "").otherwise(",")
    return F.concat(body, comma, F.lit('"validation":'), verdict, F.lit("}"))


def write_records(records: DataFrame, extracted_dir: str, raw_dir: str) -> None:
    """Record JSON to both targets, keyed by type *and* name, so equal file names
    of two types do not overwrite each other.  ``records``: ``document_type,
    document_name, value``."""
    for target in (extracted_dir, raw_dir):
        records.write.mode("errorifexists").partitionBy("document_type").json(target)


def write_text(lines: DataFrame, target: str, order: list[str]) -> None:
    """Text lines in order; a global sort keeps parts in order without one big task."""
    lines.orderBy(*order).select("text").write.mode("errorifexists").text(target)


def write_csv(df: DataFrame, target: str) -> bool:
    """CSV with a header of all columns.  Without rows nothing is written and that
    is a success."""
    if df.isEmpty():
        return True
    df.write.mode("errorifexists").option("header", "true").csv(target)
    return True


def write_all_formats(
    records: DataFrame, wide: DataFrame, markdown: DataFrame, text: DataFrame, raw: DataFrame | None, target: str
) -> None:
    """JSON, text, markdown, CSV and raw JSON of one run below one folder."""
    base = target.rstrip("/")
    position = ["doc_id", "section", "block", "line_no"]
    records.write.mode("errorifexists").json(f"{base}/json")
    write_text(text, f"{base}/txt", position)
    write_text(markdown, f"{base}/md", position)
    write_csv(wide, f"{base}/csv")
    if raw is not None:
        raw.write.mode("errorifexists").json(f"{base}/raw")


TABLES = ("documents", "extractions", "errors")


def write_version(tables: dict[str, DataFrame], target: str, version: int) -> None:
    """Write one version of a set of tables below ``target`` and commit it.

    A version has folders of its own, so tables may be computed from the version
    before, and a repeated write replaces only itself.  Readers see the version once
    its commit row is there.
    """
    base = target.rstrip("/")
    for name, table in tables.items():
        table.write.mode("overwrite").parquet(f"{base}/{name}/v{version}")
    spark = next(iter(tables.values())).sparkSession
    spark.range(1).write.mode("overwrite").parquet(f"{base}/commits/version={version}")


def last_version(spark: SparkSession, target: str) -> int:
    """Number of the newest committed version."""
    return spark.read.parquet(f"{target.rstrip('/')}/commits").agg(F.max("version")).first()[0]


def read_version(spark: SparkSession, target: str, names: tuple[str, ...], version: int | None = None) -> dict[str, DataFrame]:
    version = last_version(spark, target) if version is None else version
    return {name: spark.read.parquet(f"{target.rstrip('/')}/{name}/v{version}") for name in names}


def save_store(store, target: str, version: int = 0) -> None:
    """The three store tables as one version."""
    write_version({name: getattr(store, name) for name in TABLES}, target, version)


def read_store(spark: SparkSession, target: str):
    from fieldloom.operators.store import Store

    return Store(**read_version(spark, target, TABLES))


def change_store(spark: SparkSession, target: str, change) -> None:
    """Apply ``change`` (store to store: a replacement, a deletion) to the newest
    version and commit the result as the next one."""
    save_store(change(read_store(spark, target)), target, last_version(spark, target) + 1)


def append_matching(df: DataFrame, target: str, target_columns: list[str]) -> bool:
    """Append the columns the target has; False when none match, True for no rows."""
    from fieldloom.operators.store import insertable

    if not [c for c in df.columns if c in target_columns]:
        return False
    insertable(df, target_columns).write.mode("append").parquet(target)
    return True


def fixed_point(df: DataFrame) -> DataFrame:
    """Every floating-point leaf as a two-decimal number, also inside structs and
    arrays, so that JSON never shows an exponent.  Numbers of more than 36 digits have
    no such form and are null; ``beyond_fixed_point`` finds their rows."""

    def fix(c: Column, dtype: T.DataType) -> Column:
        if isinstance(dtype, (T.DoubleType, T.FloatType)):
            return c.try_cast("decimal(38,2)")
        if isinstance(dtype, T.StructType):
            inner = F.struct(*[fix(c[f.name], f.dataType).alias(f.name) for f in dtype.fields])
            return F.when(c.isNotNull(), inner)
        if isinstance(dtype, T.ArrayType):
            return F.transform(c, lambda x: fix(x, dtype.elementType))
        return c

    return df.select(*[fix(F.col(f"`{f.name}`"), f.dataType).alias(f.name) for f in df.schema.fields])


def beyond_fixed_point(df: DataFrame) -> DataFrame:
    """Rows with a floating-point column that ``fixed_point`` cannot hold, with an ``error`` naming the columns."""
    floats = [f.name for f in df.schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType))]
    lost = F.array_compact(F.array(*[
        F.when(F.col(f"`{c}`").isNotNull() & F.col(f"`{c}`").try_cast("decimal(38,2)").isNull(), F.lit(c)) for c in floats
    ])) if floats else F.array().cast("array<string>")
    return df.withColumn("error", F.concat(F.lit("no fixed-point form: "), F.array_join(lost, ", "))).where(F.size(lost) > 0)


def safe_invoice_name(invoice_no: Column) -> Column:
    """Invoice number as a file name: illegal characters and blanks become ``_``."""
    return F.regexp_replace(F.regexp_replace(invoice_no, r'[<>:"/\\|?*]', "_"), WS + "+", "_")


def output_names(documents: DataFrame, order: list[str]) -> DataFrame:
    """``<invoice no>.pdf`` per document; equal names get ``_1``, ``_2`` in order.

    Documents without an invoice number keep their own name.  ``order`` is the documents'
    key, shared by no two of them.  Only names and keys are sorted and written, and only
    the numbers of names that others have taken come back to the documents.
    """
    named = documents.withColumn(
        "_base", F.when(F.length("Invoice_No") > 0, safe_invoice_name(F.col("Invoice_No")))
    )
    narrow = named.where(F.col("_base").isNotNull()).select("_base", *order)
    later = number_in_group(narrow, ["_base"], order, "_n").where("_n > 1").select(
        *[F.col(c).alias(f"_key{n}") for n, c in enumerate(order)], "_n")
    same = reduce(lambda a, b: a & b, [named[c].eqNullSafe(later[f"_key{n}"]) for n, c in enumerate(order)])
    new_name = (
        F.when(F.col("_base").isNull(), F.col("file_name"))
        .when(F.col("_n").isNull(), F.concat("_base", F.lit(".pdf")))
        .otherwise(F.concat("_base", F.lit("_"), (F.col("_n") - 1).cast("string"), F.lit(".pdf")))
    )
    return named.join(later, same, "left").select(*[named[c] for c in documents.columns], new_name.alias("new_name"))
