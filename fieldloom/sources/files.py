"""Files as tables: listings, JSON and text reads, look-ups for a re-run."""

from __future__ import annotations

import re

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldloom import rules
from fieldloom.operators.ranking import number_rows
from fieldloom.sources.listing import LISTING, listed



# --- names ---------------------------------------------------------------------------

def file_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def extension(path: Column) -> Column:
    """Lower-cased extension with its dot; a name that only starts with dots has none."""
    return F.lower(F.regexp_extract(file_name(path), r"(?s)\A\.*[^.].*(\.[^.]*)\z", 1))


def stem(path: Column) -> Column:
    name = file_name(path)
    return F.substring(name, F.lit(1), F.length(name) - F.length(extension(path)))


def file_kind(path: Column) -> Column:
    ext = extension(path)
    return (
        F.when(ext.isin(rules.IMAGE_EXTENSIONS), "image")
        .when(ext.isin(rules.PDF_EXTENSIONS), "pdf")
        .otherwise("unsupported")
    )


# --- listings -----------------------------------------------------------------------

def list_files(spark: SparkSession, folder: str) -> DataFrame:
    """All files below a folder without reading them; a missing folder is empty.

    Tasks list the folders.  On a file system that only Spark's readers know, Spark lists them
    through the driver, without hidden files.
    """
    found = listed(spark, folder)
    if found is not None:
        return found
    try:
        files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    except AnalysisException as missing:
        if "PATH_NOT_FOUND" in str(missing):
            return spark.createDataFrame([], LISTING)
        raise
    # "content" is not selected, so no file is opened
    return files.select("path", "length", "modificationTime")


def find_by_extension(spark: SparkSession, folder: str, extensions: list[str]) -> DataFrame:
    return with_extension(list_files(spark, folder), extensions)


def with_extension(files: DataFrame, extensions: list[str]) -> DataFrame:
    return files.where(extension(F.col("path")).isin([e.lower() for e in extensions]))


def _below(path: Column, root: str) -> Column:
    """Path parts below the root folder, which is cut off where it first ends.

    ``root`` may be written without the scheme that listings show.
    """
    prefix = re.sub(r"^[a-zA-Z][a-zA-Z0-9+.-]*:/*", "/", root).rstrip("/") + "/"
    at = F.locate(prefix, path)
    return F.split(F.when(at > 0, F.substring(path, at + len(prefix), F.length(path))).otherwise(path), "/")


def input_documents(files: DataFrame, root: str) -> DataFrame:
    """PDF files of each type folder: ``files/`` below it when there is one, else
    the folder itself; not recursive.  ``document_type`` is the folder name in
    lower case."""
    parts = _below(F.col("path"), root)
    placed = files.select(
        "*", F.lower(F.get(parts, F.lit(0))).alias("document_type"), F.get(parts, F.lit(0)).alias("folder"),
        F.size(parts).alias("depth"), (F.get(parts, F.lit(1)) == "files").alias("in_files"),
    ).where("depth >= 2")
    # one flag per type folder, combined before the shuffle
    has_files = placed.groupBy("folder").agg(F.bool_or(F.expr("in_files AND depth >= 3")).alias("has_files"))
    # one row per type folder, of which the input folder has a handful
    here = placed.join(F.broadcast(has_files), "folder").where(
        F.when(F.col("has_files"), F.col("in_files") & (F.col("depth") == 3)).otherwise(F.col("depth") == 2)
    )
    return here.where(F.lower("path").endswith(".pdf")).select(
        "path", "document_type", stem(F.col("path")).alias("document_name")
    )


def archive_documents(files: DataFrame, root: str) -> DataFrame:
    """Every file directly in a sub-folder with its resolved type and a status:
    ``ready``, or ``skipped`` for unknown folders and unsupported files."""
    from fieldloom.functions.pyfuncs import resolve_folder

    parts = _below(F.col("path"), root)
    placed = files.select("path", F.get(parts, F.lit(0)).alias("folder"), F.size(parts).alias("depth")).where(
        "depth = 2"
    )
    return placed.select(
        "path", "folder", resolve_folder("folder").alias("document_type"), file_kind(F.col("path")).alias("kind")
    ).withColumn(
        "status",
        F.when(F.col("document_type").isNull() | (F.col("kind") == "unsupported"), "skipped").otherwise("ready"),
    )


def numbered_names(names: DataFrame, column: str = "name") -> DataFrame:
    """``Agmt_01.pdf`` and so on over the sorted names."""
    return number_rows(names, [column], "_no").select(
        *names.columns,
        F.concat(
            F.lit("Agmt_"),
            F.when(F.col("_no") < 10, F.lpad(F.col("_no").cast("string"), 2, "0")).otherwise(F.col("_no").cast("string")),
            F.lit(".pdf"),
        ).alias("new_name"),
    )


# --- reads --------------------------------------------------------------------------

def read_texts(spark: SparkSession, folder: str, glob: str = "*") -> DataFrame:
    """Whole files as text: ``path, text``."""
    return (
        spark.read.option("wholetext", "true").option("recursiveFileLookup", "true")
        .option("pathGlobFilter", glob).text(folder)
        .select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))
    )


def read_json_documents(spark: SparkSession, folder: str, glob: str = "*.json") -> DataFrame:
    """Whole JSON files: ``path, json, error``; unreadable ones have an error, not a record."""
    files = read_texts(spark, folder, glob)
    good = F.try_parse_json(F.col("text")).isNotNull()
    return files.select(
        "path", F.when(good, F.col("text")).alias("json"),
        F.when(~good, F.lit("unreadable JSON")).alias("error"),
    )


def read_json_lines(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """JSON-lines tables; bad lines are kept in ``_corrupt_record``."""
    return spark.read.schema(f"{schema}, _corrupt_record string").option("mode", "PERMISSIVE").json(folder)


def first_available(names: DataFrame, *sources: DataFrame, value: str = "body") -> DataFrame:
    """For every name the value of the first source that has it, else an error.

    Used for raw JSON before text, and for the raw folder before the type folder.
    Each source: ``name`` (unique) and ``value``.
    """
    out = names
    for i, source in enumerate(sources):
        out = out.join(source.select("name", F.col(value).alias(f"_{i}")), "name", "left")
    tried = [F.col(f"_{i}") for i in range(len(sources))]
    origin = None
    for i, c in enumerate(tried):
        origin = F.when(c.isNotNull(), i) if origin is None else origin.when(c.isNotNull(), i)
    return out.select(
        *names.columns, F.coalesce(*tried).alias(value), origin.alias("source_no"),
        F.when(F.coalesce(*tried).isNull(), F.concat(F.lit("Extracted data not found for "), F.col("name"))).alias("error"),
    )


def saved_records(spark: SparkSession, folder: str) -> DataFrame:
    """Saved records of every sub-folder of the extracted folder."""
    return read_json_documents(spark, folder, "*_extracted.json")
