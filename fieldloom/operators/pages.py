"""Pages of one document to one record or one text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fieldloom import rules


def _meaningful(c: Column, dtype: T.DataType) -> Column:
    """Null, empty text, zero and False count as empty."""
    if isinstance(dtype, T.StringType):
        known = ~c.isin(rules.EMPTY_TEXT)
    elif isinstance(dtype, T.BooleanType):
        known = c
    else:
        known = c != 0
    return F.coalesce(known, F.lit(False))


def merge_pages(pages: DataFrame, key: str = "doc_id", page: str = "page_no") -> DataFrame:
    """One record per document: per column the first meaningful page value, else
    page one's; the tax columns take the largest meaningful value.

    Each column is one ``min_by`` on (not meaningful, page): partial aggregates
    combine before the shuffle and pages are never gathered.
    """
    out = []
    for f in pages.schema.fields:
        if f.name in (key, page):
            continue
        c = F.col(f"`{f.name}`")
        good = _meaningful(c, f.dataType)
        first = F.min_by(c, F.struct((~good).alias("late"), F.col(page)))
        if f.name in rules.LARGEST_WINS:
            first = F.coalesce(F.max(F.when(good, c)), first)
        out.append(first.alias(f.name))
    return pages.groupBy(key).agg(*out)


def combine_texts(pages: DataFrame, separator: str = "\n\n") -> DataFrame:
    """Page texts as the parts of one text: ``doc_id, page_no, text``.

    Put together in page order the parts are the document: each but the first starts
    with the separator.  A part is one page, whatever the document's size; only the
    first page number is looked up per document.
    """
    first = pages.groupBy("doc_id").agg(F.min("page_no").alias("first"))
    text = F.coalesce("text", F.lit(""))
    return pages.join(first, "doc_id").select(
        "doc_id", "page_no", F.when(F.col("page_no") == F.col("first"), text).otherwise(F.concat(F.lit(separator), text)).alias("text")
    )


def page_counts(pages: DataFrame) -> DataFrame:
    return pages.groupBy("doc_id").agg(F.count(F.lit(1)).alias("pages"))


def union_items(*page_items: DataFrame) -> DataFrame:
    """Item tables of several pages under each other; missing columns are null."""
    out = page_items[0]
    for more in page_items[1:]:
        out = out.unionByName(more, allowMissingColumns=True)
    return out
