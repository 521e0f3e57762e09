"""Reports as ordered lines, and run summaries.

A report is long: ``doc_id, section, block, line_no, text``.  Sorting by the three
position columns gives the report; no running line number is needed, so sections
are produced independently and a long document is never gathered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldloom import rules
from fieldloom.operators.tables import markdown_lines

LINE = ["doc_id", "section", "block", "line_no", "text"]
# sections in report order
HEAD, FIELDS, TABLES_HEAD, TABLES, TEXT_HEAD, TEXT, TEXT_END = range(7)

LINE_BREAK = "\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x85  ]"


def split_lines(c: Column) -> Column:
    """Lines of a text; a final line break does not open a last empty line."""
    lines = F.split(c, LINE_BREAK)
    n = F.size(lines)
    return F.when(F.element_at(lines, -1) == "", F.slice(lines, 1, F.greatest(n - 1, F.lit(0)))).otherwise(lines)


def _fixed(docs: DataFrame, section: int, texts: list) -> DataFrame:
    lines = F.array(*[t if isinstance(t, Column) else F.lit(t) for t in texts])
    return docs.select(
        "doc_id", F.lit(section).alias("section"), F.lit(0).alias("block"),
        F.posexplode(lines).alias("line_no", "text"),
    )


def _at(df: DataFrame, section: int, block, line_no, text: Column) -> DataFrame:
    block = F.lit(block) if isinstance(block, int) else block
    return df.select(
        "doc_id", F.lit(section).alias("section"), block.cast("int").alias("block"),
        line_no.cast("int").alias("line_no"), text.alias("text"),
    )


def _text_lines(contents: DataFrame, head: list[str], lines: Column, end: list[str]) -> DataFrame:
    """The text section of every document that has a text, from one read of it."""
    def at(section: int, line_no: Column, text: Column) -> Column:
        return F.struct(F.lit(section).alias("section"), F.lit(0).alias("block"), line_no.cast("int").alias("line_no"), text.alias("text"))

    fixed = lambda section, texts: F.array(*[at(section, F.lit(n), F.lit(t)) for n, t in enumerate(texts)])
    body = F.transform(lines, lambda x, n: at(TEXT, n, x))
    every = F.concat(fixed(TEXT_HEAD, head), body, *([fixed(TEXT_END, end)] if end else []))
    return contents.where(F.length("content") > 0).select("doc_id", F.inline(every))


def _shown(fields: DataFrame) -> DataFrame:
    return fields.where(~F.col("field_name").isin(rules.REPORT_HIDDEN_KEYS))


def markdown_report(
    docs: DataFrame, fields: DataFrame, cells: DataFrame | None = None, contents: DataFrame | None = None,
    shapes: DataFrame | None = None,
) -> DataFrame:
    """Markdown report lines.

    ``docs``: ``doc_id, name``; ``cells`` as in ``operators.tables``; ``contents``:
    ``doc_id, content``; ``shapes``: ``doc_id, table_no, row_count, column_count`` as
    declared by the service, printed in the table heading.
    """
    item = F.concat(
        F.lit("- **"), F.col("field_name"), F.lit("**: "), F.coalesce("field_value", F.lit("_null_"))
    )
    parts = [
        _fixed(docs, HEAD, [F.concat(F.lit("# "), F.col("name")), "", "## Extracted Fields", ""]),
        _at(_shown(fields), FIELDS, 0, F.col("seq"), item),
    ]
    if cells is not None:
        def around(n_rows: Column, n_columns: Column) -> Column:
            title = F.concat(
                F.lit("### Table "), (F.col("table_no") + 1).cast("string"), F.lit(" ("),
                F.coalesce(n_rows.cast("string"), F.lit("None")), F.lit("r × "),
                F.coalesce(n_columns.cast("string"), F.lit("None")), F.lit("c)"),
            )
            return F.array(
                F.struct(F.lit(-2).alias("line_no"), title.alias("text")),
                F.struct(F.lit(-1).alias("line_no"), F.lit("").alias("text")),
                F.struct(F.lit(2147483647).alias("line_no"), F.lit("").alias("text")),
            )

        # without declared shapes a table's own rows give its heading, in the same pass
        grid = markdown_lines(cells, around if shapes is None else None)
        with_tables = (cells if shapes is None else shapes).select("doc_id").distinct()
        parts += [
            _fixed(with_tables, TABLES_HEAD, ["", "---", "", "## Tables", ""]),
            _at(grid, TABLES, F.col("table_no"), F.col("line_no"), F.col("text")),
        ]
        if shapes is not None:
            headed = shapes.select("doc_id", "table_no", F.inline(around(F.col("row_count"), F.col("column_count"))))
            parts.append(_at(headed, TABLES, F.col("table_no"), F.col("line_no"), F.col("text")))
    if contents is not None:
        parts.append(_text_lines(contents, ["", "---", "", "## Full Document Text", "", "```"], split_lines(F.col("content")), ["```"]))
    return _all(parts)


RULE = "=" * 60


def text_report(fields: DataFrame, docs: DataFrame, contents: DataFrame | None = None) -> DataFrame:
    """Plain-text report lines: names padded to 45, never cut."""
    name = F.col("field_name")
    padded = F.when(F.length(name) < 45, F.rpad(name, 45, " ")).otherwise(name)
    parts = [
        _fixed(docs, HEAD, [RULE, "EXTRACTED FIELDS", RULE]),
        _at(_shown(fields), FIELDS, 0, F.col("seq"),
            F.concat(padded, F.lit(": "), F.coalesce("field_value", F.lit("")))),
    ]
    if contents is not None:
        parts.append(_text_lines(contents, ["", RULE, "FULL DOCUMENT TEXT", RULE, ""], F.split("content", "\n"), []))
    return _all(parts)


def _all(parts: list[DataFrame]) -> DataFrame:
    out = parts[0].select(*LINE)
    for part in parts[1:]:
        out = out.unionByName(part.select(*LINE))
    return out


def assemble(lines: DataFrame) -> DataFrame:
    """Report lines with their line breaks: ``doc_id, section, block, line_no, text``.

    Put together in order the texts are the report; each line is a row, whatever the
    report's length.
    """
    return lines.select(*LINE[:-1], F.concat("text", F.lit("\n")).alias("text"))


# --- paragraphs and pages as text ----------------------------------------------------------

def paragraph_lines(normalised: DataFrame) -> DataFrame:
    """``[i] (role) text`` per paragraph, numbered from 1 in document order."""
    rows = normalised.select("doc_id", F.posexplode("paragraphs").alias("pos", "p"))
    role = F.when(F.length("p.role") > 0, F.concat(F.lit(" ("), F.col("p.role"), F.lit(")"))).otherwise("")
    return rows.select(
        "doc_id", F.col("pos").alias("line_no"),
        F.concat(F.lit("["), (F.col("pos") + 1).cast("string"), F.lit("]"), role, F.lit(" "),
                 F.coalesce("p.content", F.lit(""))).alias("text"),
    )


def page_blocks(pages: DataFrame) -> DataFrame:
    """Page texts under a page banner."""
    bar = "=" * 40
    return pages.select(
        "doc_id", "page_number",
        F.concat(
            F.lit(f"{bar}\nPAGE "), F.coalesce(F.col("page_number").cast("string"), F.lit("?")),
            F.lit(f"\n{bar}\n"), F.col("text"),
        ).alias("text"),
    )


# --- run summaries ----------------------------------------------------------------------

def extraction_summary(records: DataFrame) -> DataFrame:
    """Total, valid and invalid, overall and per type, in one pass.

    ``records``: ``document_type, is_valid``; a missing verdict is invalid, a
    missing type ``unknown``.  The overall row has type null.
    """
    named = records.select(
        F.coalesce("document_type", F.lit("unknown")).alias("document_type"),
        F.coalesce("is_valid", F.lit(False)).alias("is_valid"),
    )
    return named.rollup("document_type").agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(F.col("is_valid")).alias("valid"),
        F.count_if(~F.col("is_valid")).alias("invalid"),
    )


def run_summary(results: DataFrame) -> DataFrame:
    """Processed and failed, overall (type null) and per type."""
    return results.rollup("document_type").agg(
        F.count_if(F.col("error").isNull()).alias("processed"),
        F.count_if(F.col("error").isNotNull()).alias("failed"),
    )


def first_errors(results: DataFrame, order: list, n: int = 10) -> DataFrame:
    """The first ``n`` errors in run order (a top-n, merged from per-task tops)."""
    return results.where(F.col("error").isNotNull()).orderBy(*order).limit(n)


def more_errors(results: DataFrame, n: int = 10) -> DataFrame:
    """How many errors the short list leaves out."""
    return results.agg(
        F.greatest(F.count_if(F.col("error").isNotNull()) - n, F.lit(0)).alias("more")
    )


def batch_counts(results: DataFrame) -> DataFrame:
    """``processed, failed, skipped`` from a ``status`` column."""
    return results.agg(*[
        F.count_if(F.col("status") == s).alias(s) for s in ("processed", "failed", "skipped")
    ])
