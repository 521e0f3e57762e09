"""Reports as lines, run summaries."""

from __future__ import annotations

from pyspark.sql import functions as F

from fieldloom.operators import reports
from workload.base import query

HIDDEN = "('created_at', 'updated_at', 'id', 'validation')"
_REPORT_FIELDS = """SELECT doc_id, CAST(seq AS BIGINT) AS seq, CASE WHEN seq = 0 THEN 'id' ELSE field_name END AS field_name,
    CASE WHEN seq = 1 THEN NULL ELSE field_value END AS field_value FROM fields"""


def _inputs(i):
    fields = i.fixture("fields").select(
        "doc_id", F.col("seq").cast("bigint").alias("seq"),
        F.when(F.col("seq") == 0, "id").otherwise(F.col("field_name")).alias("field_name"),
        F.when(F.col("seq") != 1, F.col("field_value")).alias("field_value"))
    docs = i.fixture("docs").select("doc_id", F.col("document_name").alias("name"))
    contents = i.sql("SELECT o_orderkey AS doc_id, CASE WHEN o_orderkey % 4 = 0 THEN '' ELSE 'Line ' || o_orderpriority || chr(10) || 'end' || chr(10) END AS content FROM {orders}")
    return docs, fields, contents


_CONTENT = "SELECT o_orderkey AS doc_id, 'Line ' || o_orderpriority AS first_line FROM orders WHERE o_orderkey % 4 <> 0"
_GRID = """one AS (SELECT doc_id, table_no, row_index, column_index, replace(arg_max(content, seq), chr(10), ' ') AS content FROM cells GROUP BY ALL),
    shape AS (SELECT doc_id, table_no, max(row_index) + 1 AS n_rows, max(column_index) + 1 AS n_columns FROM cells GROUP BY ALL),
    grid AS (SELECT s.doc_id, s.table_no, s.n_rows, s.n_columns, CAST(r.i AS INTEGER) AS row_index, CAST(c.i AS INTEGER) AS column_index
             FROM shape s, LATERAL (SELECT unnest(range(s.n_rows)) AS i) r, LATERAL (SELECT unnest(range(s.n_columns)) AS i) c),
    piped AS (SELECT g.doc_id, g.table_no, g.row_index, '| ' || string_agg(coalesce(o.content, ''), ' | ' ORDER BY g.column_index) || ' |' AS text
              FROM grid g LEFT JOIN one o USING (doc_id, table_no, row_index, column_index) GROUP BY ALL)"""


@query("r1_markdown_report", uses=("fields", "docs", "cells"), sql=f"""
    WITH f AS ({_REPORT_FIELDS}), c AS ({_CONTENT}), {_GRID},
    head AS (SELECT doc_id, unnest(['# ' || document_name, '', '## Extracted Fields', '']) AS text, unnest([0, 1, 2, 3]) AS line_no FROM docs)
    SELECT doc_id, 0 AS section, 0 AS block, line_no, text FROM head
    UNION ALL SELECT doc_id, 1, 0, CAST(seq AS INTEGER), '- **' || field_name || '**: ' || coalesce(field_value, '_null_') FROM f WHERE field_name NOT IN {HIDDEN}
    UNION ALL SELECT doc_id, 2, 0, unnest([0, 1, 2, 3, 4]), unnest(['', '---', '', '## Tables', '']) FROM (SELECT DISTINCT doc_id FROM shape) AS t
    UNION ALL SELECT doc_id, 3, table_no, unnest([-2, -1, 2147483647]), unnest(['### Table ' || (table_no + 1) || ' (' || n_rows || 'r × ' || n_columns || 'c)', '', '']) FROM shape
    UNION ALL SELECT doc_id, 3, table_no, CASE WHEN row_index = 0 THEN 0 ELSE row_index + 1 END, text FROM piped
    UNION ALL SELECT doc_id, 3, table_no, 1, '|' || repeat(' --- |', n_columns) FROM shape
    UNION ALL SELECT doc_id, 4, 0, unnest([0, 1, 2, 3, 4, 5]), unnest(['', '---', '', '## Full Document Text', '', '```']) FROM c
    UNION ALL SELECT doc_id, 5, 0, unnest([0, 1]), unnest([first_line, 'end']) FROM c
    UNION ALL SELECT doc_id, 6, 0, 0, '```' FROM c""")
def _(i):
    docs, fields, contents = _inputs(i)
    return reports.markdown_report(docs, fields, i.fixture("cells"), contents)


@query("r2_text_report", uses=("fields", "docs"), sql=f"""
    WITH f AS ({_REPORT_FIELDS}), c AS ({_CONTENT})
    SELECT doc_id, 0 AS section, 0 AS block, unnest([0, 1, 2]) AS line_no, unnest([repeat('=', 60), 'EXTRACTED FIELDS', repeat('=', 60)]) AS text FROM docs
    UNION ALL SELECT doc_id, 1, 0, CAST(seq AS INTEGER), rpad(field_name, 45, ' ') || ': ' || coalesce(field_value, '') FROM f WHERE field_name NOT IN {HIDDEN}
    UNION ALL SELECT doc_id, 4, 0, unnest([0, 1, 2, 3, 4]), unnest(['', repeat('=', 60), 'FULL DOCUMENT TEXT', repeat('=', 60), '']) FROM c
    UNION ALL SELECT doc_id, 5, 0, unnest([0, 1, 2]), unnest([first_line, 'end', '']) FROM c""")
def _(i):
    docs, fields, contents = _inputs(i)
    return reports.text_report(fields, docs, contents)


@query("r2_text_report_parts", uses=("fields", "docs"), sql=f"""
    WITH f AS ({_REPORT_FIELDS})
    SELECT doc_id, 0 AS section, unnest([0, 1, 2]) AS line_no, unnest([repeat('=', 60), 'EXTRACTED FIELDS', repeat('=', 60)]) || chr(10) AS text FROM docs
    UNION ALL SELECT doc_id, 1, CAST(seq AS INTEGER), rpad(field_name, 45, ' ') || ': ' || coalesce(field_value, '') || chr(10)
    FROM f WHERE field_name NOT IN {HIDDEN}""")
def _(i):
    docs, fields, _c = _inputs(i)
    return reports.assemble(reports.text_report(fields, docs)).select("doc_id", "section", "line_no", "text")


_RESULTS = """SELECT o_orderkey AS doc_id, CASE o_orderkey % 3 WHEN 0 THEN 'invoice' WHEN 1 THEN 'pan' ELSE NULL END AS document_type,
    CASE o_orderstatus WHEN 'F' THEN true WHEN 'O' THEN false ELSE NULL END AS is_valid,
    CASE WHEN o_custkey % 7 = 0 THEN 'cannot read ' || CAST(o_orderkey AS STRING) ELSE NULL END AS error,
    CASE WHEN o_custkey % 7 = 0 THEN 'failed' WHEN o_custkey % 11 = 0 THEN 'skipped' ELSE 'processed' END AS status FROM {orders}"""
_RESULTS_SQL = _RESULTS.replace("{orders}", "orders")


@query("g4_extraction_summary", sql=f"""
    SELECT document_type, count(*) AS total, count(*) FILTER (is_valid) AS valid, count(*) FILTER (NOT is_valid) AS invalid
    FROM (SELECT coalesce(document_type, 'unknown') AS document_type, coalesce(is_valid, FALSE) AS is_valid FROM ({_RESULTS_SQL}) AS r) AS q
    GROUP BY GROUPING SETS ((), (document_type))""")
def _(i):
    return reports.extraction_summary(i.sql(_RESULTS))


@query("g5_run_summary", sql=f"""
    SELECT coalesce(document_type, 'all') AS document_type, processed, failed FROM (
        SELECT document_type, count(*) FILTER (error IS NULL) AS processed, count(*) FILTER (error IS NOT NULL) AS failed
        FROM ({_RESULTS_SQL.replace("ELSE NULL END AS document_type", "ELSE 'other' END AS document_type")}) AS r GROUP BY GROUPING SETS ((), (document_type))) AS q""")
def _(i):
    named = i.sql(_RESULTS).withColumn("document_type", F.coalesce("document_type", F.lit("other")))
    return reports.run_summary(named).withColumn("document_type", F.coalesce("document_type", F.lit("all")))


@query("w4_first_errors", sql=f"""
    SELECT doc_id, error FROM ({_RESULTS_SQL}) AS r WHERE error IS NOT NULL ORDER BY doc_id LIMIT 10""")
def _(i):
    return reports.first_errors(i.sql(_RESULTS), ["doc_id"]).select("doc_id", "error")


@query("g5_more_errors", sql=f"""
    SELECT greatest(count(error) - 10, 0) AS more FROM ({_RESULTS_SQL}) AS r""")
def _(i):
    return reports.more_errors(i.sql(_RESULTS))


@query("g6_batch_counts", sql=f"""
    SELECT count(*) FILTER (status = 'processed') AS processed, count(*) FILTER (status = 'failed') AS failed,
           count(*) FILTER (status = 'skipped') AS skipped FROM ({_RESULTS_SQL}) AS r""")
def _(i):
    return reports.batch_counts(i.sql(_RESULTS))


@query("u2_collect_type_results", sql=f"""
    SELECT count(*) FILTER (error IS NULL) AS processed, count(*) FILTER (error IS NOT NULL) AS failed FROM ({_RESULTS_SQL}) AS r""")
def _(i):
    per_type = reports.run_summary(i.sql(_RESULTS).withColumn("document_type", F.coalesce("document_type", F.lit("?"))))
    return per_type.where(F.col("document_type").isNotNull()).agg(
        F.sum("processed").cast("bigint").alias("processed"), F.sum("failed").cast("bigint").alias("failed"))
