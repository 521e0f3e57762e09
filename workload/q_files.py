"""Listings, names, reads and writes.

Reads and writes go through a fresh folder below the session's shared folder:
the data is written from the driver tables, read back and compared.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from fieldloom import rules
from fieldloom.operators import reports, routing, store
from fieldloom.session import run_dir
from fieldloom.sources import files, sinks
from workload.base import query, values
from workload.fixtures import FOLDERS
from workload.q_checks import paise

_EXT = r"lower(regexp_extract(string_split(path, '/')[-1], '^\.*[^.].*(\.[^.]*)$', 1))"


@query("s1_input_folder_scan", uses="input_files", sql="""
    WITH p AS (SELECT path, string_split(substr(path, length('file:/data/Input/') + 1), '/') AS parts FROM input_files),
    d AS (SELECT parts[1] AS folder, bool_or(parts[2] = 'files' AND len(parts) >= 3) AS has_files FROM p WHERE len(parts) >= 2 GROUP BY 1)
    SELECT path, lower(folder) AS document_type, regexp_replace(parts[-1], '\\.[^.]*$', '') AS document_name FROM p JOIN d ON d.folder = parts[1]
    WHERE lower(path) LIKE '%.pdf' AND CASE WHEN has_files THEN parts[2] = 'files' AND len(parts) = 3 ELSE len(parts) = 2 END""")
def _(i):
    return files.input_documents(i.fixture("input_files").select("path"), "file:/data/Input")


@query("s2_find_by_extension", uses="files", sql=f"""
    SELECT doc_id, path FROM files WHERE {_EXT} IN ('.pdf', '.tiff')""")
def _(i):
    return files.with_extension(i.fixture("files").select("doc_id", "path"), [".PDF", ".tiff"])


@query("s2_list_table_files", sql="""
    SELECT o_orderstatus AS folder, '.json' AS kind, CAST(sum(length('{"o_orderkey":' || o_orderkey || '}') + 1) AS BIGINT) AS bytes, count(*) AS n_rows
    FROM orders GROUP BY 1""")
def _(i):
    target = run_dir(i.spark, "s2")
    i.table("orders").select("o_orderstatus", "o_orderkey").write.partitionBy("o_orderstatus").json(target)
    found = files.find_by_extension(i.spark, target, [".JSON"])
    folder = F.regexp_extract("path", "o_orderstatus=([^/]*)/", 1)
    # every listed file is read again by its path
    sizes = found.where("length > 0").select("path", folder.alias("folder"), files.extension(F.col("path")).alias("kind"), "length")
    lines = i.spark.read.text(target).groupBy(F.col("_metadata.file_path").alias("of")).agg(F.count(F.lit(1)).alias("n"))
    plain = lambda c: F.regexp_replace(c, "^file:/*", "/")
    return sizes.join(lines, plain(F.col("path")) == plain(F.col("of"))).groupBy("folder", "kind").agg(
        F.sum("length").alias("bytes"), F.sum("n").alias("n_rows"))


@query("s3_file_name_parts", uses="files", sql=f"""
    SELECT doc_id, name, ext, substr(name, 1, length(name) - length(ext)) AS stem
    FROM (SELECT doc_id, string_split(path, '/')[-1] AS name, {_EXT} AS ext FROM files) AS q""")
def _(i):
    c = F.col("path")
    return i.fixture("files").select(
        "doc_id", files.file_name(c).alias("name"), files.extension(c).alias("ext"), files.stem(c).alias("stem"))


@query("s4_file_kind", uses="files", sql=f"""
    SELECT doc_id, CASE WHEN {_EXT} IN ('.png', '.jpg', '.jpeg', '.bmp', '.tiff', '.tif', '.webp', '.gif') THEN 'image'
                        WHEN {_EXT} = '.pdf' THEN 'pdf' ELSE 'unsupported' END AS kind FROM files""")
def _(i):
    return i.fixture("files").select("doc_id", files.file_kind(F.col("path")).alias("kind"))


@query("s12_archive_walk", uses="files", sql=f"""
    SELECT path, folder, kind AS document_type, CASE WHEN kind IS NULL OR ext NOT IN ('.png', '.jpg', '.jpeg', '.bmp', '.tiff', '.tif', '.webp', '.gif', '.pdf')
           THEN 'skipped' ELSE 'ready' END AS status
    FROM (SELECT path, string_split(path, '/')[-2] AS folder, {_EXT} AS ext FROM files) f LEFT JOIN {values(FOLDERS, 't(name, kind)')} ON t.name = f.folder""")
def _(i):
    return files.archive_documents(i.fixture("files").select("path"), "file:/data/Documents").drop("kind")


@query("s11_numbered_names", sql="""
    SELECT c_name AS name, 'Agmt_' || CASE WHEN n < 10 THEN '0' || n ELSE CAST(n AS VARCHAR) END || '.pdf' AS new_name
    FROM (SELECT c_name, row_number() OVER (ORDER BY c_name) AS n FROM customer) AS q""")
def _(i):
    return files.numbered_names(i.table("customer").select(F.col("c_name").alias("name")))


# --- reads ---------------------------------------------------------------------------------------

_SAVED = """SELECT o_orderkey AS doc_id, 'doc-' || CAST(o_orderkey AS STRING) AS document_name,
    CASE o_orderkey % 2 WHEN 0 THEN 'invoice' ELSE 'pan' END AS document_type,
    '{{"total":' || CAST(o_custkey AS STRING) || ',"status":"' || o_orderstatus || '"}}' AS value FROM {orders}"""


@query("s6_first_available", sql="""
    SELECT 'doc-' || o_orderkey AS name, CASE WHEN o_custkey % 3 = 0 THEN 'raw ' || o_orderkey WHEN o_custkey % 3 = 1 THEN 'text ' || o_orderkey END AS body,
           CASE WHEN o_custkey % 3 = 0 THEN 0 WHEN o_custkey % 3 = 1 THEN 1 END AS source_no,
           CASE WHEN o_custkey % 3 = 2 THEN 'Extracted data not found for doc-' || o_orderkey END AS error FROM orders""")
def _(i):
    source = lambda name, rest: i.sql(
        f"SELECT 'doc-' || CAST(o_orderkey AS STRING) AS name, '{name} ' || CAST(o_orderkey AS STRING) AS body FROM {{orders}} WHERE o_custkey % 3 <= {rest}")
    raw = source("raw", 0)
    names = i.sql("SELECT 'doc-' || CAST(o_orderkey AS STRING) AS name FROM {orders}")
    return files.first_available(names, raw, source("text", 1))


@query("s7_saved_record_lookup", sql="""
    SELECT 'doc-' || o_orderkey AS name, o_orderkey % 2 <> 0 OR o_custkey % 5 = 0 AS found, CASE WHEN o_orderkey % 2 <> 0 THEN 'raw' WHEN o_custkey % 5 = 0 THEN 'type' END AS body
    FROM orders""")
def _(i):
    names = i.sql("SELECT 'doc-' || CAST(o_orderkey AS STRING) AS name FROM {orders}")
    raw = i.sql("SELECT 'doc-' || CAST(o_orderkey AS STRING) AS name, 'raw' AS body FROM {orders} WHERE o_orderkey % 2 <> 0")
    typed = i.sql("SELECT 'doc-' || CAST(o_orderkey AS STRING) AS name, 'type' AS body FROM {orders} WHERE o_custkey % 5 = 0")
    return files.first_available(names, raw, typed).select("name", F.col("error").isNull().alias("found"), "body")


_PAN_SAVED = """SELECT o_orderkey AS doc_id, 'doc-' || CAST(o_orderkey AS STRING) AS document_name, 'pan' AS document_type,
    '{{"pan_number":"' || CASE WHEN o_custkey % 3 = 0 THEN 'bad' ELSE 'ABCDE1234F' END || '"' || CASE WHEN o_custkey % 5 = 0 THEN '' ELSE ',"name":" P "' END || '}}' AS value FROM {orders}"""


@query("s13_saved_records_again", sql=f"""
    SELECT doc_id, bad * 2 + missing + {len([f for f in rules.REQUIRED_FIELDS['pan'] if f not in ('pan_number', 'name')])} AS n_errors,
           bad * 2 + missing + {len([f for f in rules.REQUIRED_FIELDS['pan'] if f not in ('pan_number', 'name')])} = 0 AS is_valid
    FROM (SELECT o_orderkey AS doc_id, CAST(o_custkey % 3 = 0 AS INTEGER) AS bad, CAST(o_custkey % 5 = 0 AS INTEGER) AS missing FROM orders) AS q""")
def _(i):
    target = run_dir(i.spark, "s13")
    i.sql(_PAN_SAVED).write.partitionBy("document_type").json(target)
    saved = files.read_json_lines(i.spark, target, "doc_id bigint, document_name string, value string, document_type string")
    fields = routing.flatten_json(saved, "value").select(
        "doc_id", F.lit(0).cast("bigint").alias("seq"), F.col("path").alias("field_name"), F.col("value").alias("field_value"), F.lit("str").alias("value_type"))
    verdicts = store.reprocess(saved.select("doc_id", "document_type"), fields)[2]
    sinks.write_version({"verdicts": verdicts}, target + "-verdicts", 0)
    return sinks.read_version(i.spark, target + "-verdicts", ("verdicts",))["verdicts"].select("doc_id", "n_errors", "is_valid")


@query("s5_json_documents", sql="""
    SELECT CASE WHEN page_id % 5 = 0 THEN NULL ELSE url END AS url, CASE WHEN page_id % 5 = 0 THEN NULL ELSE length(html) END AS n_chars,
           page_id % 5 = 0 AS unreadable FROM pages""")
def _(i):
    # one JSON document per line, every fifth one cut short
    target = run_dir(i.spark, "s5")
    body = F.to_json(F.struct("url", F.col("html")))
    i.table("pages").select(
        F.when(F.col("page_id") % 5 == 0, F.substring(body, F.lit(1), F.length(body) - 1)).otherwise(body).alias("value")
    ).write.text(target)
    read = files.read_json_lines(i.spark, target, "url string, html string")
    broken = F.col("_corrupt_record").isNotNull()
    return read.select(
        F.when(~broken, F.col("url")).alias("url"), F.when(~broken, F.length("html")).cast("bigint").alias("n_chars"),
        broken.alias("unreadable"))


# --- writes ---------------------------------------------------------------------------------------

@query("k1_save_records", sql="""
    SELECT target, document_type, 'doc-' || o_orderkey AS document_name, o_custkey AS total, o_orderstatus = 'F' AS is_valid,
           CASE WHEN o_orderstatus = 'F' THEN 0 ELSE 1 END AS n_errors
    FROM (SELECT *, CASE o_orderkey % 2 WHEN 0 THEN 'invoice' ELSE 'pan' END AS document_type FROM orders) AS o, (VALUES ('extracted'), ('raw')) AS t(target)""")
def _(i):
    base = run_dir(i.spark, "k1")
    rows = i.sql(_SAVED.replace("FROM {orders}", ", o_orderstatus FROM {orders}"))
    valid = F.col("o_orderstatus") == "F"
    errors = F.when(valid, F.array().cast("array<string>")).otherwise(F.array(F.lit("Missing required field: name")))
    records = rows.select("document_type", "document_name", sinks.verdict_json(F.col("value"), valid, errors).alias("value"))
    sinks.write_records(records, f"{base}/extracted", f"{base}/raw")
    out = None
    for target in ("extracted", "raw"):
        back = files.read_json_lines(i.spark, f"{base}/{target}", "document_name string, value string, document_type string")
        part = back.select(
            F.lit(target).alias("target"), "document_type", "document_name",
            F.get_json_object("value", "$.total").cast("bigint").alias("total"),
            (F.get_json_object("value", "$.validation.is_valid") == "true").alias("is_valid"),
            F.json_array_length(F.get_json_object("value", "$.validation.errors")).alias("n_errors"))
        out = part if out is None else out.unionByName(part)
    return out


@query("k2_text_write", sql="""
    SELECT unnest(string_split(text, chr(10))) AS value FROM benchmark""")
def _(i):
    target = run_dir(i.spark, "k2")
    lines = i.table("benchmark").select("item_id", F.posexplode(F.split("text", "\n")).alias("line_no", "text"))
    sinks.write_text(lines, target, ["item_id", "line_no"])
    return i.spark.read.text(target)


@query("k3_csv_write", sql="""
    SELECT CAST(c_custkey AS VARCHAR) AS c_custkey, c_name, c_mktsegment, 'a, "b"' AS note FROM customer""")
def _(i):
    target = run_dir(i.spark, "k3")
    sinks.write_csv(i.table("customer").select("c_custkey", "c_name", "c_mktsegment", F.lit('a, "b"').alias("note")), target)
    return i.spark.read.option("header", "true").option("escape", "\\").csv(target)


@query("k4_all_formats", sql="""
    SELECT 'json' AS format, count(*) AS n FROM orders UNION ALL SELECT 'csv', count(*) FROM orders UNION ALL SELECT 'raw', count(*) FROM orders
    UNION ALL SELECT 'md', count(*) * 5 FROM orders UNION ALL SELECT 'txt', count(*) * 4 FROM orders""")
def _(i):
    target = run_dir(i.spark, "k4")
    rows = i.sql(_SAVED)
    docs = rows.select("doc_id", F.col("document_name").alias("name"))
    fields = rows.select(
        "doc_id", F.lit(0).alias("seq"), F.lit("status").alias("field_name"), F.col("document_type").alias("field_value"))
    sinks.write_all_formats(
        rows.select("document_name", "value"), rows.drop("value"), reports.markdown_report(docs, fields),
        reports.text_report(fields, docs), rows.select("value"), target)
    count = lambda df, name: df.agg(F.lit(name).alias("format"), F.count(F.lit(1)).alias("n"))
    read = i.spark.read
    parts = [
        count(read.schema("document_name string, value string").json(f"{target}/json"), "json"),
        count(read.option("header", "true").csv(f"{target}/csv"), "csv"),
        count(read.schema("value string").json(f"{target}/raw"), "raw"),
        count(read.text(f"{target}/md"), "md"), count(read.text(f"{target}/txt"), "txt"),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@query("k12_output_names", uses="invoice", sql=r"""
    SELECT doc_id, CASE WHEN n = 1 THEN b || '.pdf' ELSE b || '_' || (n - 1) || '.pdf' END AS new_name FROM (
        SELECT doc_id, b, row_number() OVER (PARTITION BY b ORDER BY doc_id) AS n FROM (
            SELECT doc_id, regexp_replace(regexp_replace(Invoice_No, '[<>:"/\\|?*]', '_', 'g'), '\s+', '_', 'g') AS b FROM invoice) AS a) AS c""")
def _(i):
    docs = i.fixture("invoice").select("doc_id", "Invoice_No", F.lit("own.pdf").alias("file_name"))
    return sinks.output_names(docs, ["doc_id"]).select("doc_id", "new_name")


@query("k13_fixed_point_json", sql="""
    SELECT l_orderkey, l_linenumber, l_partkey, CAST(round(l_extendedprice * 100) AS BIGINT) AS price, CAST(round(l_tax * 100) AS BIGINT) AS tax, FALSE AS exponent FROM lineitem""")
def _(i):
    nested = i.table("lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey",
        F.struct((F.col("l_extendedprice") * 1e6).alias("big"), F.array("l_tax", "l_extendedprice").alias("list")).alias("v"))
    json = F.to_json("v")
    fixed = sinks.fixed_point(nested).select("l_orderkey", "l_linenumber", "l_partkey", json.alias("j"), "v")
    return fixed.select(
        "l_orderkey", "l_linenumber", "l_partkey", paise(F.get("v.list", F.lit(1))).alias("price"),
        paise(F.get("v.list", F.lit(0))).alias("tax"), F.col("j").rlike("[0-9][eE]").alias("exponent"))
