"""The three-table store, its queries, maintenance and upserts."""

from __future__ import annotations

from pyspark.sql import functions as F

from fieldloom.operators import routing, store, validate
from fieldloom.session import run_dir, written
from fieldloom.sources import sinks, versions
from workload.base import query
from workload.q_checks import OK_SQL, TRUTHY_SQL, paise
from workload.q_routing import CATALOG_SQL, ERRORS_SQL, fields_sql

_CLEAN = f"SELECT doc_id, seq, field_name, trim(field_value) AS field_value, value_type FROM ({fields_sql('kv_all', 'k.document_type')}) AS f"
_USES = ("kv_all", "docs")


def _fields(i):
    return validate.sanitize(routing.route_fields(i.fixture("kv_all"), F.col("document_type")))


@query("d1_field_rows", uses="fields", sql=f"""
    SELECT doc_id AS document_id, seq, field_name, CASE WHEN {TRUTHY_SQL} THEN field_value END AS field_value, value_type AS field_type,
           0 AS is_required, 1 AS is_valid, CAST(NULL AS TIMESTAMP) AS created_at FROM fields WHERE field_name NOT IN ('document_type', 'source_file', 'validation')""")
def _(i):
    return store.field_rows(i.fixture("fields")).drop("id")


@query("d1_field_rows_flagged", uses=_USES, sql=f"""
    WITH clean AS ({_CLEAN})
    SELECT doc_id AS document_id, field_name, CAST(EXISTS (SELECT 1 FROM {CATALOG_SQL} WHERE c.document_type = d.document_type
           AND c.field_name = clean.field_name AND required) AS INTEGER) AS is_required, CAST({OK_SQL.replace('field_name', 'clean.field_name')} AS INTEGER) AS is_valid
    FROM clean JOIN docs d USING (doc_id)""")
def _(i):
    return store.field_rows(_fields(i), i.fixture("docs")).select("document_id", "field_name", "is_required", "is_valid")


@query("j7_stored_fields", uses="fields", sql="""
    SELECT doc_id, seq, field_name FROM fields WHERE field_name NOT IN ('document_type', 'source_file', 'validation')""")
def _(i):
    return store.stored_fields(i.fixture("fields")).select("doc_id", "seq", "field_name")


def _record_sql(source: str) -> str:
    """The JSON text of a record: fields in order, typed values as they are, all else quoted."""
    return f"""SELECT doc_id, '{{' || string_agg(CAST(to_json(field_name) AS VARCHAR) || ':' || CASE WHEN field_value IS NULL THEN 'null'
        WHEN value_type = 'bool' THEN lower(field_value) WHEN value_type IN ('int', 'list', 'dict') THEN field_value
        ELSE CAST(to_json(field_value) AS VARCHAR) END, ',' ORDER BY seq, field_name) || '}}' AS record FROM {source} GROUP BY doc_id"""


@query("g10_record_json", uses="fields", sql=_record_sql("fields"))
def _(i):
    return store.record_json(i.fixture("fields"))


@query("d2_document_rows", uses=_USES, sql=f"""
    WITH clean AS ({_CLEAN}), e AS (SELECT DISTINCT doc_id FROM ({ERRORS_SQL}) AS x), r AS ({_record_sql('clean')})
    SELECT d.doc_id AS id, document_name, document_type, file_path, created_at, created_at AS updated_at, 'completed' AS extraction_status,
           CASE WHEN e.doc_id IS NULL THEN 'valid' ELSE 'invalid' END AS validation_status, CAST(NULL AS VARCHAR) AS raw_data,
           coalesce(record, '{{}}') AS extracted_data
    FROM docs d LEFT JOIN e ON e.doc_id = d.doc_id LEFT JOIN r ON r.doc_id = d.doc_id""")
def _(i):
    # the record and the verdict both read them
    fields, docs = written(_fields(i), "fields"), i.fixture("docs")
    return store.document_rows(docs, store.record_json(fields), validate.verdicts(docs, fields))


@query("d3_error_rows", uses=_USES, sql=f"""
    WITH clean AS ({_CLEAN}) SELECT e.doc_id AS document_id, phase, seq, message AS error_message, field_name, created_at
    FROM ({ERRORS_SQL}) AS e JOIN docs d ON d.doc_id = e.doc_id""")
def _(i):
    docs = i.fixture("docs")
    return store.error_rows(validate.record_errors(docs, _fields(i)), docs).drop("id")


_DOCS_SQL = """SELECT o_orderkey AS id, 'doc-' || CAST(o_custkey AS STRING) AS document_name,
    CASE o_orderkey % 4 WHEN 0 THEN 'agreement' WHEN 1 THEN 'invoice' WHEN 2 THEN 'pan' ELSE 'aadhaar' END AS document_type,
    o_orderdate AS created_at, o_orderdate AS updated_at, CASE o_orderstatus WHEN 'F' THEN 'valid' ELSE 'invalid' END AS validation_status,
    CAST(o_totalprice AS STRING) AS extracted_data FROM {orders}"""


def _documents(i):
    return i.sql(_DOCS_SQL)


def _store(i) -> store.Store:
    """Orders as documents, line items as their fields, returns as their errors."""
    extractions = i.sql("""SELECT l_orderkey AS document_id, l_linenumber * 100000000000 + l_partkey * 1000000 + l_suppkey * 100 + CAST(l_quantity AS BIGINT) AS seq,
        'part_' || CAST(l_partkey AS STRING) AS field_name, l_linestatus AS field_value FROM {lineitem}""")
    errors = i.sql("""SELECT l_orderkey AS document_id, 2 AS phase, l_linenumber * 100000000000 + l_partkey * 1000000 + l_suppkey * 100 + CAST(l_quantity AS BIGINT) AS seq,
        'Invalid format for field: part_' || CAST(l_partkey AS STRING) AS error_message FROM {lineitem} WHERE l_returnflag = 'R'""")
    return store.Store(_documents(i), extractions, errors)


_SEQ = "l_linenumber * 100000000000 + l_partkey * 1000000 + l_suppkey * 100 + CAST(l_quantity AS BIGINT)"


_LINES = f"""
    SELECT l_orderkey AS document_id, 1 AS kind, 0 AS phase, {_SEQ} AS seq, 'part_' || l_partkey AS name, l_linestatus AS value FROM lineitem
    UNION ALL SELECT l_orderkey, 2, 2, {_SEQ}, NULL, 'Invalid format for field: part_' || l_partkey FROM lineitem WHERE l_returnflag = 'R'"""


@query("j1_nested_children", sql=_LINES)
def _(i):
    lines = store.export_lines(_store(i)).where("kind > 0")
    at = lambda key: F.get_json_object("json", f"$.{key}")
    return lines.select(
        "document_id", "kind", "phase", "seq", at("field_name").alias("name"),
        F.coalesce(at("field_value"), at("error_message")).alias("value"))


@query("d6_nested_export_json", sql=f"""
    SELECT document_id, kind, phase, seq, CASE kind
        WHEN 1 THEN '{{"document_id":' || document_id || ',"seq":' || seq || ',"field_name":"' || name || '","field_value":"' || value || '"}}'
        ELSE '{{"document_id":' || document_id || ',"phase":2,"seq":' || seq || ',"error_message":"' || value || '"}}' END AS json FROM ({_LINES}) AS l
    UNION ALL SELECT o_orderkey, 0, 0, 0, '{{"id":' || o_orderkey || ',"document_name":"doc-' || o_custkey || '","validation_status":"'
        || CASE o_orderstatus WHEN 'F' THEN 'valid' ELSE 'invalid' END || '"}}' FROM orders""")
def _(i):
    whole = _store(i)
    short = store.Store(whole.documents.select("id", "document_name", "validation_status"), whole.extractions, whole.errors)
    target = run_dir(i.spark, "d6")
    store.export_lines(short).write.option("compression", "gzip").json(target)
    return i.spark.read.schema("document_id bigint, kind int, phase int, seq bigint, json string").json(target)


def _changed(i) -> store.Store:
    """Re-extracted documents: every order of a customer with debt, and unknown ids."""
    docs = i.sql("""SELECT o_orderkey AS id, 'new' AS extracted_data, 'valid' AS validation_status, o_orderdate + INTERVAL 1 DAY AS updated_at
        FROM {orders} JOIN {customer} ON c_custkey = o_custkey AND c_acctbal < 0
        UNION ALL SELECT -1 - o_orderkey AS id, 'x' AS extracted_data, 'valid' AS validation_status, o_orderdate AS updated_at FROM {orders}""")
    fields = docs.select(
        F.col("id").alias("document_id"), F.lit(0).cast("bigint").alias("seq"), F.lit("fresh").alias("field_name"),
        F.lit("1").alias("field_value"))
    errors = docs.select(
        F.col("id").alias("document_id"), F.lit(1).alias("phase"), F.lit(0).cast("bigint").alias("seq"),
        F.lit("checked again").alias("error_message"))
    # every document is re-extracted twice on the same day; the second result, the larger data, counts
    twice = docs.unionByName(docs.withColumn("extracted_data", F.lit("first")))
    return store.Store(twice, fields.unionByName(fields), errors)


def _created(i, name: str) -> str:
    """The store written in buckets of the document's id."""
    target = run_dir(i.spark, name)
    s = _store(i)
    versions.create(i.spark, target, {"documents": s.documents, "extractions": s.extractions, "errors": s.errors}, versions.STORE)
    return target


def _replaced(i, name: str) -> store.Store:
    """The store written, its changed documents committed as a delta, and read back."""
    target = _created(i, name)
    changed = _changed(i)
    versions.change(i.spark, target, versions.STORE, lambda tables: store.replacement(tables, changed))
    return store.Store(**versions.read(i.spark, target, versions.STORE))


_DEBT = "SELECT o_orderkey FROM orders JOIN customer ON c_custkey = o_custkey AND c_acctbal < 0"


@query("d4_replace_documents", sql=f"""
    SELECT o_orderkey AS id, o_orderdate AS created_at, CASE WHEN hit THEN o_orderdate + INTERVAL 1 DAY ELSE o_orderdate END AS updated_at,
           CASE WHEN hit THEN 'valid' WHEN o_orderstatus = 'F' THEN 'valid' ELSE 'invalid' END AS validation_status, hit AS changed
    FROM (SELECT *, o_orderkey IN ({_DEBT}) AS hit FROM orders) AS q""")
def _(i):
    new = _replaced(i, "d4")
    return new.documents.select(
        "id", "created_at", "updated_at", "validation_status", (F.col("extracted_data") == "new").alias("changed"))


@query("d4_replace_children", sql=f"""
    SELECT l_orderkey AS document_id, 'part_' || l_partkey AS field_name FROM lineitem WHERE l_orderkey NOT IN ({_DEBT})
    UNION ALL SELECT o_orderkey, 'fresh' FROM ({_DEBT}) AS d""")
def _(i):
    return _replaced(i, "d4").extractions.select("document_id", "field_name")


@query("j9_update_by_key", sql=f"""
    SELECT l_orderkey AS document_id, 2 AS phase, {_SEQ} AS seq, 'Invalid format for field: part_' || l_partkey AS error_message
    FROM lineitem WHERE l_returnflag = 'R' AND l_orderkey NOT IN ({_DEBT})
    UNION ALL SELECT o_orderkey, 1, 0, 'checked again' FROM ({_DEBT}) AS d""")
def _(i):
    return _replaced(i, "j9").errors.select("document_id", "phase", "seq", "error_message")


@query("d5_cascade_delete", sql=f"""
    SELECT 'documents' AS tab, o_orderkey AS document_id, 'doc-' || o_custkey AS name FROM orders WHERE o_orderkey NOT IN ({_DEBT})
    UNION ALL SELECT 'extractions', l_orderkey, 'part_' || l_partkey FROM lineitem WHERE l_orderkey NOT IN ({_DEBT})
    UNION ALL SELECT 'errors', l_orderkey, 'Invalid format for field: part_' || l_partkey
    FROM lineitem WHERE l_returnflag = 'R' AND l_orderkey NOT IN ({_DEBT})""")
def _(i):
    ids = i.sql("SELECT o_orderkey AS id FROM {orders} JOIN {customer} ON c_custkey = o_custkey AND c_acctbal < 0")
    target = _created(i, "d5")
    versions.change(i.spark, target, versions.STORE, lambda tables: store.deletion(tables, ids))
    left = store.Store(**versions.read(i.spark, target, versions.STORE))
    row = lambda df, tab, key, name: df.select(F.lit(tab).alias("tab"), F.col(key).alias("document_id"), F.col(name).alias("name"))
    return row(left.documents, "documents", "id", "document_name").unionByName(
        row(left.extractions, "extractions", "document_id", "field_name")).unionByName(
        row(left.errors, "errors", "document_id", "error_message"))


@query("d7_revalidate_store", uses=_USES, sql=f"""
    WITH fresh AS (SELECT o_orderkey AS doc_id FROM orders WHERE o_orderstatus = 'P'),
    raw AS ({fields_sql('kv_all', 'k.document_type')}),
    clean AS (SELECT doc_id, seq, field_name, trim(field_value) AS field_value, value_type FROM raw WHERE doc_id NOT IN (SELECT doc_id FROM fresh)
              UNION ALL SELECT doc_id, 0, 'name', 'Fresh', 'str' FROM fresh)
    SELECT doc_id, coalesce(n, 0) AS n_errors, n IS NULL AS is_valid FROM docs
    LEFT JOIN (SELECT doc_id, count(*) AS n FROM ({ERRORS_SQL}) AS e GROUP BY doc_id) AS c USING (doc_id)""")
def _(i):
    stored = routing.route_fields(i.fixture("kv_all"), F.col("document_type"))
    fresh = i.sql("""SELECT o_orderkey AS doc_id, CAST(0 AS BIGINT) AS seq, 'name' AS field_name, ' Fresh ' AS field_value, 'str' AS value_type
        FROM {orders} WHERE o_orderstatus = 'P'""")
    return store.reprocess(i.fixture("docs"), stored, fresh)[2].select("doc_id", "n_errors", "is_valid")


@query("k7_save_document", uses=_USES, sql=f"""
    WITH clean AS ({_CLEAN}), r AS ({_record_sql('clean')})
    SELECT 'documents' AS tab, d.doc_id AS document_id, CAST(0 AS BIGINT) AS seq, document_name AS name, coalesce(record, '{{}}') AS value, created_at
    FROM docs d LEFT JOIN r ON r.doc_id = d.doc_id
    UNION ALL SELECT 'extractions', c.doc_id, seq, field_name, CASE WHEN {TRUTHY_SQL} THEN field_value END, created_at FROM clean c JOIN docs d ON d.doc_id = c.doc_id
    UNION ALL SELECT 'errors', e.doc_id, seq, field_name, message, created_at FROM ({ERRORS_SQL}) AS e JOIN docs d ON d.doc_id = e.doc_id""")
def _(i):
    target = run_dir(i.spark, "k7")
    sinks.save_store(store.save_documents(i.fixture("docs"), _fields(i)), target)
    s = sinks.read_store(i.spark, target)
    row = lambda df, tab, key, seq, name, value: df.select(
        F.lit(tab).alias("tab"), F.col(key).alias("document_id"), seq.cast("bigint").alias("seq"), F.col(name).alias("name"),
        F.col(value).alias("value"), "created_at")
    return row(s.documents, "documents", "id", F.lit(0), "document_name", "extracted_data").unionByName(
        row(s.extractions, "extractions", "document_id", F.col("seq"), "field_name", "field_value")).unionByName(
        row(s.errors, "errors", "document_id", F.col("seq"), "field_name", "error_message"))


# --- queries over the store ---------------------------------------------------------------------

@query("w1_latest_by_name", sql="""
    SELECT 'doc-' || o_custkey AS document_name, o_orderkey AS id, o_orderdate AS created_at FROM orders
    QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1""")
def _(i):
    return store.latest_by_name(_documents(i)).select("document_name", "id", "created_at")


@query("w2_documents_by_type", sql="""
    SELECT o_orderkey AS id, o_orderdate AS created_at FROM orders WHERE o_orderkey % 4 = 1 ORDER BY o_orderdate DESC, o_orderkey DESC""")
def _(i):
    # the type is a folder of the bucketed documents
    documents = versions.read(i.spark, _created(i, "w2"), versions.STORE)["documents"]
    return store.by_type(documents, "invoice").select("id", "created_at")


@query("w3_document_by_id", sql="""
    SELECT 'document' AS what, o_orderkey AS id, 1 AS n FROM orders WHERE o_orderkey = 77
    UNION ALL SELECT 'fields', l_orderkey, count(*) FROM lineitem WHERE l_orderkey = 77 GROUP BY 2
    UNION ALL SELECT 'errors', l_orderkey, count(*) FROM lineitem WHERE l_orderkey = 77 AND l_returnflag = 'R' GROUP BY 2""")
def _(i):
    # one bucket of each table is opened
    s = store.Store(**versions.read(i.spark, _created(i, "w3"), versions.STORE, only=77))
    one = s.documents.select(F.lit("document").alias("what"), "id", F.lit(1).cast("bigint").alias("n"))
    kids = lambda t, what: t.groupBy(F.col("document_id").alias("id")).agg(
        F.count(F.lit(1)).alias("n")).select(F.lit(what).alias("what"), "id", "n")
    return one.unionByName(kids(s.extractions, "fields")).unionByName(kids(s.errors, "errors"))


_STATS = "SELECT *, CASE o_orderkey % 4 WHEN 0 THEN 'agreement' WHEN 1 THEN 'invoice' WHEN 2 THEN 'pan' ELSE 'aadhaar' END AS t, CASE o_orderstatus WHEN 'F' THEN 'valid' ELSE 'invalid' END AS s FROM orders"


def _stat(name, dimension, sql):
    @query(name, sql=sql)
    def _(i):
        return store.statistics(_documents(i)).where(F.col("dimension") == dimension).select("value", "n")


_stat("g1_total_documents", "total", "SELECT '' AS value, count(*) AS n FROM orders")
_stat("g2_documents_per_type", "document_type", f"SELECT t AS value, count(*) AS n FROM ({_STATS}) AS q GROUP BY t")
_stat("g3_documents_per_status", "validation_status", f"SELECT s AS value, count(*) AS n FROM ({_STATS}) AS q GROUP BY s")


@query("g1_counts_after_changes", sql=f"""
    WITH left_over AS (
        SELECT t, CASE WHEN o_orderkey IN ({_DEBT}) THEN 'valid' ELSE s END AS s FROM ({_STATS}) AS q WHERE o_orderstatus <> 'P')
    SELECT 'total' AS dimension, '' AS value, count(*) AS n FROM left_over
    UNION ALL SELECT 'document_type', t, count(*) FROM left_over GROUP BY t
    UNION ALL SELECT 'validation_status', s, count(*) FROM left_over GROUP BY s""")
def _(i):
    """Counters of the commits after a save, a replacement, a deletion and a compaction."""
    target = _created(i, "g1")
    changed, gone = _changed(i), i.sql("SELECT o_orderkey AS id FROM {orders} WHERE o_orderstatus = 'P'")
    versions.change(i.spark, target, versions.STORE, lambda tables: store.replacement(tables, changed))
    versions.compact(i.spark, target, versions.STORE)
    versions.change(i.spark, target, versions.STORE, lambda tables: store.deletion(tables, gone))
    return store.committed_statistics(i.spark, versions.statistics(i.spark, target, versions.STORE))


# --- wide-table upserts ----------------------------------------------------------------------------

def _target(i):
    return i.sql("""SELECT 'INV-' || CAST(o_orderkey AS STRING) AS Invoice_No, o_orderpriority AS Vendor_Name, CAST(o_totalprice AS DECIMAL(18,2)) AS TotalAmount,
        'Old bank' AS Bank_Name, CAST(NULL AS STRING) AS Bank_Payable_To, 'Old branch' AS Bank_Branch, '1' AS Bank_Account_No, 'HDFC0000001' AS Bank_IFSC_Code FROM {orders}""")


def _changes(i):
    return i.sql("""SELECT 'INV-' || CAST(o_orderkey AS STRING) AS Invoice_No, CASE WHEN o_custkey % 2 = 0 THEN '' ELSE 'New vendor' END AS Vendor_Name,
        CASE WHEN o_custkey % 3 = 0 THEN NULL ELSE CAST(1 AS DECIMAL(18,2)) END AS TotalAmount, CASE WHEN o_custkey % 5 = 0 THEN NULL ELSE 'New bank' END AS Bank_Name,
        'Payee' AS Bank_Payable_To, CAST(NULL AS STRING) AS Bank_Branch, '2' AS Bank_Account_No, CAST(NULL AS STRING) AS Bank_IFSC_Code, 'x' AS Extra, 2 AS change_no
        FROM {orders} WHERE o_orderstatus <> 'P'
        UNION ALL SELECT 'INV-' || CAST(o_orderkey AS STRING), 'First vendor', CAST(9 AS DECIMAL(18,2)), 'First bank', 'First payee', 'First branch', '9', 'X', 'y', 1
        FROM {orders} WHERE o_orderstatus <> 'P' AND o_custkey % 2 = 0""")


_INVOICES = versions.Layout({"invoices": "Invoice_No"})


def _updated(i, name: str, update):
    """The target written in buckets of its key, the rows that change committed as a delta, and read back."""
    target = run_dir(i.spark, name)
    versions.create(i.spark, target, {"invoices": _target(i)}, _INVOICES)
    changes = _changes(i)
    versions.change(i.spark, target, _INVOICES, lambda t: update("invoices", t["invoices"], changes, order=("change_no",)))
    return versions.read(i.spark, target, _INVOICES)["invoices"]


@query("k10_update_known_values", sql="""
    SELECT 'INV-' || o_orderkey AS Invoice_No, CASE WHEN u THEN CASE WHEN two THEN 'First vendor' ELSE 'New vendor' END ELSE o_orderpriority END AS Vendor_Name,
           CASE WHEN u AND o_custkey % 3 <> 0 THEN 100 WHEN u AND two THEN 900 ELSE CAST(round(o_totalprice * 100) AS BIGINT) END AS total,
           CASE WHEN u AND o_custkey % 5 <> 0 THEN 'New bank' WHEN u AND two THEN 'First bank' ELSE 'Old bank' END AS Bank_Name,
           CASE WHEN u THEN 'Payee' END AS Bank_Payable_To, CASE WHEN u AND two THEN 'First branch' ELSE 'Old branch' END AS Bank_Branch,
           CASE WHEN u THEN '2' ELSE '1' END AS Bank_Account_No, CASE WHEN u AND two THEN 'X' ELSE 'HDFC0000001' END AS Bank_IFSC_Code
    FROM (SELECT *, o_orderstatus <> 'P' AS u, o_custkey % 2 = 0 AS two FROM orders) AS q""")
def _(i):
    return _updated(i, "k10", store.known_value_change).select(
        "Invoice_No", "Vendor_Name", paise(F.col("TotalAmount")).alias("total"), "Bank_Name", "Bank_Payable_To", "Bank_Branch",
        "Bank_Account_No", "Bank_IFSC_Code")


@query("k11_update_bank_columns", sql="""
    SELECT 'INV-' || o_orderkey AS Invoice_No, o_orderpriority AS Vendor_Name, CASE WHEN u THEN CASE WHEN o_custkey % 5 = 0 THEN NULL ELSE 'New bank' END ELSE 'Old bank' END AS Bank_Name,
           CASE WHEN u THEN NULL ELSE 'Old branch' END AS Bank_Branch, CASE WHEN u THEN '2' ELSE '1' END AS Bank_Account_No, CASE WHEN u THEN NULL ELSE 'HDFC0000001' END AS Bank_IFSC_Code
    FROM (SELECT *, o_orderstatus <> 'P' AS u FROM orders) AS q""")
def _(i):
    return _updated(i, "k11", store.bank_column_change).select(
        "Invoice_No", "Vendor_Name", "Bank_Name", "Bank_Branch", "Bank_Account_No", "Bank_IFSC_Code")


@query("k8_matching_columns", sql="""
    SELECT 'INV-' || o_orderkey AS Invoice_No, CASE WHEN o_custkey % 2 <> 0 THEN 'New vendor' END AS Vendor_Name, 'Payee' AS Bank_Payable_To
    FROM orders WHERE o_orderstatus <> 'P'
    UNION ALL SELECT 'INV-' || o_orderkey, 'First vendor', 'First payee' FROM orders WHERE o_orderstatus <> 'P' AND o_custkey % 2 = 0""")
def _(i):
    return store.insertable(_changes(i), ["Invoice_No", "Vendor_Name", "Bank_Payable_To", "Not_There"])


@query("u3_column_intersection", sql="""
    SELECT o_orderkey, o_totalprice FROM orders""")
def _(i):
    return store.insertable(i.table("orders"), ["o_totalprice", "o_orderkey", "other"])


@query("k9_detail_rows", sql="""
    SELECT l_orderkey, l_linenumber, nullif(l_returnflag, '') AS l_returnflag FROM lineitem""")
def _(i):
    return store.insertable(i.table("lineitem"), ["l_orderkey", "l_linenumber", "l_returnflag"])
