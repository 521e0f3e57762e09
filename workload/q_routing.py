"""Label routing, layered merge, validation of records and document types."""

from __future__ import annotations

from pyspark.sql import functions as F

from fieldloom import rules
from fieldloom.functions import pyfuncs
from fieldloom.operators import routing, validate
from fieldloom.plans import documents
from fieldloom.rules import DocumentRules
from workload.base import query, values
from workload.fixtures import FOLDERS
from workload.q_checks import OK_SQL, TRUTHY_SQL

RULES_SQL = values(
    [(t, n, p, f) for t, pairs in rules.LABEL_PATTERNS.items() for n, (p, f) in enumerate(pairs)],
    "r(document_type, ordinal, pattern, field_name)")
CATALOG_SQL = values(
    [(t, f, f in rules.REQUIRED_FIELDS[t], n) for t in rules.REQUIRED_FIELDS
     for n, f in enumerate(rules.REQUIRED_FIELDS[t] + rules.OPTIONAL_FIELDS[t])],
    "c(document_type, field_name, required, ordinal)")


def routed_sql(source: str, type_sql: str) -> str:
    """First pattern contained in the label by ordinal, then the last label per field."""
    return f"""
    SELECT doc_id, min(seq) AS seq, field_name, arg_max(coalesce(value, chr(0)), seq) AS field_value
    FROM (SELECT k.doc_id, k.seq, k.label, arg_min(r.field_name, r.ordinal) AS field_name, min(k.value) AS value
          FROM {source} k JOIN {RULES_SQL} ON r.document_type = {type_sql} AND contains(lower(k.label), r.pattern)
          GROUP BY k.doc_id, k.seq, k.label) AS hit
    GROUP BY doc_id, field_name"""


def fields_sql(source: str, type_sql: str) -> str:
    return f"""
    SELECT doc_id, CAST(seq AS BIGINT) AS seq, field_name, nullif(field_value, chr(0)) AS field_value,
           CASE WHEN field_value = chr(0) THEN 'NoneType' ELSE 'str' END AS value_type
    FROM ({routed_sql(source, type_sql)}) AS routed"""


for _id, _kind in (("x1", "agreement"), ("x2", "invoice"), ("x3", "pan"), ("x4", "aadhaar")):
    def _run(i, kind=_kind):
        return routing.route_fields(i.fixture(f"kv_{kind}"), kind)

    query(f"{_id}_{_kind}_labels", uses=f"kv_{_kind}", sql=fields_sql(f"kv_{_kind}", f"'{_kind}'"))(_run)


@query("j2_first_pattern_of_label", uses="kv_all", sql=f"""
    SELECT k.doc_id, k.seq, k.label, (SELECT arg_min(r.field_name, r.ordinal) FROM {RULES_SQL}
            WHERE r.document_type = k.document_type AND contains(lower(k.label), r.pattern)) AS field_name
    FROM kv_all k""")
def _(i):
    return i.fixture("kv_all").select(
        "doc_id", "seq", "label", routing.route_label(F.col("label"), F.col("document_type")).alias("field_name"))


def _model_layer(i):
    """A second layer as a text model would give it: some fields, rendered from orders."""
    return i.sql("""SELECT o_orderkey AS doc_id, CAST(seq AS BIGINT) AS seq,
        CASE seq WHEN 0 THEN 'vendor_name' WHEN 1 THEN 'currency' ELSE 'name' END AS field_name,
        CASE seq WHEN 0 THEN 'Model vendor' WHEN 1 THEN NULL ELSE 'Model name' END AS field_value,
        CASE seq WHEN 1 THEN 'NoneType' ELSE 'str' END AS value_type
        FROM (SELECT *, @explode(@array(0, 1, 2)) AS seq FROM {orders}) AS t""")


_MERGED_SQL = f"""
    SELECT doc_id, field_name, last.v AS field_value, last.t AS value_type,
           row_number() OVER (PARTITION BY doc_id ORDER BY first, field_name) - 1 AS seq FROM (
        SELECT doc_id, field_name, arg_max({{{{'v': field_value, 't': value_type}}}}, {{{{'layer': layer, 'pos': pos}}}}) AS last,
               min({{{{'layer': layer, 'pos': pos}}}}) AS first FROM (
            SELECT doc_id, 0 AS layer, CAST(seq AS BIGINT) * 5000000000 AS pos, field_name, field_value, value_type FROM ({fields_sql('kv_all', 'k.document_type')}) AS a
            UNION ALL
            SELECT o_orderkey, 1, n, f, v, CASE WHEN v IS NULL THEN 'NoneType' ELSE 'str' END
            FROM orders, (VALUES ('vendor_name', 'Model vendor', 0), ('currency', NULL, 1), ('name', 'Model name', 2)) AS m(f, v, n)
            UNION ALL SELECT doc_id, 2, 0, 'document_type', document_type, 'str' FROM docs
            UNION ALL SELECT doc_id, 2, 1, 'source_file', file_path, 'str' FROM docs) AS u
        GROUP BY doc_id, field_name) AS g""".replace("{{", "{").replace("}}", "}")


@query("x10_layered_merge", uses=("kv_all", "docs"), sql=_MERGED_SQL)
def _(i):
    # positions beyond 2**32, as sparse sources give them
    sparse = i.fixture("kv_all").withColumn("seq", F.col("seq").cast("bigint") * 5_000_000_000)
    return documents.extract_fields(i.fixture("docs"), sparse, _model_layer(i)).select(
        "doc_id", "field_name", "field_value", "value_type", "seq")


@query("x13_merge_dicts", uses="kv_invoice", sql="""
    SELECT doc_id, key, arg_max(value, layer) AS value FROM (
        SELECT doc_id, label AS key, coalesce(value, '') AS value, 0 AS layer FROM kv_invoice
        UNION ALL SELECT doc_id, upper(label), coalesce(value, '') || '!', 1 FROM kv_invoice) AS u
    GROUP BY doc_id, key""")
def _(i):
    kv = i.fixture("kv_invoice")
    layer = lambda name, value: kv.select(
        "doc_id", "seq", name.alias("field_name"), value.alias("field_value"), F.lit("str").alias("value_type"))
    value = F.coalesce("value", F.lit(""))
    merged = routing.merge_layers(
        layer(F.col("label"), value), layer(F.upper("label"), F.concat(value, F.lit("!"))))
    return merged.select("doc_id", F.col("field_name").alias("key"), F.col("field_value").alias("value"))


@query("x11_type_from_folder", uses="input_files", sql=f"""
    SELECT f.doc_id, path, coalesce(t.kind, '{rules.DEFAULT_TYPE}') AS document_type
    FROM input_files f LEFT JOIN {values(list(rules.PARENT_FOLDER_TYPES.items()), 't(folder, kind)')}
      ON lower(string_split(path, '/')[-2]) = t.folder""")
def _(i):
    return i.fixture("input_files").select(
        "doc_id", "path", routing.type_from_path(F.col("path")).alias("document_type"))


# expected types worked out by hand from the similarity ratios
@query("x12_tolerant_folder_type", uses="files", sql=f"""
    SELECT f.doc_id, folder, kind AS document_type
    FROM (SELECT doc_id, string_split(path, '/')[-2] AS folder FROM files) f
    LEFT JOIN {values(FOLDERS, 't(name, kind)')} ON f.folder = t.name""")
def _(i):
    folder = F.get(F.reverse(F.split("path", "/")), F.lit(1))
    return i.fixture("files").select("doc_id", folder.alias("folder")).select(
        "doc_id", "folder", pyfuncs.resolve_folder("folder").alias("document_type"))


@query("x6_field_schema", uses="docs", sql=f"""
    SELECT document_type, count(*) AS n_documents, ordinal, field_name, 'string' AS field_type,
           array_to_string(list_transform(string_split(field_name, '_'), lambda w: upper(w[1]) || w[2:]), ' ') AS description, required
    FROM docs JOIN {CATALOG_SQL} USING (document_type) GROUP BY ALL""")
def _(i):
    used = i.fixture("docs").groupBy("document_type").agg(F.count(F.lit(1)).alias("n_documents"))
    return routing.field_schema(rules.STANDARD.catalog(i.spark)).join(used, "document_type")


@query("x7_prompt_schema", uses="docs", sql=f"""
    SELECT doc_id, prompt FROM docs JOIN (
        SELECT document_type, string_agg('- ' || field_name || ' (string): '
             || array_to_string(list_transform(string_split(field_name, '_'), lambda w: upper(w[1]) || w[2:]), ' ')
             || CASE WHEN required THEN ' (required)' ELSE ' (optional)' END, chr(10) ORDER BY ordinal) AS prompt
        FROM {CATALOG_SQL} GROUP BY document_type) AS p USING (document_type)""")
def _(i):
    return i.fixture("docs").select("doc_id", routing.prompt_schema(F.col("document_type")).alias("prompt"))


@query("x14_flatten_struct", sql="""
    SELECT o_orderkey AS "id", o_custkey AS "customer.key", o_orderstatus AS "order.status.code",
           o_orderpriority AS "order.priority" FROM orders""")
def _(i):
    nested = i.table("orders").select(
        F.col("o_orderkey").alias("id"), F.struct(F.col("o_custkey").alias("key")).alias("customer"),
        F.struct(F.struct(F.col("o_orderstatus").alias("code")).alias("status"),
                 F.col("o_orderpriority").alias("priority")).alias("order"))
    return routing.flatten_struct(nested)


@query("x14_flatten_json", sql="""
    SELECT event_id AS doc_id, path, v.value FROM events, (VALUES (0), (1), (2), (3), (4)) AS n(i),
        LATERAL (SELECT CASE i WHEN 0 THEN 'props.k' WHEN 1 THEN 'who.user.id' WHEN 2 THEN 'who.kinds' WHEN 3 THEN 'none'
                               ELSE repeat('d.', 20) || 'end' END AS path,
                        CASE i WHEN 0 THEN CAST(json_extract(props, '$.k') AS VARCHAR) WHEN 1 THEN CAST(user_id AS VARCHAR)
                               WHEN 2 THEN '["' || event_type || '",1]' WHEN 3 THEN NULL ELSE '1.50' END AS value) AS v""")
def _(i):
    json = F.concat(
        F.lit('{"props":'), F.col("props"), F.lit(',"who":{"user":{"id":'), F.col("user_id").cast("string"),
        F.lit('},"kinds":["'), F.col("event_type"), F.lit('",1]},"empty":{},"none":null,' + '"d":{' * 20 + '"end":1.50' + "}" * 21))
    rows = i.table("events").select(F.col("event_id").alias("doc_id"), json.alias("json"))
    return routing.flatten_json(rows, "json")


@query("x39_origin_tags", uses="docs", sql="""
    SELECT doc_id, document_type, 'adi_json' AS source, file_path AS source_file FROM docs""")
def _(i):
    docs = i.fixture("docs")
    return routing.tag_origin(
        docs.select("doc_id", "document_type", "file_path"), "adi_json", F.col("document_type"), F.col("file_path")
    ).select("doc_id", "document_type", "source", "source_file")


# --- validation ------------------------------------------------------------------------------

_CLEAN_SQL = f"""
    SELECT doc_id, seq, field_name, trim(field_value) AS field_value, value_type
    FROM ({fields_sql('kv_all', 'k.document_type')}) AS f"""
ERRORS_SQL = f"""
    SELECT d.doc_id, 1 AS phase, CAST(c.ordinal AS BIGINT) AS seq, c.field_name,
           CASE WHEN NOT coalesce({TRUTHY_SQL}, FALSE) THEN 'Missing required field: ' ELSE 'Invalid value for field: ' END || c.field_name AS message
    FROM docs d JOIN {CATALOG_SQL} ON c.document_type = d.document_type AND c.required
    LEFT JOIN (SELECT doc_id AS id, field_name AS fname, field_value, value_type FROM clean) f ON f.id = d.doc_id AND f.fname = c.field_name
    WHERE NOT coalesce({TRUTHY_SQL}, FALSE) OR NOT ({OK_SQL.replace('field_name', 'fname')})
    UNION ALL
    SELECT doc_id, 2, seq, field_name, 'Invalid format for field: ' || field_name
    FROM clean WHERE ({TRUTHY_SQL}) AND NOT ({OK_SQL})"""


def _clean(i):
    kv = i.fixture("kv_all")
    return validate.sanitize(routing.route_fields(kv, F.col("document_type")))


@query("v2_required_fields", uses=("kv_all", "docs"), sql=f"""
    WITH clean AS ({_CLEAN_SQL}) SELECT doc_id, field_name, message FROM ({ERRORS_SQL}) AS e WHERE phase = 1""")
def _(i):
    return validate.required_errors(i.fixture("docs"), _clean(i)).select("doc_id", "field_name", "message")


@query("v3_field_formats", uses=("kv_all", "docs"), sql=f"""
    WITH clean AS ({_CLEAN_SQL}) SELECT doc_id, seq, message FROM ({ERRORS_SQL}) AS e WHERE phase = 2""")
def _(i):
    return validate.format_errors(_clean(i)).select("doc_id", "seq", "message")


@query("v4_record_verdict", uses=("kv_all", "docs"), sql=f"""
    WITH clean AS ({_CLEAN_SQL}) SELECT doc_id, document_type, coalesce(n, 0) AS n_errors, n IS NULL AS is_valid
    FROM docs LEFT JOIN (SELECT doc_id, count(*) AS n FROM ({ERRORS_SQL}) AS e GROUP BY doc_id) AS c USING (doc_id)""")
def _(i):
    return validate.verdicts(i.fixture("docs"), _clean(i))


@query("v4_record_errors", uses=("kv_all", "docs"), sql=f"""
    WITH clean AS ({_CLEAN_SQL}) SELECT * FROM ({ERRORS_SQL}) AS e""")
def _(i):
    return validate.record_errors(i.fixture("docs"), _clean(i))


@query("v13_document_valid", uses=("kv_all", "docs"), sql=f"""
    WITH clean AS ({fields_sql('kv_all', 'k.document_type')}), req AS (
        SELECT d.doc_id, d.document_type, bool_and(coalesce(length(f.field_value) > 0, FALSE)) AS present
        FROM docs d JOIN {CATALOG_SQL} ON c.document_type = d.document_type AND c.required
        LEFT JOIN clean f ON f.doc_id = d.doc_id AND f.field_name = c.field_name GROUP BY ALL)
    SELECT req.doc_id, req.document_type, present AND CASE req.document_type
        WHEN 'pan' THEN coalesce((SELECT length(field_value) = 10 FROM clean f WHERE f.doc_id = req.doc_id AND field_name = 'pan_number'), FALSE)
        WHEN 'aadhaar' THEN coalesce((SELECT regexp_full_match(replace(replace(field_value, ' ', ''), '-', ''), '[0-9]{{12}}')
                                      FROM clean f WHERE f.doc_id = req.doc_id AND field_name = 'aadhaar_number'), FALSE)
        ELSE TRUE END AS is_valid FROM req""")
def _(i):
    fields = routing.route_fields(i.fixture("kv_all"), F.col("document_type"))
    return validate.document_valid(i.fixture("docs"), fields)


@query("j4_missing_required", uses=("kv_all", "docs"), sql=f"""
    SELECT d.doc_id, d.document_type, c.field_name, c.ordinal
    FROM (SELECT doc_id, document_type FROM docs UNION ALL SELECT -doc_id, document_type FROM docs) AS d JOIN {CATALOG_SQL} ON c.document_type = d.document_type AND c.required
    WHERE NOT EXISTS (SELECT 1 FROM ({fields_sql('kv_all', 'k.document_type')}) AS f
                      WHERE f.doc_id = d.doc_id AND f.field_name = c.field_name)""")
def _(i):
    fields = routing.route_fields(i.fixture("kv_all"), F.col("document_type"))
    # for every document a second one, of which nothing was extracted
    docs = i.fixture("docs").select("doc_id", "document_type")
    blank = docs.select((-F.col("doc_id")).alias("doc_id"), "document_type")
    return validate.missing_fields(docs.unionByName(blank), fields, rules.STANDARD.catalog(i.spark)).select(
        "doc_id", "document_type", "field_name", "ordinal")


@query("flagship_verdict_counts", uses=("kv_all", "docs"), sql=f"""
    WITH clean AS ({_CLEAN_SQL}), e AS ({ERRORS_SQL}), n AS (SELECT doc_id, count(*) AS n FROM e GROUP BY doc_id)
    SELECT document_type, CASE WHEN n IS NULL THEN 'valid' ELSE 'invalid' END AS validation_status,
           count(*) AS n_documents, CAST(coalesce(sum(n), 0) AS BIGINT) AS n_errors
    FROM docs LEFT JOIN n USING (doc_id) GROUP BY 1, 2""")
def _(i):
    return documents.verdict_counts(i.fixture("docs"), i.fixture("kv_all"))


# --- extension ---------------------------------------------------------------------------------

_RECEIPT = DocumentRules(
    required=["order_no", "status"], optional=["priority"],
    patterns=[("order", "order_no"), ("status", "status"), ("prio", "priority")])


@query("f1_register_type", sql="""
    SELECT doc_id, field_name, message FROM (
        SELECT o_orderkey AS doc_id, 'status' AS field_name, 'Missing required field: status' AS message FROM orders WHERE o_orderstatus = 'P'
        UNION ALL SELECT o_orderkey, 'order_no', 'Missing required field: order_no' FROM orders WHERE o_custkey % 10 = 0) AS e""")
def _(i):
    book = rules.STANDARD.register("Receipt", _RECEIPT)
    pairs = i.sql("""SELECT o_orderkey AS doc_id, seq, CASE seq WHEN 0 THEN 'Order No' WHEN 1 THEN 'Order Status' WHEN 2 THEN 'Status' ELSE 'Prio' END AS label,
        CASE seq WHEN 0 THEN 'O-1' WHEN 1 THEN CASE WHEN o_custkey % 10 = 0 THEN '' ELSE 'n' END
                 WHEN 2 THEN CASE WHEN o_orderstatus = 'P' THEN '' ELSE o_orderstatus END ELSE o_orderpriority END AS value
        FROM (SELECT *, @explode(@array(0, 1, 2, 3)) AS seq FROM {orders}) AS t""")
    docs = i.table("orders").select(F.col("o_orderkey").alias("doc_id"), F.lit("receipt").alias("document_type"))
    fields = routing.route_fields(pairs, "receipt", book)
    return validate.record_errors(docs, fields, book).select("doc_id", "field_name", "message")


@query("f1_registered_validator", sql="""
    SELECT o_orderkey AS doc_id, unnest([1, 2]) AS phase, 'order_no' AS field_name,
           unnest(['Invalid value for field: ', 'Invalid format for field: ']) || 'order_no' AS message FROM orders WHERE o_orderkey % 3 = 0""")
def _(i):
    receipt = DocumentRules(["order_no"], [], [("order no", "order_no")], {"order_no": lambda c: c.rlike("^O-[0-9]+$")})
    book = rules.STANDARD.register("Receipt", receipt)
    pairs = i.sql("""SELECT o_orderkey AS doc_id, 0 AS seq, 'Order No' AS label,
        CASE WHEN o_orderkey % 3 = 0 THEN 'number ' ELSE 'O-' END || CAST(o_orderkey AS STRING) AS value FROM {orders}""")
    docs = i.table("orders").select(F.col("o_orderkey").alias("doc_id"), F.lit("receipt").alias("document_type"))
    fields = routing.route_fields(pairs, "receipt", book)
    return validate.record_errors(docs, fields, book).select("doc_id", "phase", "field_name", "message")


