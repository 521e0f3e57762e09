"""Analysis-service results: service JSON in, typed columns out.

The JSON is read with an explicit schema of the parts a caller names, and nothing is
inferred from the data.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldloom import rules

# a field cell; numbers stay text so that no digit is lost before cleaning
CELL = (
    "struct<type:string,content:string,valueString:string,valueDate:string,"
    "valueNumber:string,valueCurrency:struct<amount:string>>"
)
_TABLES = (
    "array<struct<rowCount:int,columnCount:int,cells:array<struct<rowIndex:int,columnIndex:int,"
    "content:string,rowSpan:int,columnSpan:int>>>>"
)
_PAGES = (
    "array<struct<pageNumber:int,width:double,height:double,markdown:string,"
    "spans:array<struct<offset:int,length:int>>>>"
)
_ITEM = f"struct<content:string,valueObject:map<string,{CELL}>>"
_TAX_LINE = (
    "struct<content:string,valueObject:struct<Amount:struct<valueCurrency:struct<amount:string>>,"
    "Rate:struct<valueNumber:string>>>"
)
_RAW_ONLY = ["Beneficiary_name", "payble_to"]


_PARTS = {
    "content": "string", "tables": _TABLES,
    "keyValuePairs": "array<struct<key:struct<content:string>,value:struct<content:string>>>",
    "pages": _PAGES, "paragraphs": "array<struct<content:string,role:string>>",
}
ITEMS, TAX = "Items", "TaxDetails"
_LISTS = {ITEMS: f"struct<valueArray:array<{_ITEM}>>", TAX: f"struct<valueArray:array<{_TAX_LINE}>>"}
ALL_PARTS = (*_PARTS, "documents")


def _fields_type(lists: tuple[str, ...] = (ITEMS, TAX)) -> str:
    sources = [source for source, *_ in rules.INVOICE_FIELDS] + _RAW_ONLY
    parts = [f"{s}:{CELL}" for s in sources] + [f"{name}:{_LISTS[name]}" for name in lists]
    return f"struct<{','.join(parts)}>"


def _result_type(fields: str, parts: tuple[str, ...] = ALL_PARTS) -> str:
    kinds = _PARTS | {"documents": f"array<struct<fields:{fields}>>"}
    return f"struct<analyzeResult:struct<{','.join(f'{p}:{kinds[p]}' for p in parts)}>>"


def _once(df: DataFrame, parsed: Column, name: str) -> DataFrame:
    """Add a parsed column that is computed exactly once.

    As a generator output it cannot be copied into a filter that is pushed below
    the projection, which would parse every document twice.
    """
    return df.select("*", F.explode_outer(F.array(parsed)).alias(name))


def parse(
    df: DataFrame, json_column: str = "json", parts: tuple[str, ...] = ALL_PARTS, lists: tuple[str, ...] = (ITEMS, TAX)
) -> DataFrame:
    """Add ``a``: the typed ``analyzeResult`` with the known invoice fields.

    ``parts`` and ``lists`` name what is read; the JSON parser skips all else.  An
    unreadable text gives null, so the run continues; see ``split_readable``.
    """
    return _once(df, F.from_json(json_column, _result_type(_fields_type(lists), parts))["analyzeResult"], "a")


def mark_unreadable(df: DataFrame, json_column: str = "json") -> DataFrame:
    """Add ``error``, null where the text can be read; one pass over the rows."""
    return df.withColumn("error", F.when(F.try_parse_json(F.col(json_column)).isNull(), "unreadable JSON"))


def split_readable(df: DataFrame, json_column: str = "json") -> tuple[DataFrame, DataFrame]:
    """Readable rows, and unreadable rows with an ``error`` text.  Both read the input;
    ``mark_unreadable`` reads it once."""
    marked = df.withColumn("_readable", F.try_parse_json(F.col(json_column)).isNotNull())
    return (
        marked.where("_readable").drop("_readable"),
        marked.where("NOT _readable").drop("_readable").withColumn("error", F.lit("unreadable JSON")),
    )


# --- normalisers ---------------------------------------------------------------------

def _snake_tables(tables: Column) -> Column:
    return F.transform(
        F.coalesce(tables, F.array().cast(_TABLES)),
        lambda t: F.struct(
            t["rowCount"].alias("row_count"), t["columnCount"].alias("column_count"),
            F.transform(
                t["cells"],
                lambda c: F.struct(
                    c["rowIndex"].alias("row_index"), c["columnIndex"].alias("column_index"),
                    c["content"].alias("content"),
                    c["rowSpan"].alias("row_span"), c["columnSpan"].alias("column_span"),
                ),
            ).alias("cells"),
        ),
    )


def normalise(df: DataFrame, json_column: str = "json") -> DataFrame:
    """Service result in snake case: ``content, tables, pages, paragraphs`` and the
    raw key/value list (pairs with a key and a value only)."""
    a = F.from_json(json_column, _result_type("map<string,string>"))["analyzeResult"]
    parsed = df.withColumn("_a", a)
    pairs = F.filter(
        F.coalesce(F.col("_a.keyValuePairs"), F.array().cast(
            "array<struct<key:struct<content:string>,value:struct<content:string>>>")),
        lambda p: p["key"].isNotNull() & p["value"].isNotNull(),
    )
    return parsed.select(
        "doc_id",
        F.col("_a.content").alias("content"),
        _snake_tables(F.col("_a.tables")).alias("tables"),
        F.transform(pairs, lambda p: F.struct(
            p["key"]["content"].alias("label"), p["value"]["content"].alias("value"))).alias("pairs"),
        F.transform("_a.pages", lambda p: F.struct(
            p["pageNumber"].alias("page_number"), p["width"].alias("width"), p["height"].alias("height"),
            p["spans"].alias("spans"))).alias("pages"),
        F.col("_a.paragraphs").alias("paragraphs"),
    )


def key_values(normalised: DataFrame) -> DataFrame:
    """``doc_id, seq, label, value``: of equal labels the last value, first position."""
    rows = normalised.select("doc_id", F.posexplode("pairs").alias("pos", "p"))
    return rows.groupBy("doc_id", F.col("p.label").alias("label")).agg(
        F.min("pos").alias("seq"), F.max_by("p.value", "pos").alias("value")
    ).select("doc_id", "seq", "label", "value")


def legacy_key_values(df: DataFrame, json_column: str = "json") -> DataFrame:
    """Pairs from ``documents[].fields[name].value``, where ``value`` exists."""
    a = F.from_json(json_column, _result_type("map<string,string>"))["analyzeResult"]
    docs = df.select("doc_id", F.posexplode(a["documents"]).alias("doc_no", "d"))
    fields = docs.select("doc_id", "doc_no", F.posexplode("d.fields").alias("pos", "label", "cell"))
    valued = fields.withColumn("value", F.get_json_object("cell", "$.value")).where(F.col("value").isNotNull())
    found = valued.groupBy("doc_id", "label").agg(
        F.min(F.struct("doc_no", "pos")).alias("first"),
        F.max_by("value", F.struct("doc_no", "pos")).alias("value"),
    )
    # one row for each label of a document
    seq = F.row_number().over(Window.partitionBy("doc_id").orderBy("first", "label")) - 1
    return found.select("doc_id", seq.cast("bigint").alias("seq"), "label", "value")


def normalise_legacy(df: DataFrame, json_column: str = "json") -> DataFrame:
    """Legacy result: parts of ``analyzeResult`` copied, missing parts empty."""
    a = F.from_json(json_column, _result_type("map<string,string>"))["analyzeResult"]
    empty = F.array()
    return df.withColumn("_a", a).select(
        "doc_id",
        F.coalesce("_a.content", F.lit("")).alias("content"),
        F.coalesce(F.col("_a.tables"), empty.cast(_TABLES)).alias("tables"),
        F.coalesce(F.col("_a.pages"), empty.cast(_PAGES)).alias("pages"),
        F.coalesce(F.col("_a.paragraphs"), empty.cast("array<struct<content:string,role:string>>")).alias("paragraphs"),
    )


# --- value pickers ---------------------------------------------------------------------

def pick_field(path: str) -> Column:
    """Scalar text of the typed field cell at ``path``: string, date, amount,
    address, content.  One SQL text, as records pick some forty cells."""
    return F.expr(
        f"CASE WHEN {path}.valueString IS NOT NULL THEN {path}.valueString"
        f" WHEN {path}.valueDate IS NOT NULL THEN {path}.valueDate"
        f" WHEN {path}.type = 'currency' AND {path}.valueCurrency IS NOT NULL THEN {path}.valueCurrency.amount"
        f" WHEN {path}.type = 'address' THEN coalesce({path}.content, '')"
        f" ELSE {path}.content END"
    )


def pick_struct(cell: Column) -> Column:
    """The same for a cell that is an expression."""
    return (
        F.when(cell["valueString"].isNotNull(), cell["valueString"])
        .when(cell["valueDate"].isNotNull(), cell["valueDate"])
        .when((cell["type"] == "currency") & cell["valueCurrency"].isNotNull(), cell["valueCurrency"]["amount"])
        .when(cell["type"] == "address", F.coalesce(cell["content"], F.lit("")))
        .otherwise(cell["content"])
    )


def first_fields(a: Column = None) -> Column:
    """Typed fields of the first document of an analysis."""
    a = F.col("a") if a is None else a
    return F.get(a["documents"], F.lit(0))["fields"]


def _list_content(json: Column, item: str) -> Column:
    """Items of list-shaped content; null when the content is no list."""
    return F.try_variant_get(F.try_parse_json(json), "$.analyzeResult.content", f"array<struct<{item}>>")


def _looks_like_list(a: Column) -> Column:
    """List-shaped content was read as its JSON text, so it starts with a bracket.

    Text content may do so too; the exact test is left to the variant reader, which
    runs for these rows only.
    """
    return F.coalesce(a["content"].startswith("["), F.lit(False))


def markdown_of(json: Column, a: Column) -> Column:
    """Markdown text: from list-shaped content the first item that has any, else
    text content, else the pages' markdown joined.  ``a`` is the parsed result."""
    items = _list_content(json, "markdown:string")
    listed = F.get(F.filter(items, lambda i: i["markdown"].isNotNull()), F.lit(0))["markdown"]
    joined = F.coalesce(
        F.array_join(F.transform(a["pages"], lambda p: F.coalesce(p["markdown"], F.lit(""))), ""), F.lit("")
    )
    in_list = F.when(items.isNotNull(), F.coalesce(listed, joined)).otherwise(a["content"])
    return F.when(_looks_like_list(a), in_list).otherwise(F.coalesce(a["content"], joined))


def paragraphs_of(json: Column, a: Column) -> Column:
    """Paragraph texts of the first item of list-shaped content that has any."""
    items = _list_content(json, "paragraphs:array<struct<content:string>>")
    hit = F.get(F.filter(items, lambda i: i["paragraphs"].isNotNull()), F.lit(0))["paragraphs"]
    texts = F.transform(hit, lambda p: F.coalesce(p["content"], F.lit("")))
    return F.coalesce(F.when(_looks_like_list(a), texts), F.array().cast("array<string>"))


# --- pages -------------------------------------------------------------------------------

def page_texts(normalised: DataFrame) -> DataFrame:
    """Text of each page by its spans of the content (code points).

    Cut inside the row and exploded afterwards, so the whole content is not
    copied once per page.
    """
    content = F.coalesce("content", F.lit(""))
    cut = F.transform(
        "pages",
        lambda p: F.struct(
            p["page_number"].alias("page_number"),
            F.array_join(
                F.transform(p["spans"], lambda s: F.substring(content, s["offset"] + 1, s["length"])), ""
            ).alias("text"),
        ),
    )
    return normalised.select("doc_id", F.inline(cut))


def tables_of(normalised: DataFrame) -> DataFrame:
    return normalised.select("doc_id", "tables")
