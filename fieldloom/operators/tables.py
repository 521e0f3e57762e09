"""Tables inside documents: cells, grids, line items and bank details.

Cells are long: ``doc_id, table_no, seq, row_index, column_index, content``.
Everything is first reduced per (document, table, row), so a document with very
many cells is spread over its rows and never gathered in one task.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldloom import rules
from fieldloom.functions import checks
from fieldloom.functions.pyfuncs import html_tables
from fieldloom.functions.text import clean, clean_as, empty_to_null, strip
from fieldloom.operators.routing import first_match

TABLE = ["doc_id", "table_no"]
ROW = ["doc_id", "table_no", "row_index"]


def explode_cells(docs: DataFrame, tables: str = "tables") -> DataFrame:
    """Analysis ``tables`` array to cell rows."""
    one = docs.select("doc_id", F.posexplode(tables).alias("table_no", "t"))
    return one.select("doc_id", "table_no", F.posexplode("t.cells").alias("seq", "c")).select(
        "doc_id", "table_no", "seq",
        F.coalesce("c.row_index", F.lit(0)).alias("row_index"),
        F.coalesce("c.column_index", F.lit(0)).alias("column_index"),
        F.coalesce("c.content", F.lit("")).alias("content"),
    )


# --- line items from a cell grid ---------------------------------------------------

def line_items(cells: DataFrame) -> DataFrame:
    """Rows 1..n-1 of a table with n distinct rows, when a row has two cells or more.

    Missing cells take the defaults ``'' , '1', '0', '0'``; of repeated cells the
    last counts.  "Two distinct columns" is min <> max, which needs no distinct.
    """
    at = lambda k: F.max_by("content", F.when(F.col("column_index") == k, F.col("seq")))
    per_row = cells.groupBy(*ROW).agg(
        F.min("column_index").alias("lo"), F.max("column_index").alias("hi"),
        *[at(k).alias(f"c{k}") for k in range(4)],
    )
    sizes = per_row.groupBy(*TABLE).agg(F.count(F.lit(1)).alias("n_rows"))
    kept = per_row.join(sizes, TABLE).where(
        (F.col("row_index") >= 1) & (F.col("row_index") < F.col("n_rows")) & (F.col("lo") != F.col("hi"))
    )
    return kept.select(
        *ROW,
        F.coalesce("c0", F.lit("")).alias("description"),
        F.coalesce("c1", F.lit("1")).alias("quantity"),
        F.coalesce("c2", F.lit("0")).alias("unit_price"),
        F.coalesce("c3", F.lit("0")).alias("amount"),
    )


def item_rows(records: DataFrame, items: str, name: str = "item", number: str = "Sr_No") -> DataFrame:
    """A record's list as rows numbered from 1 in list order; the other columns come along.

    Null and empty lists give no row.
    """
    others = [c for c in records.columns if c != items]
    return records.select(*others, F.posexplode(items).alias("_pos", name)).select(
        *others, (F.col("_pos") + 1).alias(number), name)


# --- full grids ----------------------------------------------------------------------

def grid_rows(cells: DataFrame) -> DataFrame:
    """Every row of every table as an array of texts, filled to a rectangle.

    ``doc_id, table_no, row_index, n_rows, n_columns, line array<string>``.
    One row's cells are collected only after repeats are dropped, so an array is
    never longer than the table is wide.
    """
    # dealt by row once; both groupings below keep this partitioning
    single = cells.repartition(*[F.col(c) for c in ROW]).groupBy(*ROW, "column_index").agg(
        F.replace(F.max_by("content", "seq"), F.lit("\n"), F.lit(" ")).alias("content")
    )
    per_row = single.groupBy(*ROW).agg(
        F.max("column_index").alias("last"),
        F.map_from_entries(F.collect_list(F.struct("column_index", "content"))).alias("m"),
    )
    # from the same rows, so that the cells are read and shuffled once
    shape = per_row.groupBy(*TABLE).agg(
        (F.max("row_index") + 1).alias("n_rows"), (F.max("last") + 1).alias("n_columns")
    )
    every_row = shape.select(
        "*", F.explode(F.sequence(F.lit(0), (F.col("n_rows") - 1).cast("int"))).alias("row_index")
    )
    filled = every_row.join(per_row.drop("last"), ROW, "left")
    texts = F.transform(
        F.sequence(F.lit(0), (F.col("n_columns") - 1).cast("int")),
        lambda k: F.coalesce(F.try_element_at("m", k), F.lit("")),
    )
    return filled.select(*ROW, "n_rows", "n_columns", F.when(F.col("m").isNull(), F.transform(
        F.sequence(F.lit(0), (F.col("n_columns") - 1).cast("int")), lambda k: F.lit("")
    )).otherwise(texts).alias("line"))


def markdown_lines(cells: DataFrame, around=None) -> DataFrame:
    """Pipe grid of every table: header row, separator, then the other rows.

    ``around`` (n_rows, n_columns to an array of line_no, text) adds lines of each
    table, which come along with its header row.
    """
    grid = grid_rows(cells)
    piped = F.concat(F.lit("| "), F.array_join("line", " | "), F.lit(" |"))
    rule = F.concat(F.lit("| "), F.array_join(F.transform("line", lambda x: F.lit("---")), " | "), F.lit(" |"))
    # the header row brings its separator along, so rows never have to meet
    first = F.array(
        F.struct(F.lit(0).alias("line_no"), piped.alias("text")),
        F.struct(F.lit(1).alias("line_no"), rule.alias("text")),
    )
    if around is not None:
        first = F.concat(first, around(F.col("n_rows"), F.col("n_columns")))
    numbered = F.when(F.col("row_index") == 0, first).otherwise(F.array(F.struct((F.col("row_index") + 1).alias("line_no"), piped.alias("text"))))
    return grid.select(*TABLE, "n_rows", "n_columns", F.inline(numbered))


def csv_lines(cells: DataFrame) -> DataFrame:
    """Comma-separated line per grid row, quoted only where needed."""
    quoted = lambda x: F.when(
        x.rlike('[,"\r\n]'), F.concat(F.lit('"'), F.replace(x, F.lit('"'), F.lit('""')), F.lit('"'))
    ).otherwise(x)
    return grid_rows(cells).select(*ROW, F.array_join(F.transform("line", quoted), ",").alias("text"))


# --- bank details ----------------------------------------------------------------------

def _bank_value(target: Column, value: Column) -> Column:
    """Clean by target column; a PAN that does not validate is dropped."""
    def choose(body) -> Column:
        chain = None
        for column, kind in rules.BANK_CLEANERS.items():
            cleaned = F.when(checks.is_pan(value), body(kind)) if kind == "pan" else body(kind)
            chain = F.when(target == column, cleaned) if chain is None else chain.when(target == column, cleaned)
        return chain.otherwise(body("text"))

    return clean_as(value, choose)


def _rows_of_cells(cells: DataFrame) -> DataFrame:
    """One row for each table row: its cells in order of ``seq``.  As wide as the table."""
    return cells.groupBy(*ROW).agg(F.sort_array(F.collect_list(F.struct("seq", "column_index", "content"))).alias("cells"))


def _with_neighbour(cells: Column, wanted) -> Column:
    """(cell, value): the wanted cells that have a right-hand neighbour, the first of repeats."""
    def pair(c: Column) -> Column:
        right = F.get(F.filter(cells, lambda r: r["column_index"] == c["column_index"] + 1), F.lit(0))
        return F.struct(c["seq"].alias("seq"), c["content"].alias("content"), right.isNotNull().alias("has"), right["content"].alias("value"))

    return F.filter(F.transform(F.filter(cells, wanted), pair), lambda p: p["has"])


def label_value_cells(cells: DataFrame) -> DataFrame:
    """Each cell with its right-hand neighbour (the first of repeats).

    Looked up inside the table row both lie in, so nothing is joined and a document
    with most of all cells is spread over its rows.
    """
    pairs = _with_neighbour(F.col("cells"), lambda c: F.lit(True))
    return _rows_of_cells(cells).select(*ROW, F.inline(pairs)).drop("has")


def bank_label(content: Column) -> Column:
    """A cell's text as it is compared with the bank labels."""
    return F.translate(F.lower(strip(content)), ": ", "")


_ANY_BANK_LABEL = "|".join(key for key, _ in rules.BANK_LABELS)


def bank_fields_from_cells(cells: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """Bank columns from label cells and the cell to their right, first hit wins.

    Only tables that speak of bank details are read.  ``known`` (``doc_id,
    Bank_Name``) skips documents whose bank is known.  Cells are shuffled once, by
    table row; after that a table row is two flags and its labelled values, and a table
    or document is reduced to one value for each bank column, whatever its length.
    """
    low = lambda c: F.lower(c["content"])
    rows = _rows_of_cells(cells).select(
        *TABLE,
        F.coalesce(F.exists("cells", lambda c: low(c).contains("bank")), F.lit(False)).alias("bank"),
        F.coalesce(F.exists("cells", lambda c: low(c).contains("details") | low(c).contains("account")), F.lit(False)).alias("details"),
        _with_neighbour(F.col("cells"), lambda c: bank_label(c["content"]).rlike(_ANY_BANK_LABEL)).alias("pairs"),
    )
    # a row without a labelled value stays for its flags; filtered behind the generator, so that flags and pairs are made once
    named = rows.select(*TABLE, "bank", "details", F.inline_outer("pairs")).where(
        F.col("bank") | F.col("details") | F.col("content").isNotNull()).select(
        *TABLE, "bank", "details", "seq", "value",
        first_match(bank_label(F.col("content")), rules.BANK_LABELS).alias("field_name"))
    # a value that was cleaned away must not shadow a later one
    cleaned = named.withColumn("field_value", _bank_value(F.col("field_name"), F.col("value")))
    columns = list(dict.fromkeys(target for _, target in rules.BANK_LABELS))
    here = lambda c: F.when((F.col("field_name") == c) & F.col("field_value").isNotNull(), F.struct("seq", "field_value"))
    per_table = cleaned.groupBy(*TABLE).agg(
        F.bool_or("bank").alias("b"), F.bool_or("details").alias("d"), *[F.min(here(c)).alias(c) for c in columns]).where("b AND d")
    placed = lambda c: F.when(F.col(c).isNotNull(), F.struct("table_no", f"{c}.seq", f"{c}.field_value"))
    found = per_table.groupBy("doc_id").agg(*[F.min(placed(c)).alias(c) for c in columns])
    if known is not None:
        found = found.join(known.where(F.length("Bank_Name") > 0).select("doc_id"), "doc_id", "left_anti")
    values = F.array(*[F.struct(F.lit(c).alias("field_name"), F.col(f"{c}.field_value").alias("field_value")) for c in columns])
    return found.select("doc_id", F.inline(values)).where(F.col("field_value").isNotNull())


def bank_hits(tables: Column) -> Column:
    """The same for a record's own tables (``cells`` with rowIndex, columnIndex, content):
    the hits in order, array<struct<field_name, field_value>>, without a shuffle."""
    text = lambda c: F.coalesce(c["content"], F.lit(""))
    at = lambda c, name: F.coalesce(c[name], F.lit(0))
    low = lambda c: F.lower(text(c))
    speaking = F.filter(
        tables,
        lambda t: F.exists(t["cells"], lambda c: low(c).contains("bank"))
        & F.exists(t["cells"], lambda c: low(c).contains("details") | low(c).contains("account")),
    )

    def hits(t: Column) -> Column:
        def hit(c: Column) -> Column:
            right = F.get(F.filter(t["cells"], lambda r: (at(r, "rowIndex") == at(c, "rowIndex"))
                                   & (at(r, "columnIndex") == at(c, "columnIndex") + 1)), F.lit(0))
            name, value = first_match(bank_label(text(c)), rules.BANK_LABELS), strip(text(right))
            return F.struct(name.alias("field_name"), F.when(F.length(value) > 0, _bank_value(name, value)).alias("field_value"))

        return F.transform(F.filter(t["cells"], lambda c: bank_label(text(c)).rlike(_ANY_BANK_LABEL)), hit)

    return F.filter(F.flatten(F.transform(speaking, hits)), lambda h: h["field_value"].isNotNull())


def first_hit(hits: Column, field_name: str) -> Column:
    return F.get(F.filter(hits, lambda h: h["field_name"] == field_name), F.lit(0))["field_value"]


# --- HTML tables -------------------------------------------------------------------------

def _let(value: Column, body) -> Column:
    """``body(value)`` with the value made once, however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _signature(table: Column) -> Column:
    words = F.concat(table["header"], F.flatten(table["rows"]))
    return F.regexp_replace(F.lower(F.array_join(words, " ")), "[^a-z]", "")


def classified_tables(markdown: Column) -> Column:
    """HTML tables of a text as ``bank``, ``gst`` and ``invoice`` tables.

    Of several bank or gst tables the last counts, of invoice tables the first
    with a row.  One parse per document; the rules are plain expressions.  The named list
    and the answer are bound by ``_let``: written out they would be made again wherever a
    table is read.
    """
    tagged = F.transform(html_tables(markdown), lambda t: F.struct(t.alias("t"), _signature(t).alias("s")))

    def kind(s):
        words = rules.TABLE_WORDS
        bank = reduce(lambda x, y: x & y, [s.contains(w) for w in words["bank"]])
        invoice = _any(s, words["invoice"])
        gst = _any(s, words["gst"]) & ~invoice
        return F.when(bank, "bank").when(gst, "gst").when(invoice, "invoice")

    named = F.transform(tagged, lambda x: F.struct(x["t"].alias("t"), kind(x["s"]).alias("kind")))
    pick = lambda tables, name, index: F.try_element_at(
        F.filter(tables, lambda x: x["kind"] == name), F.lit(index)
    )["t"]
    return _let(named, lambda n: F.struct(
        pick(n, "bank", -1).alias("bank"), pick(n, "gst", -1).alias("gst"), pick(n, "invoice", 1).alias("invoice")
    ))


def _any(c: Column, words) -> Column:
    hit = F.lit(False)
    for word in words:
        hit = hit | c.contains(word)
    return hit


def with_tables(docs: DataFrame, markdown: str = "markdown") -> DataFrame:
    """Parse each document's HTML tables once; later steps read the struct."""
    return docs.withColumn("html", classified_tables(F.col(markdown)))


def _header_lookup(row: Column, names: Column, aliases: list[str]) -> list[Column]:
    """Cell for each alias; of equal headers the last column counts."""
    cells = []
    for alias in aliases:
        size = F.size(names)
        last = size - F.array_position(F.reverse(names), F.lit(alias))
        present = F.array_contains(names, alias)
        cells.append(F.when(present, F.get(row, last.cast("int"))))
    return cells


def bank_fields_from_html(bank: Column) -> dict[str, Column]:
    """Bank columns from the first row of the bank table, by header alias.

    The first alias that is a header decides the column, even if its cell is empty.
    """
    names = F.transform(bank["header"], lambda h: F.replace(F.lower(strip(h)), F.lit(" "), F.lit("")))
    row = F.get(bank["rows"], F.lit(0))

    def cell_by(aliases: list[str]):
        def cell_of(names: Column) -> Column:
            chain = None
            for alias, cell in zip(aliases, _header_lookup(row, names, aliases)):
                has = F.array_contains(names, alias)
                chain = F.when(has, cell) if chain is None else chain.when(has, cell)
            return chain

        return cell_of

    out = {}
    for target, aliases in rules.BANK_ALIASES.items():
        value = strip(_let(names, cell_by(aliases)))
        usable = F.when((F.length(value) > 0) & ~F.lower(value).isin("nan", "none"), value)
        cleaned = clean(usable, rules.BANK_CLEANERS.get(target, "text"))
        if target == "Vendor_PAN_No":
            cleaned = F.when(checks.is_pan(cleaned), cleaned)
        out[target] = cleaned
    return out


# --- invoice items -------------------------------------------------------------------------

def parse_content_line(content: Column) -> dict[str, Column]:
    """Region and rates hidden in an item's raw lines, classified by shape."""
    lines = F.filter(F.transform(F.split(content, "\n"), strip), lambda x: x != "")
    whole = r"\A[0-9,]+\z"
    percent = r"\A[0-9]+(\.[0-9]+)?%\z"
    plain = r"\A[0-9]+(\.[0-9]+)?\z"
    rates = F.transform(
        F.filter(lines, lambda x: x.rlike(percent)), lambda x: F.rtrim(x, F.lit("%")).try_cast("double")
    )
    numbers = F.filter(lines, lambda x: x.rlike(plain) & ~x.rlike(whole))
    regions = F.filter(
        lines, lambda x: x.rlike(r"\A[A-Za-z .]{2,30}\z") & ~x.rlike("(?i)PVT|LTD|LIMITED|SERVICES")
    )
    n = F.size(rates)
    at = lambda i: F.get(rates, F.lit(i))
    return {
        "Region": F.try_element_at(regions, F.lit(-1)),
        "ROI_Percent": F.get(numbers, F.lit(0)).try_cast("double"),
        "PF_Percent": F.when(n >= 2, at(0)),
        "Payout_Percent": F.when(n >= 3, at(1)),
        "Subvention_Percent": F.when(n == 1, at(0)).when(n == 2, at(1)).when(n >= 3, at(2)),
    }


def items_from_array(docs: DataFrame, items: str = "items") -> DataFrame:
    """Structured item list to rows, numbered from 1 in list order.

    Needs ``doc_id, Invoice_No`` and ``items`` as an array of structs with
    ``content`` and ``valueObject`` (a map of typed field cells by name).
    """
    from fieldloom.sources.analysis import pick_field

    one = docs.select("doc_id", "Invoice_No", F.posexplode(items).alias("pos", "item"))
    names = ["Description", "Amount", *rules.ITEM_VALUES.values()]
    one = one.withColumns({
        f"_{n}": F.try_element_at(F.col("item.valueObject"), F.lit(n)) for n in names
    })
    value = lambda name: pick_field(f"_{name}")
    return one.select(
        "doc_id", "Invoice_No", (F.col("pos") + 1).alias("Sr_No"),
        clean(value("Description")).alias("Item_Description"),
        *[value(source).alias(target) for target, source in rules.ITEM_VALUES.items()],
        checks.to_money(value("Amount")).alias("Total_Amount"),
        *[c.alias(name) for name, c in parse_content_line(F.coalesce("item.content", F.lit(""))).items()],
    )


def items_from_html(docs: DataFrame, table: Column) -> DataFrame:
    """Item rows of the invoice table by header alias; all-empty rows are dropped.

    For each target the first alias with a non-empty cell is taken; all but the
    text columns are read as two-decimal numbers.
    """
    names = F.transform(table["header"], lambda h: F.lower(strip(h)))
    one = docs.select(
        "doc_id", "Invoice_No", names.alias("names"), F.posexplode(table["rows"]).alias("pos", "row")
    )
    columns = {}
    for target, aliases in rules.ITEM_ALIASES.items():
        cell = F.coalesce(*_header_lookup(F.col("row"), F.col("names"), aliases))
        columns[target] = cell if target in rules.ITEM_TEXT_COLUMNS else checks.to_money(cell)
    rows = one.select(
        "doc_id", "Invoice_No", (F.col("pos") + 1).alias("Sr_No"), *[c.alias(n) for n, c in columns.items()]
    )
    return rows.where(F.coalesce(*[F.col(n).cast("string") for n in columns]).isNotNull())


def choose_items(from_array: DataFrame, from_html: DataFrame) -> DataFrame:
    """Structured items where a document has any, table items otherwise."""
    rest = from_html.join(from_array.select("doc_id"), "doc_id", "left_anti")
    return from_array.unionByName(rest, allowMissingColumns=True)


def with_invoice_number(items: DataFrame, records: DataFrame) -> DataFrame:
    """Give item rows the merged invoice number of their document, when it has one."""
    merged = records.select("doc_id", empty_to_null(F.col("Invoice_No")).alias("_merged"))
    return items.join(merged, "doc_id", "left").withColumn(
        "Invoice_No", F.coalesce("_merged", "Invoice_No")
    ).drop("_merged")
