"""Tax from detail lines and record-level amount derivation.

Money is DECIMAL(18,2), rounded half up.  In a record a column may be null
(absent) or zero; ``_none`` says whether it counts as empty.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldloom import rules
from fieldloom.functions import checks, dates
from fieldloom.functions.text import empty_to_null, extract, strip
from fieldloom.operators.ranking import sorted_once
from fieldloom.session import written

MONEY = "decimal(18,2)"


def _zero() -> Column:
    return F.lit(0).cast(MONEY)


def _money(c: Column) -> Column:
    return c.try_cast(MONEY)


def _none(c: Column) -> Column:
    return c.isNull() | (c == 0)


def tax_label(content: Column) -> Column:
    """Tax type named in a detail line; the first type with a matching spelling."""
    low = F.lower(strip(content))
    chain = None
    for kind, spellings in rules.TAX_LABELS:
        hit = F.lit(False)
        for s in spellings:
            hit = hit | low.contains(s)
        chain = F.when(hit, kind) if chain is None else chain.when(hit, kind)
    return chain


# --- tax lines as rows ---------------------------------------------------------------

def tax_from_lines(lines: DataFrame) -> DataFrame:
    """CGST/SGST/IGST per document from ordered lines ``doc_id, seq, content, amount``.

    A label stays pending until the first amount after it, which it claims; so an
    amount counts exactly when no other amount lies between it and the last label
    at or before it.  Per tax type the first claimed non-zero amount is kept.

    Both "last before" values are running maxima.  The few columns needed are sorted
    once into ranges of equal size; maxima are taken inside a range and the earlier
    ranges' maxima are carried in.  A document with most of all lines spans many
    ranges, whatever its positions are, and has one carried row for each.
    """
    # written before the sort, whose sampling would compute the lines a second time
    narrow = written(lines.select(
        "doc_id", "seq", F.col("amount").cast(MONEY).alias("amount"), tax_label(F.col("content")).alias("kind")), "tax-lines")
    marked = sorted_once(narrow, ["doc_id", "seq"]).withColumnRenamed("_part", "blk")
    label = F.when(F.col("kind").isNotNull(), F.struct("seq", "kind"))
    paid = F.when(F.col("amount").isNotNull(), F.col("seq"))

    inside = Window.partitionBy("doc_id", "blk").orderBy("seq")
    here = marked.withColumns({
        "l": F.max(label).over(inside.rowsBetween(Window.unboundedPreceding, 0)),
        "p": F.max(paid).over(inside.rowsBetween(Window.unboundedPreceding, -1)),
    })
    earlier = Window.partitionBy("doc_id").orderBy("blk").rowsBetween(Window.unboundedPreceding, -1)
    carried = (
        marked.groupBy("doc_id", "blk").agg(F.max(label).alias("bl"), F.max(paid).alias("bp"))
        .select("doc_id", "blk", F.max("bl").over(earlier).alias("cl"), F.max("bp").over(earlier).alias("cp"))
        .where(F.col("cl").isNotNull() | F.col("cp").isNotNull())
    )
    # every document keeps its rows up to the last aggregate, so none is lost and nothing is joined back
    last, before = F.coalesce("l", "cl"), F.coalesce("p", "cp")
    claims = last.isNotNull() & (before.isNull() | (before < last["seq"])) & (F.col("amount") != 0)
    return here.join(carried, ["doc_id", "blk"], "left").groupBy("doc_id").agg(*[
        F.coalesce(F.min_by("amount", F.when(claims & (last["kind"] == kind), F.col("seq"))), _zero()).alias(kind)
        for kind, _ in rules.TAX_LABELS
    ])


def rate_from_line(rate: Column, content: Column) -> Column:
    """Rate of one line: the numeric one when in (0, 100], else a percentage in its text."""
    usable = lambda c: F.when((c > 0) & (c <= 100), c)
    written = extract(strip(content), r"([0-9]+(?:\.[0-9]+)?)\s*%")
    return F.coalesce(usable(rate.try_cast("decimal(18,6)")), usable(written.try_cast("decimal(18,6)")))


def rates_from_lines(lines: DataFrame) -> DataFrame:
    """First usable rate per document from ``doc_id, seq, content, rate``."""
    return lines.select(
        "doc_id", "seq", rate_from_line(F.col("rate"), F.col("content")).alias("rate")
    ).groupBy("doc_id").agg(F.min_by("rate", F.when(F.col("rate").isNotNull(), F.col("seq"))).alias("rate"))


# --- tax lines inside a record ----------------------------------------------------------

def tax_from_array(lines: Column) -> Column:
    """The same rule for lines that already sit in one record: an ordered fold."""
    kinds = [kind for kind, _ in rules.TAX_LABELS]
    start = F.struct(
        F.lit(None).cast("string").alias("pending"), *[_zero().alias(k) for k in kinds]
    )

    def step(state: Column, line: Column) -> Column:
        amount = line["valueObject"]["Amount"]["valueCurrency"]["amount"].try_cast(MONEY)
        pending = F.coalesce(tax_label(line["content"]), state["pending"])
        open_now = F.lit(False)
        for k in kinds:
            open_now = open_now | ((pending == k) & (state[k] == 0))
        claims = F.coalesce(open_now & amount.isNotNull(), F.lit(False))
        return F.struct(
            F.when(~claims, pending).alias("pending"),
            *[F.when(claims & (pending == k), amount).otherwise(state[k]).alias(k) for k in kinds],
        )

    return F.aggregate(F.coalesce(lines, F.array()), start, step)


def rate_from_array(lines: Column) -> Column:
    rates = F.transform(
        lines,
        lambda x: rate_from_line(x["valueObject"]["Rate"]["valueNumber"], F.coalesce(x["content"], F.lit(""))),
    )
    return F.get(F.filter(rates, lambda r: r.isNotNull()), F.lit(0))


# --- record-level arithmetic --------------------------------------------------------------

def _all_zero() -> Column:
    return (F.col("CGST") == 0) & (F.col("SGST") == 0) & (F.col("IGST") == 0)


def same_state(vendor_gstin: Column, company_gstin: Column) -> Column:
    vendor = F.substring(vendor_gstin, 1, 2)
    digits = r"\A[0-9]{1,2}\z"
    return F.coalesce(
        vendor.rlike(digits) & (vendor == F.substring(company_gstin, 1, 2)), F.lit(False)
    )


def base_from_tax(df: DataFrame) -> DataFrame:
    """Base = total - tax, when 0 < tax < total and no base is given."""
    tax = F.col("CGST") + F.col("SGST") + F.col("IGST")
    total = F.col("Total_Payable")
    usable = (total > 0) & (tax > 0) & (tax < total) & F.col("Amount_Before_GST").isNull()
    return df.withColumn(
        "Amount_Before_GST", F.when(usable, _money(total - tax)).otherwise(F.col("Amount_Before_GST"))
    )


def split_by_rate(df: DataFrame, rate: str = "rate") -> DataFrame:
    """Only when all three taxes are zero and a rate and a total are known:
    base = 100 / (100 + rate) x total; tax to halves (same state) or IGST."""
    total = F.col("Total_Payable")
    use = F.coalesce(_all_zero() & F.col(rate).isNotNull() & (total > 0), F.lit(False))
    base = _money(total * 100 / (F.lit(100) + F.col(rate)))
    tax = _money(total - base)
    half = _money(tax / 2)
    same = same_state(F.col("Vendor_GSTIN"), F.col("Company_GSTIN"))
    return df.withColumns({
        "Amount_Before_GST": F.when(use & F.col("Amount_Before_GST").isNull(), base).otherwise(F.col("Amount_Before_GST")),
        "CGST": F.when(use, F.when(same, half).otherwise(_zero())).otherwise(F.col("CGST")),
        "SGST": F.when(use, F.when(same, half).otherwise(_zero())).otherwise(F.col("SGST")),
        "IGST": F.when(use, F.when(same, _zero()).otherwise(tax)).otherwise(F.col("IGST")),
    })


def split_by_state(df: DataFrame, rate: str = "rate") -> DataFrame:
    """Without a rate or a total: split the known tax, else total less subtotal."""
    total = F.coalesce("Total_Payable", "TotalAmount")
    subtotal = F.col("Amount_Before_GST")
    known = F.coalesce(F.when(F.col("Total_Tax") != 0, F.col("Total_Tax")), F.col("TotalTaxAmount"))
    gap = F.when(~_none(total) & ~_none(subtotal) & (total > subtotal), total - subtotal)
    tax = _money(F.coalesce(known, gap))
    use = F.coalesce(
        _all_zero() & (F.col(rate).isNull() | F.col("Total_Payable").isNull()) & ~_none(tax), F.lit(False)
    )
    half = _money(tax / 2)
    same = same_state(F.col("Vendor_GSTIN"), F.col("Company_GSTIN"))
    return df.withColumns({
        "CGST": F.when(use & same, half).otherwise(F.col("CGST")),
        "SGST": F.when(use & same, half).otherwise(F.col("SGST")),
        "IGST": F.when(use & ~same, tax).otherwise(F.col("IGST")),
    })


def gst_amounts(df: DataFrame, rate: str = "rate") -> DataFrame:
    """Base from known taxes, then the split by rate or else by state; the last
    two exclude each other by their conditions."""
    return split_by_state(split_by_rate(base_from_tax(df), rate), rate)


def derive_totals(df: DataFrame) -> DataFrame:
    """Total tax, base, TotalTaxAmount and TotalAmount, each only when empty."""
    tax = F.col("CGST") + F.col("SGST") + F.col("IGST")
    payable = F.col("Total_Payable")
    step1 = df.withColumn(
        "Total_Tax", F.when(_none(F.col("Total_Tax")) & (tax > 0), _money(tax)).otherwise(F.col("Total_Tax"))
    )
    rest = _money(payable - tax)
    missing = _none(F.col("Amount_Before_GST")) & _none(F.col("Amount_Before_GST_1"))
    some = (F.col("CGST") > 0) | (F.col("SGST") > 0) | (F.col("IGST") > 0)
    step2 = step1.withColumn(
        "Amount_Before_GST",
        F.when(missing & ~_none(payable) & some & (rest > 0), rest).otherwise(F.col("Amount_Before_GST")),
    )
    step3 = step2.withColumn(
        "TotalTaxAmount",
        F.when(_none(F.col("TotalTaxAmount")) & ~_none(F.col("Total_Tax")), F.col("Total_Tax"))
        .otherwise(F.col("TotalTaxAmount")),
    )
    base, total_tax = F.col("Amount_Before_GST"), F.col("Total_Tax")
    return step3.withColumn(
        "TotalAmount",
        F.when(
            _none(F.col("TotalAmount")),
            F.when(~_none(base) & ~_none(total_tax), _money(base + total_tax))
            .when(~_none(payable), payable)
            .otherwise(F.col("TotalAmount")),
        ).otherwise(F.col("TotalAmount")),
    )


def normal_date(c: Column) -> Column:
    """ISO text stays; else the first date found in it; else unchanged."""
    return F.when(dates.is_iso(c), c).otherwise(F.coalesce(dates.find_date(c), c))




def company_name(name: Column, raw: Column) -> Column:
    """One lender's name overrides when the raw result speaks of it."""
    low = F.lower(raw)
    spoken = F.lit(True)
    for word in rules.LENDER_WORDS:
        spoken = spoken & low.contains(word)
    return F.when(spoken, rules.LENDER_NAME).otherwise(name)


def repair_identifiers(df: DataFrame) -> DataFrame:
    """GSTIN repair first, then PANs from the repaired GSTINs where none is given."""
    repaired = df.withColumns({
        c: checks.repair_gstin(F.col(c)) for c in ("Vendor_GSTIN", "Company_GSTIN")
    })
    return repaired.withColumns({
        pan: F.coalesce(empty_to_null(F.col(pan)), checks.pan_from_gstin(F.col(gstin)))
        for pan, gstin in (("Vendor_PAN_No", "Vendor_GSTIN"), ("Company_PAN_No", "Company_GSTIN"))
    })
