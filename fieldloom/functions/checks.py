"""Validators: text in, never-null boolean (or cleaned value) out."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from fieldloom import rules
from fieldloom.functions import dates
from fieldloom.functions.text import ascii_edges, empty_to_null, extract, keep_letters_digits, strip


def _sure(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


def _without(c: Column, *parts: str) -> Column:
    for part in parts:
        c = F.replace(c, F.lit(part), F.lit(""))
    return c


# --- single-value checks -------------------------------------------------------

def is_pan_number(c: Column) -> Column:
    return _sure(F.upper(_without(c, " ")).rlike(rf"\A{rules.PAN_PATTERN}\z"))


def is_aadhaar_number(c: Column) -> Column:
    return _sure(F.translate(c, " -", "").rlike(r"\A[0-9]{12}\z"))


def is_email(c: Column) -> Column:
    return _sure(c.rlike(r"\A[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}\n?\z"))


def is_phone(c: Column) -> Column:
    bare = F.translate(c, " -()", "")
    return _sure(F.regexp_replace(bare, r"\A\+91", "").rlike(r"\A[0-9]{10,15}\z"))


is_date = dates.is_date


_DIGITS = "[0-9]+(?:_[0-9]+)*"
_NUMBER = rf"(?:{_DIGITS}\.?(?:{_DIGITS})?|\.{_DIGITS})(?:[eE][+-]?{_DIGITS})?"
_ZERO = r"(?:0[0_]*\.?[0_]*|\.0[0_]*)(?:[eE][+-]?[0-9_]+)?"


def is_amount_text(c: Column) -> Column:
    """Currency text whose number is not below zero; decided without a cast, so
    not-a-number text cannot slip through a comparison."""
    bare = strip(_without(F.translate(c, ",$€£₹", ""), "INR"))
    return _sure(bare.rlike(rf"\A(?:\+?(?:{_NUMBER}|(?i:inf|infinity))|-{_ZERO})\z"))


def is_amount(c: Column, value_type: Column) -> Column:
    return _sure(
        F.when(value_type == "str", is_amount_text(c))
        .when(value_type.isin("int", "float"), c.try_cast("double").between(0, float("inf")))
        .when(value_type == "bool", True)
    )


def is_present(c: Column, value_type: Column) -> Column:
    """Non-empty by type: blank text, empty list and empty dict are absent."""
    return _sure(
        F.when(c.isNull() | (value_type == "NoneType"), False)
        .when(value_type == "str", F.length(strip(c)) > 0)
        .when(value_type.isin("list", "dict"), ~c.isin("[]", "{}"))
        .otherwise(True)
    )


def is_truthy(c: Column, value_type: Column) -> Column:
    """Zero, False, empty text, empty list and null count as missing."""
    return _sure(
        F.when(c.isNull() | (value_type == "NoneType"), False)
        .when(value_type == "bool", F.lower(c) == "true")
        .when(value_type.isin("int", "float"), c.try_cast("double") != 0)
        .when(value_type.isin("list", "dict"), ~c.isin("[]", "{}"))
        .otherwise(F.length(c) > 0)
    )


def field_ok(name: Column, value: Column, value_type: Column) -> Column:
    """Pick the check from the field name (substring rules in order)."""
    return named_ok(F.lower(name), value, value_type)


def named_ok(low: Column, value: Column, value_type: Column) -> Column:
    """``field_ok`` of a name that is lowered already: as a column of its own it is lowered once, not once for each rule."""
    has = lambda *words: _any(low, words)
    text = value_type == "str"
    return (
        F.when(~is_truthy(value, value_type), True)
        .when(low.contains("pan") & low.contains("number"), text & is_pan_number(value))
        .when(has("aadhaar", "uid"), text & is_aadhaar_number(value))
        .when(has("email"), text & is_email(value))
        .when(has("phone", "mobile", "contact"), text & is_phone(value))
        .when(low.contains("date") & ~low.contains("birth"), text & is_date(value))
        .when(has("amount", "price", "cost"), is_amount(value, value_type))
        .otherwise(True)
    )


def _any(c: Column, words) -> Column:
    hit = F.lit(False)
    for word in words:
        hit = hit | c.contains(word)
    return hit


# --- tax identifiers -----------------------------------------------------------

def repair_gstin(c: Column) -> Column:
    """Undo letter/digit confusion by position; only 15-character values change."""
    digit = lambda s, n: F.translate(F.substring(c, s, n), *rules.DIGIT_REPAIR)
    letter = lambda s, n: F.translate(F.substring(c, s, n), *rules.LETTER_REPAIR)
    fixed = F.concat(
        digit(1, 2), letter(3, 5), digit(8, 4), letter(12, 1), digit(13, 1), F.lit("Z"), F.substring(c, 15, 1)
    )
    return F.when(F.length(c) == 15, fixed).otherwise(c)


def pan_from_gstin(c: Column) -> Column:
    inner = F.substring(c, 3, 10)
    return F.when((F.length(c) == 15) & inner.rlike(rf"\A{rules.PAN_PATTERN}\z"), inner)


def is_pan(c: Column) -> Column:
    return _sure(keep_letters_digits(c).rlike(rf"\A{rules.PAN_PATTERN}\z"))


def is_ifsc(c: Column) -> Column:
    return _sure(c.rlike(rf"\A{rules.IFSC_PATTERN}\z"))


def find_ifsc(text: Column) -> Column:
    """Labelled code, then a code of a known bank, then any code."""
    all_codes = F.regexp_extract_all(F.upper(text), F.lit(ascii_edges(rf"\b({rules.IFSC_PATTERN})\b")), F.lit(1))
    known = F.filter(all_codes, lambda x: F.substring(x, 1, 4).isin(rules.IFSC_BANK_CODES))
    return F.coalesce(
        F.upper(extract(text, rules.TEXT_PATTERNS["labelled_ifsc"])),
        F.upper(extract(text, rules.TEXT_PATTERNS["ifsc_then_label"])),
        F.get(known, F.lit(0)),
        F.get(all_codes, F.lit(0)),
    )


# --- typed values --------------------------------------------------------------

def to_money(c: Column) -> Column:
    """Two-decimal number; thousands commas dropped, anything unreadable is null."""
    return strip(F.replace(c, F.lit(","), F.lit(""))).try_cast("decimal(18,2)")


def lenient_bool(c: Column, is_number: Column | None = None) -> Column:
    """Common yes/no words; anything else is unknown (null), never an error.

    Where ``is_number`` holds the value was a number, which is true unless it is zero.
    """
    word = F.lower(strip(c))
    said = F.when(word.isin(rules.TRUE_WORDS), True).when(word.isin(rules.FALSE_WORDS), False)
    return said if is_number is None else F.when(is_number, c.try_cast("double") != 0).otherwise(said)


def twelve_digits(c: Column) -> Column:
    digits = F.regexp_replace(c, "[^0-9]", "")
    return F.when(F.length(digits) == 12, digits)


def six_digits(c: Column) -> Column:
    return F.when(c.rlike(r"\A[0-9]{6}\z"), c)


def slash_date(c: Column) -> Column:
    return F.when(c.rlike(r"\A[0-9]{2}/[0-9]{2}/[0-9]{4}\z"), c)


def strict_pan(c: Column) -> Column:
    bare = _without(F.upper(strip(c)), " ")
    return F.when(bare.rlike(rf"\A{rules.PAN_PATTERN}\z"), bare)


def strict_ifsc(c: Column) -> Column:
    bare = F.upper(strip(c))
    return F.when(is_ifsc(bare), bare)


def aadhaar_or_masked(c: Column) -> Column:
    """Digits when there are twelve; a masked form is kept as it is."""
    return F.coalesce(twelve_digits(c), c)


def loose_number(c: Column) -> Column:
    """Digits and dots of the text as a number, null when they form none."""
    kept = empty_to_null(F.regexp_replace(c, "[^0-9.]", ""))
    return F.when(kept.rlike(r"\A(?:[0-9]+\.?[0-9]*|\.[0-9]+)\z"), kept.try_cast("double"))
