"""Dates in text, decided by regular expressions.

Calendar rules (month lengths, leap years) are part of the patterns, so a check is
one regex match: no parser runs and no exception is raised and caught for text
that is not a date, which is what dominates the cost of ``try_to_timestamp`` on
dirty input.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from fieldloom import rules
from fieldloom.functions.text import ascii_edges

MONTH_NAMES = "|".join(rules.MONTHS)
MONTH_SHORT = "|".join(m[:3] for m in rules.MONTHS)

_YEAR = "(?!0000)[0-9]{4}"
_LEAP_YEAR = "(?!0000)(?:[0-9]{2}(?:0[48]|[2468][048]|[13579][26])|(?:[02468][048]|[13579][26])00)"

# month spelling -> patterns of: any month, 30 days or more, 31 days, February
_LONG = [m for m in rules.MONTHS if m not in ("February", "April", "June", "September", "November")]
_NUMBER_MONTHS = ("(?:0?[1-9]|1[0-2])", "(?:0?[13-9]|1[0-2])", "(?:0?[13578]|1[02])", "0?2")
_NAMED_MONTHS = (
    f"(?:{MONTH_NAMES})", f"(?:{'|'.join(m for m in rules.MONTHS if m != 'February')})",
    f"(?:{'|'.join(_LONG)})", "February",
)


def _existing_day(shape: str, months: tuple) -> str:
    """Pattern for existing days in a shape with the places ``D``, ``M`` and ``Y``."""
    any_month, month_30, month_31, february = months
    choices = [
        ("(?:0?[1-9]| [1-9]|1[0-9]|2[0-8])", any_month, _YEAR),
        ("(?:29|30)", month_30, _YEAR),
        ("31", month_31, _YEAR),
        ("29", february, _LEAP_YEAR),
    ]
    return "|".join("".join({"D": d, "M": m, "Y": y}.get(ch, ch) for ch in shape) for d, m, y in choices)


_SPACE = r"\s+"
_NUMERIC = [_existing_day(shape, _NUMBER_MONTHS) for shape in ("Y-M-D", "D-M-Y", "Y/M/D", "D/M/Y", "M/D/Y")]
_NAMED = [_existing_day(shape, _NAMED_MONTHS).replace("~", _SPACE) for shape in ("D~M~Y", "M~D,~Y")]

# a whole text that is a date in one of the accepted formats
ACCEPTED = rf"(?i)\A(?:{'|'.join(_NUMERIC + _NAMED)})\z"
# the first format alone, and its fully padded form
ISO_LIKE = rf"\A(?:{_NUMERIC[0]})\z"

FINDER = rules.DATE_FINDER


def is_date(c: Column) -> Column:
    """True when the whole text is a date in one of the accepted formats."""
    return F.coalesce(c.rlike(ACCEPTED), F.lit(False))


def is_iso(c: Column) -> Column:
    return F.coalesce(c.rlike(ISO_LIKE), F.lit(False))


def _if_real(iso: Column) -> Column:
    return F.when(iso.rlike(ISO_LIKE), iso)


def _month_digits(name: Column) -> Column:
    """Two-digit month of an English name, by its place in the year."""
    place = F.instr(F.lit(MONTH_SHORT.replace("|", "")), F.substring(name, 1, 3))
    return F.lpad(((place + 2) / 3).cast("int").cast("string"), 2, "0")


def _candidate_to_iso(c: Column) -> Column:
    """One finder candidate as ISO text, null when no format fits.

    Both separators must agree; day/month is tried before month/day, except for
    dots, which are always day first.
    """
    part = lambda start, n: F.substring(c, start, n)
    joined = lambda *parts: _if_real(F.concat_ws("-", *parts))
    day_first = r"\A([0-9]{1,2})\s+([A-Z][a-z]+),?\s+([0-9]{4})\z"
    name_first = r"\A([A-Z][a-z]+)\s+([0-9]{1,2}),\s*([0-9]{4})\z"
    group = lambda p, g: F.regexp_extract(c, p, g)
    return (
        F.when(c.rlike(r"\A[0-9]{4}([-/.])..\1..\z"), joined(part(1, 4), part(6, 2), part(9, 2)))
        .when(
            c.rlike(r"\A..([-/.])..\1[0-9]{4}\z"),
            F.coalesce(
                joined(part(7, 4), part(4, 2), part(1, 2)),
                F.when(part(3, 1) != ".", joined(part(7, 4), part(1, 2), part(4, 2))),
            ),
        )
        .when(
            c.rlike(day_first),
            joined(group(day_first, 3), _month_digits(group(day_first, 2)), F.lpad(group(day_first, 1), 2, "0")),
        )
        .when(
            c.rlike(name_first),
            joined(group(name_first, 3), _month_digits(group(name_first, 1)), F.lpad(group(name_first, 2), 2, "0")),
        )
    )


def find_date(text: Column) -> Column:
    """First candidate in the text that parses, as ISO; day/month before month/day."""
    candidates = F.regexp_extract_all(text, F.lit(ascii_edges(FINDER)), F.lit(1))
    return F.get(
        F.filter(F.transform(candidates, _candidate_to_iso), lambda x: x.isNotNull()), F.lit(0)
    )
