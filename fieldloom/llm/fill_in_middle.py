"""Fill-in-middle: a text is cut at token borders and its middle moved to the end.

``regexp_count`` gives a text's tokens.  Two borders are drawn from a hash of the id, and one
pattern made for the row captures what lies before, between and behind them: the token as a
possessive group counted {a} times, again counted {b - a} times, and the rest.  A possessive
group gives nothing back, so the match is one pass over the text and keeps no stack of tries,
however long the text.  The same match writes the output, as the groups in their new order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# fixed values: a token, and the marks put before prefix, suffix and middle
TOKEN = r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+"
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"

FIM_PERCENT = 50      # texts of a hundred that are rearranged
SPM_PERCENT = 80      # rearranged texts of a hundred that begin with the suffix
SEED = 42
LAYOUT = {"psm": f"{PREFIX}$1{SUFFIX}$3{MIDDLE}$2", "spm": f"{SUFFIX}$3{PREFIX}$1{MIDDLE}$2"}


def draws(row_id: Column, seed: int) -> Column:
    """Four 32-bit numbers from the sha256 of seed and id."""
    said = F.sha2(F.encode(F.concat(F.lit(f"{seed}:"), F.coalesce(row_id.cast("string"), F.lit(""))), "utf-8"), 256)
    return F.array(*[F.conv(F.substring(said, 1 + 8 * k, 8), 16, 10).cast("long") for k in range(4)])


def cut_pattern(before: Column, between: Column) -> Column:
    """The pattern of one row: ``before`` tokens, then ``between`` tokens, then the rest."""
    unit = F.lit(f"((?:{TOKEN}){{")
    return F.concat(F.lit(r"(?s)\A"), unit, before.cast("string"), F.lit("}+)"), unit, between.cast("string"), F.lit(r"}+)(.*)\z"))


def restore(output: Column, form: Column) -> Column:
    """The text that was rearranged.  It held no mark, so each mark of the output is found where it was put."""
    part = "(.*?)"
    psm = F.regexp_replace(output, rf"(?s)\A{PREFIX}{part}{SUFFIX}{part}{MIDDLE}(.*)\z", "$1$3$2")
    spm = F.regexp_replace(output, rf"(?s)\A{SUFFIX}{part}{PREFIX}{part}{MIDDLE}(.*)\z", "$2$3$1")
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)


def fill_in_middle(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = (),
    fim_percent: int = FIM_PERCENT, spm_percent: int = SPM_PERCENT, seed: int = SEED,
) -> DataFrame:
    """One row for each input row: id, the carried columns, n, form, output, prefix_chars and middle_chars.

    n counts the text's tokens: a word with the whitespace before it, or whitespace at the end.
    form is "psm", "spm" or "plain"; a plain output is the text itself and has null lengths.
    Lengths are code points.  A null text counts as empty.  Empty texts and texts that hold a
    mark are plain.  Draws hang on the id alone: repeated rows are cut alike, a null id draws
    as an empty one.  Either cut may fall on an end, which leaves parts empty.  Other columns
    are not read.  An empty table gives no rows.
    """
    rows = docs.select(
        F.col(id_col).alias("c0"), *[F.col(c).alias(f"c{k + 1}") for k, c in enumerate(carry)],
        F.coalesce(F.col(text_col), F.lit("")).alias("text"), draws(F.col(id_col), seed).alias("h"))
    held = [f"c{k}" for k in range(len(carry) + 1)]
    counted = rows.select("*", F.regexp_count("text", F.lit(TOKEN)).cast("long").alias("n"))
    marked = F.greatest(*[F.contains("text", F.lit(m)) for m in (PREFIX, SUFFIX, MIDDLE)])
    x, y = F.col("h")[0] % (F.col("n") + 1), F.col("h")[1] % (F.col("n") + 1)
    form = (
        F.when((F.col("text") == "") | marked | (F.col("h")[2] % 100 >= fim_percent), "plain")
        .when(F.col("h")[3] % 100 < spm_percent, "spm").otherwise("psm"))
    drawn = counted.select(*held, "text", "n", F.least(x, y).alias("a"), F.greatest(x, y).alias("b"), form.alias("form"))
    layout = F.when(F.col("form") == "psm", LAYOUT["psm"]).otherwise(LAYOUT["spm"])
    moved = F.regexp_replace("text", cut_pattern(F.col("a"), F.col("b") - F.col("a")), layout)
    out = drawn.select(*held, "n", "form", F.when(F.col("form") == "plain", F.col("text")).otherwise(moved).alias("output"))
    # each mark is three characters; the prefix ends where the next part's mark begins
    ends = F.when(F.col("form") == "psm", F.instr("output", SUFFIX) - 4).when(
        F.col("form") == "spm", F.instr("output", MIDDLE) - F.instr("output", PREFIX) - 3)
    middle = F.when(F.col("form") != "plain", F.length("output") - F.instr("output", MIDDLE) - 2)
    return out.select(*held, "n", "form", "output", ends.cast("long").alias("prefix_chars"), middle.cast("long").alias("middle_chars")).toDF(
        id_col, *carry, "n", "form", "output", "prefix_chars", "middle_chars")
