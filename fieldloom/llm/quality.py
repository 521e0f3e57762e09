"""Quality rules with thresholds that adapt to each language and source.

Each measured document adds its four ratios to quantile sketches of its (language,
source).  A sketch is a histogram whose buckets keep the ten leading bits of a value, so
a quantile is within 0.2 percent of the true one; sketches merge by adding counts, in any
order and with the same result.  A group of fewer than ``min_group`` documents uses the
merged sketch of its language, or of the whole corpus.  A value beyond a fence (a quartile
plus or minus ``spread`` times the interquartile range) rejects the document.

DataFrame functions only; the sketch and the verdict work on one narrow stored frame.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldloom.llm.common import SPACE_CLASS, stored

# metric: (counted column, scale, divided by, least interquartile range, whether low values are rejected too)
METRICS = {
    "symbols": ("n_symbols", 1000, "word_chars", 20, False),
    "dup_lines": ("n_dup_lines", 1000, "n_text_lines", 150, False),
    "repeats": ("n_repeat_words", 1000, "n_words", 120, False),
    "word_length": ("word_chars", 100, "n_words", 50, True),
}
SPREAD = 3
MIN_GROUP = 200
MEASURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_text_lines"]


def _bound(value: Column, use) -> Column:
    """use(value) with the value computed once, whatever how often it is referred to."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _repeat_words(words: Column) -> Column:
    """Words inside three-word windows that occur twice or more in the text."""
    n = F.size(words)
    windows = F.when(n < 3, F.expr("array()").cast("array<struct<k:string,i:int>>")).otherwise(
        F.transform(F.sequence(F.lit(0), n - 3), lambda i: F.struct(
            F.concat_ws(" ", F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)).alias("k"), i.alias("i"))))

    def covered(s: Column) -> Column:
        again = F.array_sort(F.array_compact(F.transform(s, lambda x, j: F.when(
            (x["k"] == F.get(s, j - 1)["k"]) | (x["k"] == F.get(s, j + 1)["k"]), x["i"]))))
        start = F.struct(F.lit(-3).alias("last"), F.lit(0).cast("long").alias("total"))
        return F.aggregate(again, start, lambda a, p: F.struct(
            p.alias("last"), (a["total"] + F.least(F.lit(3), p - a["last"])).alias("total")))["total"]

    return _bound(F.sort_array(windows), covered)


def measure(docs: DataFrame, id_col: str, text_col: str, keys: tuple[str, str], carry: tuple[str, ...] = ()) -> DataFrame:
    """Base measures of every whole text, as (id, lang, source, measures), carried columns as c0, c1, ..."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    words = F.array_remove(F.split(text, SPACE_CLASS + "+"), "")
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike("[^\\x20\\x09-\\x0D]"))
    from_words = _bound(words, lambda w: F.struct(
        F.size(w).cast("long").alias("n_words"), F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
        _repeat_words(w).alias("n_repeat_words")))
    from_lines = _bound(lines, lambda x: F.struct(
        F.size(x).cast("long").alias("n_text_lines"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines")))
    return docs.select(
        F.col(id_col).alias("id"), F.col(keys[0]).cast("string").alias("lang"), F.col(keys[1]).cast("string").alias("source"),
        from_words.alias("w"), from_lines.alias("l"), F.regexp_count(text, F.lit("[#*$%&|<>]")).cast("long").alias("n_symbols"),
        *[F.col(c).alias(f"c{n}") for n, c in enumerate(carry)],
    ).select("id", "lang", "source", "w.*", "l.*", "n_symbols", *[f"c{n}" for n in range(len(carry))])


def bucket(value: Column) -> Column:
    """The value with its ten leading bits kept."""
    step = F.pow(F.lit(2), F.greatest(F.length(F.bin(value)) - 10, F.lit(0))).cast("long")
    return value - value % step


def ratio(name: str) -> Column:
    over, scale, under, _, _ = METRICS[name]
    return F.expr(f"{over} * {scale}L div greatest({under}, 1L)")


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 50)


def sketches(measured: DataFrame) -> DataFrame:
    """(lang, source, metric, bucket, n): the mergeable sketches of documents that pass the base rules."""
    pairs = F.array(*[F.struct(F.lit(m).alias("metric"), bucket(ratio(m)).alias("bucket")) for m in METRICS])
    return (
        measured.where(~base_failed()).select("lang", "source", F.inline(pairs))
        .groupBy("lang", "source", "metric", "bucket").agg(F.count("*").alias("n"))
    )


def _quartiles(sketch: DataFrame, by: list[str]) -> DataFrame:
    """Quartiles of the sketches merged to ``by``; a sketch has few buckets, so its running sum is short."""
    from pyspark.sql import Window

    merged = sketch.groupBy(*by, "metric", "bucket").agg(F.sum("n").alias("n"))
    one = Window.partitionBy(*by, "metric")
    ranked = merged.select("*", F.sum("n").over(one.orderBy("bucket")).alias("below"), F.sum("n").over(one).alias("all"))
    return ranked.groupBy(*by, "metric").agg(
        F.max("all").alias("all"),
        F.min(F.when(F.col("below") * 4 >= F.col("all"), F.col("bucket"))).alias("q1"),
        F.min(F.when(F.col("below") * 4 >= F.col("all") * 3, F.col("bucket"))).alias("q3"))


def thresholds(measured: DataFrame, spread: int = SPREAD, min_group: int = MIN_GROUP) -> DataFrame:
    """One row for each (lang, source) that has measured documents: the fences of each metric."""
    sketch = stored(sketches(measured), "sketches")
    groups = sketch.select("lang", "source", "metric").distinct()
    own, lang, every = (_quartiles(sketch, by) for by in (["lang", "source"], ["lang"], []))
    pick = lambda c: F.when(F.col("o.all") >= min_group, F.col(f"o.{c}")).when(
        F.col("l.all") >= min_group, F.col(f"l.{c}")).otherwise(F.col(f"e.{c}"))
    # the corpus sketch has one row for each metric: four rows
    chosen = (
        groups.alias("g")
        .join(own.alias("o"), F.expr("g.lang <=> o.lang AND g.source <=> o.source AND g.metric = o.metric"))
        .join(lang.alias("l"), F.expr("g.lang <=> l.lang AND g.metric = l.metric"))
        .join(F.broadcast(every).alias("e"), F.expr("g.metric = e.metric"))
        .select("g.lang", "g.source", "g.metric", pick("q1").alias("q1"), pick("q3").alias("q3"))
    )
    wide = []
    for m, (_, _, _, least, low) in METRICS.items():
        reach = F.greatest(F.col("q3") - F.col("q1"), F.lit(least)) * spread
        wide.append(F.max(F.when(F.col("metric") == m, F.col("q3") + reach)).alias(f"{m}_high"))
        if low:
            wide.append(F.max(F.when(F.col("metric") == m, F.col("q1") - reach)).alias(f"{m}_low"))
    return chosen.groupBy("lang", "source").agg(*wide)


def quality_rules(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source",
    spread: int = SPREAD, min_group: int = MIN_GROUP, carry: tuple[str, ...] = (),
) -> DataFrame:
    """One row for each input row: id, measures, base_failed, kept and the carried columns.

    A null text has no words and fails the base rule.  Null languages and sources are
    groups of their own.  A value equal to its fence is kept.  Repeated rows are measured
    and judged one by one.  Other columns are not read, so names cannot clash.  An empty
    table gives no rows.
    """
    measured = stored(measure(docs, id_col, text_col, (lang_col, source_col), carry), "measures")
    # written, so that Spark knows that they are few before it joins a source of a third of all rows
    fences = stored(thresholds(measured, spread, min_group), "fences")
    joined = measured.alias("m").join(
        fences.alias("t"), F.expr("m.lang <=> t.lang AND m.source <=> t.source"), "left")
    beyond = F.lit(False)
    for m, (*_, low) in METRICS.items():
        beyond = beyond | (bucket(ratio(m)) > F.col(f"{m}_high"))
        if low:
            beyond = beyond | (bucket(ratio(m)) < F.col(f"{m}_low"))
    return joined.select(
        F.col("m.id").alias(id_col), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        base_failed().alias("base_failed"), (~base_failed() & ~F.coalesce(beyond, F.lit(False))).alias("kept"),
        *[F.col(f"c{n}").alias(c) for n, c in enumerate(carry)])
