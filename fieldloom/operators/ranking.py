"""Row numbers over a whole table or a group without putting it in one task."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fieldloom.session import written

_SLOT = (1 << 33) - 1


def sorted_once(df: DataFrame, order: list) -> DataFrame:
    """Range-sort and store; each row keeps its partition and place in it.

    The written rows pin both: partition bounds come from sampling and would
    otherwise be free to move when rows are computed again.
    """
    ordered = df.sort(*order).select("*", F.monotonically_increasing_id().alias("_id"))
    return written(ordered, "sorted").select(
        "*", F.shiftright("_id", 33).alias("_part"), F.col("_id").bitwiseAND(F.lit(_SLOT)).alias("_place")
    )


def number_rows(df: DataFrame, order: list, name: str = "row_no") -> DataFrame:
    """``row_number`` over the whole table, 1-based, in a total order.

    Rows are range-partitioned by the sort; only one count per partition is
    brought together, and that list is as long as the number of partitions.
    """
    placed = sorted_once(df, order)
    counts = placed.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    return placed.join(F.broadcast(starts), "_part").select(
        *df.columns, (F.col("_start") + F.col("_place") + 1).alias(name)
    )


def number_in_group(df: DataFrame, group: list[str], order: list, name: str = "row_no") -> DataFrame:
    """``row_number`` inside each group, exact for groups of any size.

    After the range sort a large group simply spans several partitions.  Rows
    are numbered per (group, partition) piece; a group cut by a partition border
    adds the sizes of its earlier pieces, of which there are at most two per
    partition.
    """
    placed = sorted_once(df, [*group, *order])
    piece = placed.groupBy("_part", *group).agg(
        F.min("_place").alias("_first"), F.max("_place").alias("_last"), F.count(F.lit(1)).alias("_n")
    )
    ends = placed.groupBy("_part").agg(F.max("_place").alias("_end"))
    # only a partition's first and last piece can belong to a group that is cut
    border = piece.join(F.broadcast(ends), "_part").where((F.col("_first") == 0) | (F.col("_last") == F.col("_end")))
    before = Window.partitionBy(*group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    shifts = border.select(
        "_part", F.col("_first"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_shift")
    ).where("_shift > 0")
    firsts = piece.select("_part", *group, "_first")
    keys = ["_part", *group]
    joined = placed.alias("r").join(
        firsts.alias("f"), on=[F.col(f"r.{k}").eqNullSafe(F.col(f"f.{k}")) for k in keys]
    ).select("r.*", F.col("f._first").alias("_first"))
    return joined.join(F.broadcast(shifts), ["_part", "_first"], "left").select(
        *df.columns, (F.col("_place") - F.col("_first") + 1 + F.coalesce("_shift", F.lit(0))).alias(name)
    )


def number_by_key(df: DataFrame, key: list[str], order: list[str], name: str = "row_no", group: list[str] | None = None) -> DataFrame:
    """The same numbers for wide rows: only ``key``, ``group`` and ``order`` are sorted and written.

    ``key`` is shared by no two rows, nulls included; the number comes back by it, and
    the rows themselves are read once more instead of being written.
    """
    narrow = df.select(*dict.fromkeys([*key, *(group or []), *order]))
    numbered = number_in_group(narrow, group, order, "_number") if group else number_rows(narrow, order, "_number")
    numbers = numbered.select(*[F.col(k).alias(f"_key{n}") for n, k in enumerate(key)], "_number")
    same = reduce(lambda a, b: a & b, [df[k].eqNullSafe(numbers[f"_key{n}"]) for n, k in enumerate(key)])
    return df.join(numbers, same).select(*[df[c] for c in df.columns], F.col("_number").alias(name))


def chunk_rows(df: DataFrame, order: list, size: int, key: list[str] | None = None) -> DataFrame:
    """Consecutive chunks of ``size`` rows: adds ``chunk_no`` from 0.  With ``key``, as in ``number_by_key``."""
    numbered = number_by_key(df, key, order, "_row") if key else number_rows(df, order, "_row")
    return numbered.select(
        *df.columns, F.floor((F.col("_row") - 1) / size).cast("bigint").alias("chunk_no")
    )
