"""Packing into optimal length buckets.

The histogram of lengths, rounded up to a multiple of ``align``, has at most ``max_len /
align`` rows whatever the corpus.  Dynamic programming over it chooses the bucket boundaries
that need the least padding in all.  Inside a bucket every sequence is padded to the
boundary, so a batch of ``budget`` tokens holds ``budget // boundary`` of them.

Ranks inside a bucket are made from ranks inside hashed shards and the counts of the shards
before, so that a bucket with a third of all rows is numbered by many tasks.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldloom.llm.common import SPACE_CLASS, stored

MAX_LEN = 2048
ALIGN = 8
BUCKETS = 16
BUDGET = 65_536
SHARD_ROWS = 50_000


def word_count(text: Column) -> Column:
    return F.size(F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE_CLASS + "+"), "")).cast("long")


def boundaries(levels: list[tuple[int, int]], buckets: int) -> list[int]:
    """Boundaries with the least padding, from (length, count) with distinct lengths.

    Every sequence is padded to the least boundary that is not below it.  Of equally good
    choices the one with fewer, then smaller boundaries is taken.
    """
    if not levels:
        return []
    sizes, counts = (np.array(x, np.int64) for x in zip(*sorted(levels)))
    n = len(sizes)
    below = np.concatenate([[0], np.cumsum(counts)])
    # least[k][j]: tokens after padding of the first j lengths in k buckets; a bucket (i, j] costs its count times sizes[j - 1]
    least = np.full((min(buckets, n) + 1, n + 1), np.iinfo(np.int64).max // 2)
    came = np.zeros_like(least)
    least[0, 0] = 0
    for k in range(1, len(least)):
        for j in range(k, n + 1):
            cost = least[k - 1, :j] + (below[j] - below[:j]) * sizes[j - 1]
            came[k, j] = cost.argmin()
            least[k, j] = cost[came[k, j]]
    k, j, out = int(least[:, n].argmin()), n, []
    while j:
        out.append(int(sizes[j - 1]))
        j, k = int(came[k, j]), k - 1
    return out[::-1]


def pack(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: Column | None = None,
    max_len: int = MAX_LEN, align: int = ALIGN, buckets: int = BUCKETS, budget: int = BUDGET,
) -> DataFrame:
    """One row for each piece of a document: id, piece, first_token, n_tokens, bucket, bucket_len, batch, slot.

    ``length`` gives a row's tokens; without it, words split at ASCII whitespace are counted.
    Rows longer than ``max_len`` are cut into consecutive pieces, so all tokens are packed.
    Batches are numbered inside their bucket and only the last of a bucket may have room.  A
    row without tokens (null or empty text, null length) has one piece without bucket and
    batch.  Repeated rows are packed one by one; null ids are allowed.  Other columns are not
    read unless ``length`` does.  An empty table gives no rows.
    """
    tokens = F.greatest(F.coalesce(length if length is not None else word_count(F.col(text_col)), F.lit(0)).cast("long"), F.lit(0))
    # written with a number of the row's own, which deals rows of one id over the shards
    own = stored(docs.select(F.col(id_col).alias("id"), tokens.alias("tokens")).withColumn("row", F.monotonically_increasing_id()), "lengths")
    last = F.greatest(F.ceil(F.col("tokens") / max_len) - 1, F.lit(0))
    pieces = own.select("id", "row", "tokens", F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("piece")).select(
        "id", "row", "piece", (F.col("piece") * max_len).alias("first_token"),
        F.least(F.col("tokens") - F.col("piece") * max_len, F.lit(max_len)).alias("n_tokens"))
    level = F.least(F.ceil(F.col("n_tokens") / align) * align, F.lit(max_len)).cast("long")
    # at most max_len / align rows
    histogram = pieces.where("n_tokens > 0").groupBy(level.alias("level")).agg(F.count("*").alias("n")).collect()
    edges = boundaries([(r["level"], r["n"]) for r in histogram], buckets)
    total = sum(r["n"] for r in histogram)
    shards = max(1, -(-total // SHARD_ROWS))
    bucket, size = F.lit(None).cast("int"), F.lit(None).cast("long")
    for n, edge in reversed(list(enumerate(edges))):
        inside = (F.col("n_tokens") > 0) & (F.col("n_tokens") <= edge)
        bucket, size = F.when(inside, n).otherwise(bucket), F.when(inside, F.lit(edge).cast("long")).otherwise(size)
    rows = pieces.select("*", bucket.alias("bucket"), size.alias("bucket_len"), F.pmod(F.xxhash64("row", "piece"), F.lit(shards)).alias("shard"))
    counts = rows.where("n_tokens > 0").groupBy("bucket", "shard").agg(F.count("*").alias("n"))
    before = Window.partitionBy("bucket").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("bucket", "shard", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    ranked = rows.where("n_tokens > 0").withColumn(
        "rank", F.row_number().over(Window.partitionBy("bucket", "shard").orderBy("id", "piece", "row")))
    per_batch = F.greatest(F.lit(1), F.floor(F.lit(budget) / F.col("bucket_len")))
    at = F.col("before") + F.col("rank") - 1
    placed = ranked.join(offsets, ["bucket", "shard"]).select(
        "id", "piece", "first_token", "n_tokens", "bucket", "bucket_len",
        F.floor(at / per_batch).alias("batch"), (at % per_batch).alias("slot"))
    empty = rows.where("n_tokens = 0").select(
        "id", "piece", "first_token", "n_tokens", "bucket", "bucket_len",
        F.lit(None).cast("long").alias("batch"), F.lit(None).cast("long").alias("slot"))
    return placed.unionByName(empty).withColumnRenamed("id", id_col)
