"""Connected components of a distributed edge list by large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldloom.llm.common import stored


def _state(edges: DataFrame) -> tuple[int, int]:
    row = edges.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("u", "v").bitwiseAND(0xFFFFFFFF)), F.lit(0))).first()
    return int(row[0]), int(row[1])


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node with an edge; root is the smallest node of its component.

    ``edges`` has columns u and v of one type.  Each round links every node's larger
    neighbours, then its smaller ones, to the smallest of them; the rounds needed grow with
    the logarithm of the longest chain.  Only per-node minima are aggregated, so a node with
    very many neighbours is combined before it is shuffled.
    """
    pairs = stored(edges.where(F.col("u") != F.col("v")).select(
        F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    state = _state(pairs)
    while True:
        both = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # written, so that the join stands alone and the rows of a hub can be split
        least = stored(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "least")
        large = both.join(least, "u").where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        # no more rows than edges; equal ones go when the small stars are made
        large = stored(large.where("u <> v"), "large-star")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(
            F.struct(F.col("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
        pairs = stored(small.select("e.u", "e.v").where("u <> v").distinct(), "small-star")
        now = _state(pairs)
        if now == state:
            return pairs.groupBy("u").agg(F.min("v").alias("root")).withColumnRenamed("u", "node").unionByName(
                pairs.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
        state = now
