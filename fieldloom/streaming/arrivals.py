"""The folder run for files that keep arriving.

A document's pages may arrive in several batches, and its record is always made from all
pages seen so far; the record of a document is the one of its newest batch.  The pages of
every document are the stream's keyed state (RocksDB, saved with its checkpoint): a batch
adds its own pages and gets back those of the documents it touched, so what it reads does
not grow with what came before.  A document's state is dealt over ``shards`` keys, and each
arriving page wakes all of them, so a document of very many pages is no single task's.

Null keys are one document.  A page that arrives twice is two pages.  State is kept for
as long as the checkpoint is.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import batched

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

PAGES = "doc_id bigint, page_no int, json string"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
PROVIDER = "spark.sql.streaming.stateStore.providerClass"


class PageState(StatefulProcessor):
    """All pages of one shard of a document: new ones are added, then all are given out."""

    def __init__(self, schema: StructType):
        self.schema = schema

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.pages = handle.getListState("pages", self.schema)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        names = self.schema.names
        # a row without a page only wakes the shard
        added = (tuple(row["_page"][n] for n in names) for row in rows if row["_page"] is not None)
        for some in batched(added, 100):
            self.pages.appendList(list(some))
        for page in self.pages.get():
            yield Row(**dict(zip(names, page)))

    def close(self) -> None:
        pass


def touched_pages(arriving: DataFrame, key: str = "doc_id", shards: int = 4) -> DataFrame:
    """A stream of all pages so far of the documents that a batch brings pages of."""
    schema = arriving.schema
    own = F.pmod(F.xxhash64(*[c for c in schema.names if c != key]), F.lit(shards)).cast("int")
    page = F.struct(*schema.names)
    woken = F.transform(
        F.sequence(F.lit(0), F.lit(shards - 1)),
        lambda s: F.struct(s.alias("_shard"), F.when(s == F.col("_own"), F.col("_all")).alias("_page")))
    rows = arriving.select(F.col(key), own.alias("_own"), page.alias("_all")).select(key, F.inline(woken))
    return rows.groupBy(key, "_shard").transformWithState(
        statefulProcessor=PageState(schema), outputStructType=schema, outputMode="Update", timeMode="None")


def process_arrivals(
    spark: SparkSession, folder: str, target: str, plan: Callable[[DataFrame], DataFrame],
    schema: str = PAGES, checkpoint: str | None = None, files_per_batch: int = 1000, key: str = "doc_id",
    shards: int = 4,
) -> int:
    """Run ``plan`` over the documents of all files not seen yet; returns the number of batches.

    A batch writes its own sub-folders and replaces them when it is repeated after a
    failure, so no row is written twice.  ``plan`` keeps the column ``key``;
    ``files_per_batch`` sets how much is done at once and changes no result.  The
    checkpoint is the target's own unless one is named; ``shards`` is fixed by its first run.
    """
    arriving = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).json(folder)
    base = target.rstrip("/")
    done = []

    def write(batch: DataFrame, number: int) -> None:
        own = f"{base}/pages/batch={number}"
        # written first, so that the state is asked once
        batch.write.mode("overwrite").parquet(own)
        pages = batch.sparkSession.read.schema(arriving.schema).parquet(own)
        if pages.isEmpty():
            return
        plan(pages).write.mode("overwrite").parquet(f"{base}/records/batch={number}")
        done.append(number)

    before = spark.conf.get(PROVIDER)
    spark.conf.set(PROVIDER, ROCKS)
    try:
        stream = (
            touched_pages(arriving, key, shards).writeStream.outputMode("update").foreachBatch(write)
            .option("checkpointLocation", checkpoint or f"{base}/state")
            .trigger(availableNow=True).start()
        )
    finally:
        spark.conf.set(PROVIDER, before)
    stream.awaitTermination()
    return len(done)


def current_records(spark: SparkSession, target: str, key: str = "doc_id") -> DataFrame:
    """The newest record rows of every document."""
    records = spark.read.parquet(f"{target.rstrip('/')}/records")
    newest = records.groupBy(F.col(key).alias("_key")).agg(F.max("batch").alias("_newest"))
    same = records[key].eqNullSafe(newest["_key"]) & (records["batch"] == newest["_newest"])
    return records.join(newest, same, "left_semi").drop("batch")
