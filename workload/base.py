"""Registry, table access and the dialect switch for shared fixture SQL."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


@dataclass(frozen=True)
class Entry:
    run: Callable[["Inputs"], DataFrame]
    sql: str | None
    uses: tuple[str, ...]


# the table of which each row is rendered as a document, and the column that is its id; the key is unique, so no task gets more
DOCUMENT_KEY = {"orders": "o_orderkey"}
# a piece holds so many documents at most, so what a task sorts or combines does not grow with the table
DOCUMENTS_A_PIECE = 200_000

REGISTRY: dict[str, Entry] = {}
FIXTURES: dict[str, str] = {}


class Inputs:
    """Driver tables and fixtures of one scale-factor folder."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir
        self._pieces: dict[str, int] = {}

    def table(self, name: str) -> DataFrame:
        df = self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
        if name in DOCUMENT_KEY:
            # the narrow rows are dealt by document before a document's pairs, pages or cells are made of them: those
            # are then grouped where they are, in pieces that are as many as a shuffle's and not as few as a file's splits
            if name not in self._pieces:
                # the count comes from the files' footers
                self._pieces[name] = max(int(self.spark.conf.get("spark.sql.shuffle.partitions")), -(-df.count() // DOCUMENTS_A_PIECE))
            return df.repartition(self._pieces[name], DOCUMENT_KEY[name])
        # the driver's small files are one split each; on one machine their fixtures are rendered on all cores
        master = self.spark.sparkContext.master
        return df.repartition(self.spark.sparkContext.defaultParallelism) if master.startswith("local[") else df

    def fixture(self, name: str) -> DataFrame:
        return self.sql(FIXTURES[name])

    def sql(self, text: str) -> DataFrame:
        used = {t: self.table(t) for t in TABLES if "{" + t + "}" in text}
        return self.spark.sql(spark_text(text), **used)


# Names that differ: @explode an array, @inline an array of @row structs, build an @array.
_SPARK = {"@explode(": "explode(", "@array(": "array(", "@inline(": "inline(", "@row(": "named_struct(", "@end": ""}
_DUCK = {"@explode(": "unnest(", "@array(": "list_value(", "@inline(": "unnest(", "@end": ", recursive := true"}


def spark_text(text: str) -> str:
    for mark, name in _SPARK.items():
        text = text.replace(mark, name)
    return text.replace("@as ", "")


def duck(text: str) -> str:
    """Fixture text for the oracle engine."""
    for mark, name in _DUCK.items():
        text = text.replace(mark, name)
    # named_struct('a', x, 'b', y) is struct_pack(a := x, b := y)
    text = re.sub(r"@row\(|'(\w+)', @as ", lambda m: f"{m[1]} := " if m[1] else "struct_pack(", text)
    return text.format(**{t: t for t in TABLES})


def query(name: str, sql: str | None = None, uses: tuple[str, ...] | str = ()):
    """Register a query; ``uses`` names the fixtures its SQL refers to."""
    uses = (uses,) if isinstance(uses, str) else tuple(uses)

    def register(run: Callable[[Inputs], DataFrame]) -> Callable[[Inputs], DataFrame]:
        assert name not in REGISTRY, name
        REGISTRY[name] = Entry(run, sql, uses)
        return run

    return register


def oracle_text(entry: Entry) -> str | None:
    if entry.sql is None:
        return None
    if not entry.uses:
        return entry.sql
    ctes = ", ".join(f"{name} AS ({duck(FIXTURES[name])})" for name in entry.uses)
    return f"WITH {ctes} SELECT * FROM ({entry.sql}) AS answer"


def values(rows, names: str) -> str:
    """A VALUES list as a derived table for oracle text."""
    def lit(v):
        if v is None:
            return "NULL"
        if isinstance(v, bool):
            return "TRUE" if v else "FALSE"
        return str(v) if isinstance(v, int) else "'" + str(v).replace("'", "''") + "'"

    body = ", ".join("(" + ", ".join(lit(v) for v in row) + ")" for row in rows)
    return f"(VALUES {body}) AS {names}"
