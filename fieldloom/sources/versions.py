"""Tables that change by key: bucketed files, small deltas, and commits that two writers can race for.

All tables of a store hang on one key.  A version is a base and the deltas committed after it:

* ``base-<id>/<table>`` and ``delta-<id>/<table>`` hold rows in buckets of the key, sorted by it;
* a delta also has ``touched``, the keys that it replaces or removes;
* ``commits/<version>.json`` names a folder and carries its buckets and counters.

A key's rows are those of the newest delta that touched it, else the base's.  A change writes
the rows of the keys that it touches and nothing else.  Readers join base and deltas on the
bucketed key, so the base is not shuffled, and a lookup of one key opens one bucket.

Writers prepare their delta, then try to create the next commit file.  Where another writer was
first, a change whose buckets nobody else touched takes the next number, and any other one is
made again from the newest version.  The file is created by a rename that fails if the target
is there, which is atomic on file systems with atomic renames.  Folders without a commit, such
as those of a lost race, are never read.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldloom.session import written


@dataclass(frozen=True)
class Layout:
    """Key column of each table, folders of a table by column, and the columns that commits count by."""

    keys: dict[str, str]
    folders: dict[str, tuple[str, ...]] = field(default_factory=dict)
    counted: tuple[str, tuple[str, ...]] | None = None


STORE = Layout(
    {"documents": "id", "extractions": "document_id", "errors": "document_id"},
    {"documents": ("document_type",)}, ("documents", ("document_type", "validation_status")))


@dataclass
class Change:
    """New rows of the touched keys (column ``key``); a touched key without rows is removed."""

    rows: dict[str, DataFrame]
    touched: DataFrame


class Conflict(RuntimeError):
    """A change lost every race that it was given."""


# --- files -----------------------------------------------------------------------------------

def _columns(df: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)


def _table_name(folder: str, table: str) -> str:
    return f"{folder.replace('-', '_')}_{table}"


def _write(df: DataFrame, path: str, name: str, key: str, buckets: int, folders: tuple[str, ...]) -> None:
    """Rows in one file for each bucket (and folder), sorted by key."""
    writer = df.repartition(buckets, F.col(key)).write.format("parquet").bucketBy(buckets, key).sortBy(key)
    writer = writer.partitionBy(*folders) if folders else writer
    writer.option("path", path).saveAsTable(name)


def _open(spark: SparkSession, target: str, entry: dict, table: str) -> DataFrame:
    """A bucketed table of a commit's folder; the session's catalog learns it when it is new to it."""
    name, about = _table_name(entry["folder"], table), entry["tables"][table]
    if not spark.catalog.tableExists(name):
        folders = f"PARTITIONED BY ({', '.join(f'`{c}`' for c in about['folders'])})" if about["folders"] else ""
        key = about["key"]
        spark.sql(
            f"CREATE TABLE {name} ({about['columns']}) USING parquet {folders} CLUSTERED BY (`{key}`) SORTED BY (`{key}`) "
            f"INTO {entry['buckets']} BUCKETS LOCATION '{target}/{entry['folder']}/{table}'")
        if folders:
            spark.sql(f"ALTER TABLE {name} RECOVER PARTITIONS")
    return spark.table(name)


def _save(spark: SparkSession, target: str, kind: str, layout: Layout, rows: dict[str, DataFrame], touched: DataFrame | None, buckets: int) -> dict:
    """Write a folder of tables and describe it."""
    folder = f"{kind}-{uuid.uuid4().hex}"
    tables = {}
    every = {name: (df, layout.keys[name], layout.folders.get(name, ())) for name, df in rows.items()}
    if touched is not None:
        every["touched"] = (touched.select("key"), "key", ())
    for name, (df, key, folders) in every.items():
        _write(df, f"{target}/{folder}/{name}", _table_name(folder, name), key, buckets, folders)
        tables[name] = {"key": key, "columns": _columns(df), "folders": list(folders)}
    return {"kind": kind, "folder": folder, "buckets": buckets, "tables": tables}


# --- commits ---------------------------------------------------------------------------------

def _commit(spark: SparkSession, target: str, version: int, entry: dict) -> bool:
    """Create the commit file of a version; False if it is there already."""
    jvm = spark._jvm
    folder = f"{target}/commits"
    conf = spark._jsc.hadoopConfiguration()
    path = jvm.org.apache.hadoop.fs.Path(f"{folder}/{version:020d}.json")
    # names with a leading underscore are no part of a table that Spark reads
    draft = jvm.org.apache.hadoop.fs.Path(f"{folder}/_{uuid.uuid4().hex}")
    fs = path.getFileSystem(conf)
    out = fs.create(draft, False)
    out.write(bytearray(json.dumps(entry).encode()))
    out.close()
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(path.toUri(), conf) if path.toUri().getScheme() \
        else jvm.org.apache.hadoop.fs.FileContext.getFileContext(conf)
    never_over = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    never_over[0] = jvm.org.apache.hadoop.fs.Options.Rename.NONE
    try:
        context.rename(draft, path, never_over)
        return True
    except Exception as problem:
        fs.delete(draft, False)
        if "FileAlreadyExists" in str(problem):
            return False
        raise


def commits(spark: SparkSession, target: str, upto: int | None = None) -> list[dict]:
    """The commits of a store in order: one small row each, as many as changes since it was made."""
    rows = spark.read.text(f"{target.rstrip('/')}/commits", wholetext=True).select(
        F.regexp_extract("_metadata.file_name", r"(\d+)\.json$", 1).cast("long").alias("version"), "value").collect()
    found = sorted(({"version": r["version"], **json.loads(r["value"])} for r in rows), key=lambda e: e["version"])
    return [e for e in found if upto is None or e["version"] <= upto]


def _state(entries: list[dict]) -> tuple[dict, list[dict]]:
    """The newest base and the deltas it does not hold yet."""
    base = max((e for e in entries if e["kind"] == "base"), key=lambda e: (e["covers"], e["version"]))
    return base, [e for e in entries if e["kind"] == "delta" and e["version"] > base["covers"]]


def _counts(df: DataFrame, layout: Layout) -> dict[tuple, int]:
    """Rows by the counted columns: as many as there are different values of these."""
    return {tuple(r[:-1]): r[-1] for r in df.groupBy(*layout.counted[1]).agg(F.count(F.lit(1))).collect()}


def _summed(parts: Iterable[tuple[dict[tuple, int], int]]) -> list[list]:
    total: dict[tuple, int] = {}
    for part, sign in parts:
        for k, n in part.items():
            total[k] = total.get(k, 0) + sign * n
    return [[list(k), n] for k, n in sorted(total.items(), key=repr) if n]


# --- reading ---------------------------------------------------------------------------------

def create(spark: SparkSession, target: str, tables: dict[str, DataFrame], layout: Layout, buckets: int | None = None) -> int:
    """A new store of the given tables: version 0.

    ``buckets`` is kept for its lifetime; without it, there are as many as the session has cores,
    and no more than its shuffle partitions.
    """
    target = target.rstrip("/")
    buckets = buckets or min(int(spark.conf.get("spark.sql.shuffle.partitions")), max(8, spark.sparkContext.defaultParallelism))
    entry = _save(spark, target, "base", layout, tables, None, buckets) | {"covers": 0}
    if layout.counted:
        entry["counts"] = _summed([(_counts(_open(spark, target, entry, layout.counted[0]), layout), 1)])
    if not _commit(spark, target, 0, entry):
        raise Conflict(f"there is a store in {target} already")
    return 0


def read(spark: SparkSession, target: str, layout: Layout, version: int | None = None, only=None) -> dict[str, DataFrame]:
    """The tables at a version (the newest without one); ``only`` gives the rows of one key, from its bucket."""
    return _read(spark, target.rstrip("/"), layout, commits(spark, target, version), only)


def _read(spark: SparkSession, target: str, layout: Layout, entries: list[dict], only=None) -> dict[str, DataFrame]:
    base, deltas = _state(entries)
    chosen = lambda df, key: df if only is None else df.where(F.col(key) == F.lit(only))
    opened = lambda e, name, key: chosen(_open(spark, target, e, name), key)
    if not deltas:
        return {name: opened(base, name, key) for name, key in layout.keys.items()}
    touched = None
    for e in deltas:
        own = opened(e, "touched", "key").withColumn("_version", F.lit(e["version"]))
        touched = own if touched is None else touched.unionByName(own)
    last = touched.groupBy("key").agg(F.max("_version").alias("_last"))
    out = {}
    for name, key in layout.keys.items():
        whole = opened(base, name, key)
        rows = whole.join(last, whole[key] == last["key"], "left_anti")
        for e in deltas:
            if name in e["tables"]:
                fresh = opened(e, name, key)
                newest = last.where(F.col("_last") == e["version"])
                rows = rows.unionByName(fresh.join(newest, fresh[key] == newest["key"], "left_semi"))
        out[name] = rows.select(*whole.columns)
    return out


def statistics(spark: SparkSession, target: str, layout: Layout, version: int | None = None) -> dict[tuple, int]:
    """Rows by the counted columns, from the commits alone."""
    base, deltas = _state(commits(spark, target, version))
    parts = [({tuple(k): n for k, n in e["counts"]}, 1) for e in [base, *deltas]]
    return {tuple(k): n for k, n in _summed(parts)}


# --- changing --------------------------------------------------------------------------------

def change(
    spark: SparkSession, target: str, layout: Layout, make: Callable[[dict[str, DataFrame]], Change], attempts: int = 10,
) -> int:
    """Commit ``make(tables)`` as the next version and return its number.

    ``make`` may run again on newer tables, when another writer changed one of its buckets in
    the meantime, and should do nothing but describe the change.
    """
    target = target.rstrip("/")
    for _ in range(attempts):
        entries = commits(spark, target)
        tables = _read(spark, target, layout, entries)
        todo = make(tables)
        # planned once: the keys decide what is written, counted and checked
        keys = written(todo.touched.select("key").distinct(), "touched")
        buckets = entries[0]["buckets"]
        entry = _save(spark, target, "delta", layout, todo.rows, keys, buckets)
        held = keys.select(F.pmod(F.hash("key"), F.lit(buckets)).alias("b")).distinct().collect()
        entry["touched"] = sorted(r["b"] for r in held)
        if layout.counted:
            name, key = layout.counted[0], layout.keys[layout.counted[0]]
            before = _counts(tables[name].join(keys, tables[name][key] == keys["key"], "left_semi"), layout)
            after = _counts(_open(spark, target, entry, name), layout) if name in todo.rows else {}
            entry["counts"] = _summed([(before, -1), (after, 1)])
        version = entries[-1]["version"]
        while True:
            if _commit(spark, target, version + 1, entry):
                return version + 1
            newer = [e for e in commits(spark, target) if e["version"] > version]
            if any(set(e["touched"]) & set(entry["touched"]) for e in newer if e["kind"] == "delta"):
                break
            version = newer[-1]["version"]
    raise Conflict(f"{attempts} attempts to change {target} met other writers")


def compact(spark: SparkSession, target: str, layout: Layout, attempts: int = 100) -> int:
    """Write base and deltas as a new base.  Changes committed meanwhile stay deltas of it, so none is in the way."""
    target = target.rstrip("/")
    entries = commits(spark, target)
    version = entries[-1]["version"]
    entry = _save(spark, target, "base", layout, _read(spark, target, layout, entries), None, entries[0]["buckets"]) | {"covers": version}
    if layout.counted:
        base, deltas = _state(entries)
        entry["counts"] = _summed([({tuple(k): n for k, n in e["counts"]}, 1) for e in [base, *deltas]])
    for _ in range(attempts):
        if _commit(spark, target, version + 1, entry):
            return version + 1
        version = commits(spark, target)[-1]["version"]
    raise Conflict(f"{attempts} attempts to compact {target} met other writers")
