"""Stores that change by key: what is written, who wins a race, and what a lookup opens."""

import os

import pytest
from pyspark.sql import functions as F

from fieldloom.operators import store
from fieldloom.sources import versions
from fieldloom.sources.versions import STORE, Layout

DOC = "id long, document_name string, document_type string, created_at string, updated_at string, validation_status string, extracted_data string"


def tables(spark, n=400):
    docs = spark.range(n).select(
        "id", F.concat(F.lit("d"), "id").alias("document_name"), F.element_at(F.array(F.lit("pan"), F.lit("invoice")), (F.col("id") % 2 + 1).cast("int")).alias("document_type"),
        F.lit("2024").alias("created_at"), F.lit("2024").alias("updated_at"), F.lit("invalid").alias("validation_status"), F.repeat(F.lit("x"), 50).alias("extracted_data"))
    kids = spark.range(n * 5).select((F.col("id") % n).alias("document_id"), F.concat(F.lit("f"), "id").alias("field_name"))
    return {"documents": docs, "extractions": kids, "errors": kids.where("document_id < 3").withColumnRenamed("field_name", "error_message")}


def changed(spark, ids, data="new"):
    docs = spark.createDataFrame([(i, data, "valid", "2025") for i in ids], "id long, extracted_data string, validation_status string, updated_at string")
    kids = docs.select(F.col("id").alias("document_id"), F.lit(data).alias("field_name"))
    return store.Store(docs, kids, kids.withColumnRenamed("field_name", "error_message"))


def replace(spark, target, ids, data="new"):
    return versions.change(spark, target, STORE, lambda t: store.replacement(t, changed(spark, ids, data)))


def size(folder):
    return sum(os.path.getsize(os.path.join(at, f)) for at, _, files in os.walk(folder) for f in files if f.endswith(".parquet"))


@pytest.fixture
def target(spark, tmp_path):
    versions.create(spark, str(tmp_path), tables(spark), STORE, buckets=8)
    return str(tmp_path)


def by_id(spark, target):
    return {r["id"]: r["extracted_data"] for r in versions.read(spark, target, STORE)["documents"].collect()}


def test_a_change_equals_the_whole_rewrite(spark, target):
    before = store.Store(**versions.read(spark, target, STORE))
    ids = [3, 5, 399, 1000]
    want = store.delete_documents(store.replace_records(before, changed(spark, ids)), spark.createDataFrame([(5,), (7,), (-1,)], "id long"))
    replace(spark, target, ids)
    versions.change(spark, target, STORE, lambda t: store.deletion(t, spark.createDataFrame([(5,), (7,), (-1,)], "id long")))
    got = versions.read(spark, target, STORE)
    for name in STORE.keys:
        rows = lambda df: sorted(map(str, df.select(*getattr(want, name).columns).collect()))
        assert rows(got[name]) == rows(getattr(want, name)), name
    assert len(versions.read(spark, target, STORE, version=0)["documents"].collect()) == 400


def test_only_changed_rows_are_written(spark, tmp_path):
    target = str(tmp_path)
    versions.create(spark, target, tables(spark, 40_000), STORE, buckets=8)
    version = replace(spark, target, range(0, 40_000, 100))
    base, delta = (next(e for e in versions.commits(spark, target) if e["version"] == v) for v in (0, version))
    assert size(f"{target}/{delta['folder']}") < 0.2 * size(f"{target}/{base['folder']}")
    assert sum(1 for _ in versions.read(spark, target, STORE)["documents"].where("extracted_data = 'new'").collect()) == 400
    few = replace(spark, target, [77])
    assert len(next(e for e in versions.commits(spark, target) if e["version"] == few)["touched"]) == 1


def test_base_is_not_shuffled(spark, target):
    replace(spark, target, range(100))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        rows = versions.read(spark, target, STORE)["extractions"]
        plan = rows._jdf.queryExecution().executedPlan().toString()
        kids = versions.read(spark, target, STORE, version=0)["extractions"]
        upsert = kids.join(spark.range(100).withColumnRenamed("id", "document_id"), "document_id")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    # only the keys of the deltas are brought to the buckets, and at most once
    assert "Bucketed: true" in plan and plan.count("Exchange hashpartitioning") <= 1, plan
    assert "Bucketed: true" in upsert and upsert.count("Exchange hashpartitioning") == 1, upsert


def test_a_lookup_opens_one_bucket_and_a_type_its_folder(spark, target):
    replace(spark, target, [77, 78])
    one = versions.read(spark, target, STORE, only=77)
    assert [r["extracted_data"] for r in one["documents"].collect()] == ["new"] and one["extractions"].count() == 1
    assert versions.read(spark, target, STORE, only=12345)["documents"].isEmpty()

    def files(df):
        df.collect()
        scans, todo = 0, [df._jdf.queryExecution().executedPlan()]
        while todo:
            node = todo.pop()
            if "AdaptiveSparkPlan" in node.nodeName():
                todo.append(node.executedPlan())
                continue
            if node.metrics().contains("numFiles"):
                scans += node.metrics().apply("numFiles").value()
            children = node.children()
            todo += [children.apply(n) for n in range(children.length())]
        return scans

    at_start = versions.read(spark, target, STORE, version=0)
    assert files(at_start["documents"]) == 16 and files(at_start["documents"].where("document_type = 'pan'")) == 8
    # a lookup works when the files of all other buckets are gone: it opens none of them
    bucket = spark.range(77, 78).select(F.pmod(F.hash("id"), F.lit(8))).first()[0]
    base = versions.commits(spark, target)[0]["folder"]
    for name in ("documents", "extractions"):
        for at, _, found in os.walk(f"{target}/{base}/{name}"):
            for f in found:
                if f"_{bucket:05d}.c" not in f:
                    os.remove(os.path.join(at, f))
    one = versions.read(spark, target, STORE, version=0, only=77)
    assert one["documents"].count() == 1 and one["extractions"].count() == 5


def test_two_writers_lose_nothing(spark, target):
    bucket = {r["id"]: r["b"] for r in spark.range(400).select("id", F.pmod(F.hash("id"), F.lit(8)).alias("b")).collect()}
    same = next(i for i in range(1, 400) if bucket[i] == bucket[0])
    other = next(i for i in range(1, 400) if bucket[i] != bucket[0])
    for rival, runs in ((same, 2), (other, 1)):
        calls = []

        def late(t):
            todo = store.replacement(t, changed(spark, [0], f"late{rival}"))
            calls.append(1)
            if len(calls) == 1:
                # another writer commits between this one's read and its commit
                replace(spark, target, [rival], f"rival{rival}")
            return todo

        versions.change(spark, target, STORE, late)
        assert len(calls) == runs
        got = by_id(spark, target)
        assert got[0] == f"late{rival}" and got[rival] == f"rival{rival}"
    assert [e["version"] for e in versions.commits(spark, target)] == list(range(5))


def test_a_lost_update_is_made_again_from_the_newer_rows(spark, tmp_path):
    layout, target = Layout({"t": "k"}), str(tmp_path)
    versions.create(spark, target, {"t": spark.createDataFrame([("a", 1), ("b", 1), (None, 5)], "k string, n int")}, layout, buckets=4)
    calls = []

    def add(first):
        def make(t):
            rows = t["t"].where("k = 'a'").select("k", (F.col("n") + 1).cast("int").alias("n"))
            if first and not calls:
                calls.append(1)
                versions.change(spark, target, layout, add(False))
            return versions.Change({"t": rows}, rows.select(F.col("k").alias("key")))

        return make

    versions.change(spark, target, layout, add(True))
    assert sorted(map(tuple, versions.read(spark, target, layout)["t"].collect()), key=str) == [("a", 3), ("b", 1), (None, 5)]


def test_a_change_that_always_loses_says_so(spark, target):
    def stubborn(t):
        replace(spark, target, [0], "rival")
        return store.replacement(t, changed(spark, [0]))

    with pytest.raises(versions.Conflict):
        versions.change(spark, target, STORE, stubborn, attempts=2)
    with pytest.raises(versions.Conflict):
        versions.create(spark, target, tables(spark), STORE)
    assert by_id(spark, target)[0] == "rival"


def test_counters_equal_a_scan(spark, target):
    def same():
        scanned = {tuple(r[:2]): r[2] for r in versions.read(spark, target, STORE)["documents"].groupBy("document_type", "validation_status").count().collect()}
        assert versions.statistics(spark, target, STORE) == scanned
        return scanned

    same()
    replace(spark, target, range(10, 30))
    versions.change(spark, target, STORE, lambda t: store.deletion(t, spark.createDataFrame([(11,), (12,), (13,)], "id long")))
    versions.compact(spark, target, STORE)
    replace(spark, target, [1, 20, 5000])
    versions.change(spark, target, STORE, lambda t: store.insertion(store.Store(
        tables(spark, 1)["documents"].withColumn("id", F.lit(9000).cast("long")).withColumn("document_type", F.lit(None).cast("string")),
        t["extractions"].limit(0), t["errors"].limit(0))))
    total = same()
    assert sum(total.values()) == 398 and total[(None, "invalid")] == 1
    got = {r["dimension"] + (r["value"] or ""): r["n"] for r in store.committed_statistics(spark, versions.statistics(spark, target, STORE)).collect()}
    assert got["total"] == 398 and got["validation_statusvalid"] == 18


def test_changes_during_compaction_stay(spark, target, monkeypatch):
    replace(spark, target, [1], "first")
    save, done = versions._save, []

    def slow(spark_, target_, kind, *rest):
        entry = save(spark_, target_, kind, *rest)
        if kind == "base" and not done:
            done.append(1)
            replace(spark, target, [2], "meanwhile")
        return entry

    monkeypatch.setattr(versions, "_save", slow)
    versions.compact(spark, target, STORE)
    replace(spark, target, [3], "after")
    got = by_id(spark, target)
    assert (got[1], got[2], got[3]) == ("first", "meanwhile", "after") and len(got) == 400


def test_another_session_opens_the_store(spark, target):
    replace(spark, target, [4])
    want = by_id(spark, target)
    for t in spark.catalog.listTables():
        if t.name.startswith(("base_", "delta_")):
            spark.sql(f"DROP TABLE {t.name}")
    assert by_id(spark, target) == want and want[4] == "new"


def test_upserts_by_key(spark, tmp_path):
    layout, target = Layout({"invoices": "Invoice_No"}), str(tmp_path)
    rows = spark.createDataFrame([("I1", "old", 1), ("I2", "old", 2)], "Invoice_No string, Vendor_Name string, n int")
    changes = spark.createDataFrame([("I1", "x", None, 1), ("I1", "", 7, 2), ("I9", "z", 9, 1)], "Invoice_No string, Vendor_Name string, n int, at int")
    versions.create(spark, target, {"invoices": rows}, layout, buckets=4)
    versions.change(spark, target, layout, lambda t: store.known_value_change("invoices", t["invoices"], changes, order=("at",)))
    assert sorted(map(tuple, versions.read(spark, target, layout)["invoices"].collect())) == [("I1", "x", 7), ("I2", "old", 2)]
