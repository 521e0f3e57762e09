"""Listings made in tasks, and records of any depth."""

import json
import os

from pyspark.sql import functions as F

from fieldloom.functions import pyfuncs
from fieldloom.operators import routing, tables
from fieldloom.sources import files, listing


def test_listing_equals_a_walk(spark, tmp_path):
    for n in range(7):
        for m in range(5):
            folder = tmp_path / f"type {n}" / ("files" if m % 2 else "deep/er")
            folder.mkdir(parents=True, exist_ok=True)
            (folder / f"é {m}.pdf").write_text("x" * (n * 10 + m))
    (tmp_path / "top.txt").write_text("top")
    (tmp_path / ".hidden").write_text("")
    (tmp_path / "type 0" / "side.json").write_text("{}")
    (tmp_path / "empty").mkdir()
    want = sorted((f"file:{os.path.join(at, f)}", os.path.getsize(os.path.join(at, f))) for at, _, found in os.walk(tmp_path) for f in found)
    got = files.list_files(spark, str(tmp_path))
    assert got.dtypes == [("path", "string"), ("length", "bigint"), ("modificationTime", "timestamp")]
    assert sorted((r["path"], r["length"]) for r in got.collect()) == want
    assert got.where(F.col("modificationTime") > F.current_timestamp() - F.expr("INTERVAL 1 DAY")).count() == len(want)
    # the same with one task, and with more tasks than folders
    for tasks in (1, 2, 5, 100):
        reader = listing.ListingReader(f"file://{tmp_path}", tasks)
        rows = [r for p in reader.partitions() for b in reader.read(p) for r in zip(b["path"].to_pylist(), b["length"].to_pylist())]
        assert sorted(rows) == want, tasks
    assert files.list_files(spark, str(tmp_path / "missing")).isEmpty()


def test_the_driver_lists_no_more_folders_than_it_needs(spark, tmp_path, monkeypatch):
    for n in range(40):
        (tmp_path / f"a{n}" / "b" / "c").mkdir(parents=True)
    looked = []
    plain = listing.entries
    monkeypatch.setattr(listing, "entries", lambda system, folder: looked.append(folder) or plain(system, folder))
    assert len(listing.ListingReader(f"file://{tmp_path}", 16).partitions()) == 41
    assert looked == [str(tmp_path)]


def test_deep_records_keep_their_shallow_fields(spark):
    # one leaf at the top and one at the end, as each leaf's path is as long as its depth
    deep = '{"s":1.50,"a":' + '{"a":' * 19_999 + '[1,{"z":"é"}]' + "}" * 20_000
    rows = [(1, deep), (2, deep[:-1]), (3, '{"x":1}'), (4, "[" * 30_000 + "]" * 30_000), (5, '{"l":' + "[" * 30_000 + "1" + "]" * 30_000 + "}")]
    got = routing.flatten_json(spark.createDataFrame(rows, "doc_id long, j string"), "j").groupBy("doc_id").agg(
        F.count("*").alias("n"), F.min_by("value", F.length("path")).alias("first"), F.max_by("value", F.length("path")).alias("last")).collect()
    assert sorted((r["doc_id"], r["n"], r["first"], len(r["last"])) for r in got) == [
        (1, 2, "1.50", 13), (3, 1, "1", 1), (5, 1, "[" * 30_000 + "1" + "]" * 30_000, 60_001)]


def test_deep_leaves_equal_the_reader():
    texts = [
        '{"a":{"b":[1,2.50,{"c":null}],"d":{}},"e":"x\\"y\\u00e9","f":true}', '{}', '[]', '1', '', '{"a":1,}', '{"a":[1,]}', '{"a" 1}', '{"a":1}x', '{,}', '{"a":1,"b":2,"a":3}',
        '{"a":01}', '{"a":"\n"}', '{"a":[}', '{"":{"b":1}}', ' { "a" : [ 1 , [ ] , { } ] , "b" : -1e5 } ', '{"a":1}{"b":2}', '{"a":nul}', '{"a"}', '{1:2}', '[{"a":1}]']
    for t in texts:
        assert pyfuncs._deep_leaves(t, ".") == pyfuncs.flatten_text(t), t
    many = {f"k{n}": {"v": [n, {"w": None}]} for n in range(500)}
    assert pyfuncs._deep_leaves(json.dumps(many), "/") == pyfuncs.flatten_text(json.dumps(many), "/")


def test_item_rows(spark):
    df = spark.createDataFrame([(1, ["a", "b"]), (2, []), (3, None), (4, [None])], "doc_id long, items array<string>")
    assert sorted(map(tuple, tables.item_rows(df, "items").collect())) == [(1, 1, "a"), (1, 2, "b"), (4, 1, None)]
