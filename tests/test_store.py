"""Commits: half-written and concurrent writers, the bucketed master against updating a whole master, bytes written, replays."""

import os
import random

import pytest
from pyspark.sql import functions as F

from shelfwise.operators import lifecycle as L
from shelfwise.sources import files as IO
from shelfwise.sources.store import BucketedMaster, Store, read_version


def test_failing_writer_leaves_the_version_before(spark, tmp_path):
    base, df = f"{tmp_path}/v", spark.range(1000).repartition(4)
    IO.write_versioned_latest(df.withColumn("v", F.lit("old")), base, "20250718_102343")
    opened = IO.read_latest(spark, base)
    fail = F.udf(lambda x: 1 // (x - 999), "long")
    with pytest.raises(Exception, match="ZeroDivision"):
        IO.write_versioned_latest(df.withColumn("v", fail("id").cast("string")), base, "20250718_102836")
    assert len(os.listdir(f"{base}/data")) == 2 and IO.read_latest(spark, base).count() == 1000
    # A commit file that was not written to its end is no commit, and its number can be taken again.
    (tmp_path / "v/_commits/00000000000000000001.json").write_text('{"ts": "2026')
    assert {r["v"] for r in IO.read_latest(spark, base).select("v").distinct().collect()} == {"old"}
    IO.write_versioned_latest(df.withColumn("v", F.lit("new")), base, "20250718_102836")
    assert {r["v"] for r in IO.read_latest(spark, base).select("v").distinct().collect()} == {"new"}
    assert opened.where("v = 'old'").count() == 1000 == read_version(spark, base, "20250718_102343").where("v = 'old'").count()
    store = Store(spark, base)
    assert len(store.vacuum({c["folder"] for _, c in store.commits()})) == 1 and IO.read_latest(spark, base).count() == 1000
    with pytest.raises(FileNotFoundError):
        read_version(spark, base, "x")


def test_two_writers(spark, tmp_path):
    a, b = Store(spark, f"{tmp_path}/s"), Store(spark, f"{tmp_path}/s")
    assert a.commit(0, {"w": "a"}) and not b.commit(0, {"w": "b"}) and a.read(0) == {"w": "a"}

    def content(last):
        # Another writer commits between this one's look and its own commit.
        if last[0] == 0:
            b.commit(1, {"w": "b"})
        return {"w": "a", "after": last[1]["w"]}

    assert a.append(content) == 2 and a.latest() == (2, {"w": "a", "after": "b"}) and [n for n, _ in a.commits()] == [0, 1, 2]


def test_bucketed_master_equals_updating_all(spark, tmp_path):
    rng = random.Random(3)
    master, store = None, BucketedMaster(spark, f"{tmp_path}/m", ["brand", "name"], buckets=8)
    for day in range(5):
        rows = [(rng.choice("pq"), f"n{i}", rng.choice([None, f" {day}  x", "y"])) for i in rng.sample(range(40), 12)] + [(None, "n1", "z"), ("p", None, "z")]
        rows += rows[:3]
        batch, as_of = spark.createDataFrame(rows, "brand string, name string, price string"), f"2025-08-0{day + 1}"
        none = batch.limit(0)
        master = spark.createDataFrame(L.update_master(batch, none, master if master is not None else none, ["brand", "name"], as_of).collect(), "brand string, name string, price string, status string, first_seen_date string, last_seen_date string, last_updated string")
        assert store.merge(batch, day, as_of)
        assert not store.merge(batch.withColumn("price", F.lit("replay")), day, "2030-01-01")
        got = store.table().select(master.columns)
        assert sorted(map(repr, got.collect())) == sorted(map(repr, master.collect())), day
    assert {r[0] for r in got.select("status").distinct().collect()} == {"New", "Available", "Discontinued"}


def test_new_and_missing_columns(spark, tmp_path):
    store = BucketedMaster(spark, f"{tmp_path}/m", ["name"], buckets=2)
    store.merge(spark.createDataFrame([("a", "1"), ("b", "2")], "name string, price string"), 0, "2025-08-01")
    store.merge(spark.createDataFrame([("b", "red")], "name string, color string"), 1, "2025-08-02")
    assert {(r["name"], r["price"], r["color"], r["status"]) for r in store.table().collect()} == {("a", "1", None, "Discontinued"), ("b", None, "red", "Available")}


def files_of(folder):
    return {os.path.join(d, f): os.path.getsize(os.path.join(d, f)) for d, _, names in os.walk(folder) for f in names if f.endswith(".parquet")}


def test_bytes_follow_the_batch(spark, tmp_path):
    store = BucketedMaster(spark, f"{tmp_path}/m", ["name"], buckets=32)
    all_rows = spark.range(20000).select(F.concat(F.lit("n"), "id").alias("name"), F.sha2(F.col("id").cast("string"), 256).alias("text"))
    store.merge(all_rows, 0, "2025-08-01")
    before = files_of(f"{tmp_path}/m/data")
    store.merge(all_rows.where("name = 'n17'").withColumn("text", F.lit("changed")), 1, "2025-08-02")
    added = {f: n for f, n in files_of(f"{tmp_path}/m/data").items() if f not in before}
    assert 0 < sum(added.values()) < sum(before.values()) / 16
    got = store.table()
    assert got.count() == 20000 and got.where("status = 'Available'").collect()[0]["text"] == "changed" and got.where("status = 'Discontinued'").count() == 19999


def test_killed_writer_leaves_the_master(spark, tmp_path, monkeypatch):
    store = BucketedMaster(spark, f"{tmp_path}/m", ["name"], buckets=2)
    batch = spark.createDataFrame([("a", "1")], "name string, price string")
    store.merge(batch, 0, "2025-08-01")
    monkeypatch.setattr(store.store, "commit", lambda *a: (_ for _ in ()).throw(KeyboardInterrupt()))
    with pytest.raises(KeyboardInterrupt):
        store.merge(batch.withColumn("price", F.lit("2")), 1, "2025-08-02")
    again = BucketedMaster(spark, f"{tmp_path}/m", ["name"])
    assert again.buckets == 2 and [r["price"] for r in again.table().collect()] == ["1"]
    assert again.merge(batch.withColumn("price", F.lit("2")), 1, "2025-08-02") and [r["price"] for r in again.table().collect()] == ["2"]


def test_first_rows_of_duplicate_names(spark):
    rows = [("a", 3, "x", {"k": "1"}), ("a", 1, "y", {"k": "2"}), ("a", 2, None, None), (None, 0, "z", None), ("b", 5, "w", None)]
    df = spark.createDataFrame(rows, "name string, ord int, v string, m map<string,string>")
    assert sorted((r["name"], r["v"]) for r in L.first_rows(df, ["name"], "ord").collect()) == [("a", "y"), ("b", "w")]
    plain = df.drop("ord", "m")
    for seed in range(4):
        shuffled = plain.repartition(3, F.rand(seed))
        assert sorted(((r["name"], r["v"]) for r in L.first_rows(shuffled, ["name"]).collect()), key=str) == [("a", None), ("b", "w")]
        assert L.first_rows(df.drop("ord").repartition(3, F.rand(seed)), ["name"]).count() == 2
    one = L.update_all_brands(df.withColumn("brand", F.lit("q")).drop("m"), df.limit(0).withColumn("brand", F.lit("q")).drop("m"), df.limit(0).withColumn("brand", F.lit("q")).drop("m"), "2025-08-03")
    assert sorted((r["name"], r["v"]) for r in one.collect()) == [("a", "y"), ("b", "w")]
