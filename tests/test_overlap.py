"""Sketches of snapshots against exact counts."""

import pytest
from pyspark.sql import functions as F

from shelfwise.operators import overlap as O
from shelfwise.sources.scratch import scratch


def snapshot(spark, first, last, brand="a"):
    return spark.range(first, last, numPartitions=4).select(F.lit(brand).alias("brand"), F.concat(F.lit("n"), "id").alias("name"))


def compare(spark, a, b, lg_k):
    old, new = (O.snapshot_sketches(x, ["brand"], ["brand", "name"], lg_k) for x in (a, b))
    pairs = new.join(old.select("brand", F.col("sketch").alias("old_sketch")), "brand", "left")
    return O.overlap_counts(pairs, lg_k=lg_k).first()


@pytest.mark.parametrize("lg_k", [10, 12])
def test_within_the_bound(spark, lg_k):
    got = compare(spark, snapshot(spark, 0, 60000), snapshot(spark, 20000, 90000), lg_k)
    want = {"models": 70000, "added": 30000, "kept": 40000, "gone": 20000, "either": 90000}
    assert 0 < got["error"] <= 90000 * 2 / 2 ** (lg_k / 2) * 1.1 + 1
    assert all(abs(got[k] - v) <= got["error"] for k, v in want.items())


def test_exact_below_the_size(spark):
    got = compare(spark, snapshot(spark, 0, 3000), snapshot(spark, 1000, 3500), 12)
    assert (got["models"], got["added"], got["kept"], got["gone"], got["either"], got["error"]) == (2500, 500, 2000, 1000, 3500, 0)


def test_nulls_repeats_and_no_older_snapshot(spark):
    df = spark.createDataFrame([("a", "x"), ("a", "x"), ("a", None), ("a", ""), (None, "x"), ("b", None)], "brand string, name string")
    made = O.snapshot_sketches(df, ["brand"], ["name"])
    assert {(r["brand"], r["variants"], r["models"]) for r in O.model_counts(made).collect()} == {("a", 4, 2), (None, 1, 1), ("b", 1, 0)}
    one = O.overlap_counts(made.where("brand = 'a'").withColumn("old_sketch", F.lit(None).cast("binary"))).first()
    assert (one["models"], one["added"], one["kept"], one["gone"]) == (2, 2, 0, 0)
    assert O.model_counts(O.snapshot_sketches(df.limit(0), ["brand"], ["name"])).count() == 0


def test_old_snapshots_are_not_read_again(spark):
    base = scratch(spark, "sketches")
    for date, (a, b) in {"2025-01-01": (0, 100), "2025-01-02": (50, 120)}.items():
        path = scratch(spark, "snap")
        snapshot(spark, a, b).write.parquet(path)
        O.add_snapshot(spark.read.parquet(path), base, date, ["brand"], ["name"])
        target = spark._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)  # gone for good
    O.add_snapshot(snapshot(spark, 110, 130), base, "2025-01-03", ["brand"], ["name"])
    O.add_snapshot(snapshot(spark, 115, 130), base, "2025-01-03", ["brand"], ["name"])  # replaces it
    rows = O.overlap_counts(O.successive(O.all_snapshots(spark, base), ["brand"], "snapshot_date")).orderBy("snapshot_date").collect()
    assert [(r["models"], r["added"], r["kept"], r["gone"]) for r in rows] == [(100, 100, 0, 0), (70, 20, 50, 50), (15, 10, 5, 65)]
    assert O.model_counts(O.merged(O.all_snapshots(spark, base), ["brand"])).first()["models"] == 130
