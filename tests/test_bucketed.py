"""Bucketed master: updated where it lies."""

import glob
import re

import pytest

from shelfwise.operators import lifecycle as L
from shelfwise.plans import catalog
from shelfwise.sources import store
from shelfwise.sources.scratch import scratch

KEYS = ["brand", "name"]


def rows(df):
    return sorted((tuple(r[c] for c in sorted(df.columns)) for r in df.collect()), key=repr)


def frames(spark):
    make = lambda data: spark.createDataFrame(data, "brand string, name string, price string, ord int")
    master = make([("a", f"m{i}", "1", i) for i in range(40)] + [("a", "m1", "9", 99), (None, "x", "1", 0)])
    first = make([("a", f"m{i}", "2", i) for i in range(30)] + [("b", "n", "3", 2), ("b", "n", "4", 1), ("b", None, "1", 0)])
    second = make([("a", f"m{i}", "5", i) for i in range(10, 50)] + [("b", "n", "6", None), ("b", "n", "7", 5)])
    return master.withColumns({"first_seen_date": L.F.lit("01-01-2025"), "last_seen_date": L.F.lit("02-01-2025")}), first, second


def test_two_days_equal_the_plain_update(spark):
    master, first, second = frames(spark)
    base = scratch(spark, "b")
    store.start_master(master, base, KEYS, 8, "2025-01-02")
    store.roll_master(first, first.limit(0), base, "2025-01-03")
    store.roll_master(second, first, base, "2025-01-04")
    one = L.update_master(first, first.limit(0), master, KEYS, "2025-01-03")
    two = L.update_master(second, first, one, KEYS, "2025-01-04")
    got, number, content = store.read_bucketed(spark, base)
    assert number == 2 and rows(got) == rows(two)
    assert {r["price"] for r in got.where("brand = 'b'").collect()} == {"7"}
    files = [re.search(r"_(\d{5})\.c000", f).group(1) for f in glob.glob(f"{base}/{content['folder']}/*.parquet")]
    assert len(files) == len(set(files)) <= 8  # a file for each bucket: rows were not scattered


def test_master_is_not_shuffled(spark):
    master, first, second = frames(spark)
    base = scratch(spark, "b")
    store.start_master(master, base, KEYS, 8, "2025-01-02")
    table = store.read_bucketed(spark, base)[0]
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = L.update_master(first, second, table, KEYS, "2025-01-03", buckets=8)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    scan = next(i for i, line in enumerate(plan.split("\n")) if "SelectedBucketsCount: 8 out of 8" in line)
    depth = lambda line: len(line) - len(line.lstrip(" :+-*()0123456789"))
    lines, at, above = plan.split("\n"), None, []
    for line in reversed(lines[: scan + 1]):
        if at is None or depth(line) < at:
            at = depth(line)
            above.append(line)
    assert any("SortMergeJoin" in x for x in above) and not any("Exchange" in x for x in above)


def test_a_taken_number_is_an_error(spark, monkeypatch):
    master, first, _ = frames(spark)
    base = scratch(spark, "b")
    store.start_master(master, base, KEYS, 2, "2025-01-02")
    stale = store.read_bucketed(spark, base)
    store.roll_master(first, first.limit(0), base, "2025-01-03")
    monkeypatch.setattr(store, "read_bucketed", lambda *_: stale)
    with pytest.raises(RuntimeError):
        store.roll_master(first, first.limit(0), base, "2025-01-03")


def test_one_exchange_for_three_sides(spark, sf_dir):
    plan = catalog.queries()["lifecycle_join"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Join" not in plan
