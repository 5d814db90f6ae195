"""Bloom filter of a master's keys: exact results, few rows for the join."""

from pyspark.sql import functions as F

from shelfwise.operators import key_filter as K
from shelfwise.operators import lifecycle as L
from shelfwise.sources import store
from shelfwise.sources.scratch import scratch


def names(spark, first, last):
    return spark.range(first, last, numPartitions=4).select(F.concat(F.lit("n"), "id").alias("name"))


def test_exact_and_few_false_passes(spark):
    master, current = names(spark, 0, 100_000), names(spark, 99_000, 150_000)
    n = K.words_for(100_000)
    words = K.key_filter(master, ["name"], n).cache()
    known, new = K.known_names(current, master, ["name"], words, n), K.new_names(current, master, ["name"], words, n)
    assert known.exceptAll(L.known_names(current, master, ["name"])).count() == 0 and known.count() == 1000
    assert new.exceptAll(L.new_names(current, master, ["name"])).count() == 0 and new.count() == 50_000
    got = K.filter_quality(current, master, ["name"], words, n).first()
    assert (got["names"], got["known"]) == (51_000, 1000) and 0 < got["false_share"] < 0.02
    assert K.may_contain(current, words, ["name"], n).count() == got["passed"]
    words.unpersist()


def test_a_full_filter_costs_rows_not_results(spark):
    master, current = names(spark, 0, 5000), names(spark, 4000, 6000)
    words = K.key_filter(master, ["name"], 8)
    assert K.filter_quality(current, master, ["name"], words, 8).first()["false_share"] == 1
    assert K.known_names(current, master, ["name"], words, 8).count() == 1000 and K.new_names(current, master, ["name"], words, 8).count() == 1000


def test_nulls_repeats_empty_and_merging(spark):
    make = lambda rows: spark.createDataFrame(rows, "a string, b string")
    master = make([("x", "y"), ("x", "y"), (None, "y"), ("x", None), ("", "")])
    current = make([("x", "y"), ("x", "z"), ("x", "z"), (None, "y"), ("", ""), ("x", None)])
    words = K.key_filter(master, ["a", "b"], 1024)
    assert sorted(map(tuple, K.known_names(current, master, ["a", "b"], words, 1024).collect())) == [("", ""), ("x", "y")]
    assert sorted(map(tuple, K.new_names(current, master, ["a", "b"], words, 1024).collect())) == [("x", "z")]
    none = K.key_filter(master.limit(0), ["a", "b"], 1024)
    assert none.count() == 0 and K.may_contain(current, none, ["a", "b"], 1024).count() == 0
    both = K.merge_filters(words, K.key_filter(make([("x", "z")]), ["a", "b"], 1024))
    assert K.certainly_new(current, both, ["a", "b"], 1024).count() == 0


def test_kept_with_the_master(spark):
    base = scratch(spark, "f")
    rows = lambda a, b: names(spark, a, b).withColumn("price", F.lit("1"))
    store.start_master(rows(0, 1000), base, ["name"], 4, "2025-01-01", filter_words=K.words_for(5000))
    store.roll_master(rows(500, 2000), rows(0, 10), base, "2025-01-02")
    words, n = store.read_filter(spark, base)
    master, _, _ = store.read_bucketed(spark, base)
    got = K.filter_quality(names(spark, 0, 4000), master, ["name"], words, n).first()
    assert got["known"] == 2000 and 2000 <= got["passed"] < 2100
    assert K.new_names(names(spark, 0, 4000), master, ["name"], words, n).count() == 2000
