"""Wide columns for frequent keys, an overflow for the others."""

from pyspark.sql import functions as F

from shelfwise.operators import reshape as W


def test_no_value_is_lost(spark):
    data = [(1, {"A b": "1", "A/b": "2", "it's": "3", 'q"x\\y': "4"}), (2, {"A b": "5", "rare": "6"}), (3, {}), (4, None), (5, {"A b": None, "": "7"})]
    df = W.specs_to_wide_hot(spark.createDataFrame(data, "id int, specs map<string,string>"), keys=["A b", "A/b", "id"])
    assert df.columns == ["id", "spec_A_b", "spec_id", "spec_overflow"]
    keys = ["A/b", "it's", 'q"x\\y', "rare", ""]
    rows = {r["id"]: r for r in df.select("id", "spec_A_b", F.col("spec_overflow").isNull().alias("none"), *[W.overflow_value(k).alias(f"v{i}") for i, k in enumerate(keys)]).collect()}
    assert [rows[1][f"v{i}"] for i in range(5)] == ["2", "3", "4", None, None]
    assert (rows[1]["spec_A_b"], rows[2]["spec_A_b"], rows[2]["v3"], rows[5]["v4"]) == ("1", "5", "6", "7")
    assert [rows[i]["none"] for i in (1, 2, 3, 4, 5)] == [False, False, True, True, False]


def test_columns_of_the_products_are_not_hidden(spark):
    df = spark.createDataFrame([("x", {"a": "1", "overflow": "2"})], "spec_a string, specs map<string,string>")
    out = W.specs_to_wide_hot(df)
    assert out.columns == ["spec_a", "spec_overflow"]
    assert tuple(out.select("spec_a", W.overflow_value("a"), W.overflow_value("overflow")).first()) == ("x", "1", "2")


def test_a_million_keys_stay_within_the_bound(spark):
    # A thousand keys with falling counts between a million that occur once.
    rows = spark.range(0, 1_000_000, numPartitions=8).select(
        F.create_map(F.concat(F.lit("once"), "id"), F.lit("v"), F.concat(F.lit("hot"), F.floor(F.pow(F.rand(7) * 31.6, 2)).cast("string")), F.lit("w")).alias("specs")
    ).cache()
    tracked, n = 2000, 50
    chosen = W.hot_keys(rows, n, tracked)
    counts = {r[0]: r[1] for r in rows.select(F.explode("specs").alias("key", "value")).groupBy("key").count().orderBy(F.desc("count")).limit(3000).collect()}
    total = 2_000_000
    least = min(counts.get(k, 1) for k in chosen)
    assert len(set(chosen)) == n
    assert max(v for k, v in counts.items() if k not in chosen) <= least + 2.7 * total / tracked
    wide = W.specs_to_wide_hot(rows, keys=chosen)
    filled = wide.agg(*[F.count(f"spec_{k}").alias(k) for k in chosen], F.count("spec_overflow").alias("rest")).first()
    assert all(filled[k] == counts.get(k, 1) for k in chosen) and filled["rest"] == 1_000_000
    rows.unpersist()


def test_exact_with_few_keys_and_none_without_values(spark):
    df = spark.createDataFrame([({"a": "1", "b": " ", "c": "2"},), ({"a": "1", "b": "", "c": None},)], "specs map<string,string>")
    assert W.hot_keys(df, 1) == ["a"] and sorted(W.hot_keys(df)) == ["a", "c"]
    assert W.hot_keys(df.limit(0)) == [] and W.specs_to_wide_hot(df.limit(0)).columns == ["spec_overflow"]
