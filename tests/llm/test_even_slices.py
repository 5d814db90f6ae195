"""Slices of a source are even for low quality too, and follow the order of keys; many small sources cost no quantiles."""

from pyspark.sql import functions as F

from shelfwise.llm import mixing


def sliced(rows):
    return mixing.with_slices(rows, rows.groupBy("source").agg(F.count("*").alias("n")))


def test_slices_of_low_quality(spark, monkeypatch):
    monkeypatch.setattr(mixing, "SLICE_ROWS", 100)
    ids = spark.range(20000).withColumn("source", F.when(F.col("id") % 4 > 0, "low").when(F.col("id") % 8 > 0, "high"))
    ids = ids.unionByName(spark.range(90).withColumn("source", F.lit("small")))
    weight = F.when(F.col("source") == "low", 0.05).otherwise(1.0)
    rows = ids.withColumn("order_key", mixing.order_key(F.col("id"), weight, 42))
    found = sliced(rows).groupBy("source", "slice").agg(F.count("*").alias("n"), F.min("order_key").alias("a"), F.max("order_key").alias("b")).collect()
    assert sum(r["n"] for r in found) == 20090
    for source, total, slices in (("low", 15000, 150), ("high", 2500, 64), (None, 2500, 64), ("small", 90, 1)):
        parts = sorted((r["slice"], r["n"], r["a"], r["b"]) for r in found if r["source"] == source)
        assert len(parts) == slices and max(n for _, n, _, _ in parts) < 2.5 * total / slices
        assert all(x[3] < y[2] for x, y in zip(parts, parts[1:]))


def test_many_sources_and_a_large_one(spark, monkeypatch):
    monkeypatch.setattr(mixing, "SLICE_ROWS", 200)
    rows = spark.range(200_000).withColumn("source", F.when(F.col("id") % 2 == 0, "large").otherwise(F.concat(F.lit("host"), F.col("id"))))
    out = sliced(rows.withColumn("order_key", F.rand(1)))
    assert "Broadcast" not in out._jdf.queryExecution().optimizedPlan().toString()
    counts = out.groupBy("source").agg(F.countDistinct("slice").alias("slices"), F.max("slice").alias("top"))
    assert counts.where("source = 'large'").first()["slices"] == 500 and counts.where("source <> 'large' and top > 0").count() == 0
    docs = rows.select(F.col("id").alias("doc_id"), "source", F.lit("a few words").alias("text"))
    mixed = mixing.mix(docs)
    assert mixed.count() == 200_000 and mixed.where("taken > 3 * size").count() == 0
    total = mixed.agg(F.sum("taken")).first()[0]
    assert abs(total - 600_000) <= 100_001
