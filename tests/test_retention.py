"""Retention against sorting each group whole; limits on names that become columns."""

import random

import pytest
from pyspark.sql import functions as F

from shelfwise.operators import dedupe, export, reshape


@pytest.mark.parametrize("by", [[], ["brand"], ["brand", "kind"]])
@pytest.mark.parametrize("n", [0, 1, 5])
def test_retention_against_sorting(spark, by, n):
    rng = random.Random(7)
    rows = [(rng.choice(["a", "a", "a", "b", None]), rng.choice(["x", None]), f"/f{i // 2}", rng.choice([None, 1, 2, 3, 4]), i, "kept") for i in range(200)]
    df = spark.createDataFrame(rows, "brand string, kind string, path string, mtime int, i int, _n string")
    found = dedupe.retention(df, n, by)
    assert found.columns == [*df.columns, "archive"]
    groups, got = {}, {}
    for r in rows:
        groups.setdefault(tuple(r[["brand", "kind"].index(b)] for b in by), []).append(r)
    for r in found.collect():
        got.setdefault(tuple(r[b] for b in by), []).append(((r["mtime"] is not None, r["mtime"] or 0, r["path"]), r["archive"]))
    assert got.keys() == groups.keys() and sum(map(len, got.values())) == len(rows)
    for key, files in groups.items():
        newest = sorted(((m is not None, m or 0, p) for _, _, p, m, _, _ in files), reverse=True)
        assert sorted(k for k, archive in got[key] if not archive) == sorted(newest[:n])


def test_columns_of_the_user_stay(spark):
    df = spark.createDataFrame([("a", 1, "https://x.example/w_1200/p.jpg", "q", "n", ["red", None]), ("b", 2, "https://x.example/w_400/p.jpg", "q", "n", None)], "product string, ord int, url string, _q string, _n string, _c array<string>")
    assert dedupe.image_medium_cap(df).columns == df.columns
    out = reshape.explode_colors(df.withColumn("colors", F.col("_c")))
    assert out.columns == [*df.columns, "color"] and sorted(r["color"] for r in out.collect()) == ["", "", "red"]


def test_too_many_names_are_an_error(spark, monkeypatch):
    monkeypatch.setattr(reshape, "MAX_COLUMNS", 3)
    monkeypatch.setattr(export, "MAX_BRANDS", 3)
    specs = spark.range(5).select("id", F.create_map(F.concat(F.lit("k"), F.col("id").cast("string")), F.lit("v")).alias("specs"))
    with pytest.raises(ValueError):
        reshape.specs_to_wide_dynamic(specs)
    assert reshape.specs_to_wide_dynamic(specs, ["k1"]).columns == ["id", "spec_k1"]
    with pytest.raises(ValueError):
        export.export_per_brand_and_all(spark.range(5).select(F.col("id").cast("string").alias("brand")), "/nowhere", "2025-08-03")


def test_medium_images_of_a_hot_product(spark):
    """Against sorting every product, with equal rows, equal orders and products without a name."""
    import random

    from shelfwise.functions import rules as R
    from shelfwise.operators import dedupe as D

    rng, high, medium = random.Random(5), R.HIGH_QUALITY_IMAGES[0], R.MEDIUM_QUALITY_IMAGES[0]
    rows = [(rng.choice(["hot"] * 6 + ["a", "b", None]), rng.randrange(40), f"{rng.choice([high, medium, 'none'])}/{rng.randrange(5)}.jpg") for _ in range(600)]
    images = spark.createDataFrame(rows, "product string, ord int, url string").repartition(5)
    rated = {u: q for u, q in images.select("url", D.T.image_quality(images["url"])).distinct().collect()}
    want = []
    for product in {r[0] for r in rows}:
        own = sorted({r[1:] for r in rows if r[0] == product and rated[r[2]] in ("high", "medium")})
        want += [r for r in rows if r[0] == product and (rated[r[2]] == "high" or rated[r[2]] == "medium" and r[1:] in own[:7])]
    got = D.image_medium_cap(images, 7)
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr) and 0 < len(want) < len(rows)
    assert "WindowGroupLimit" in got._jdf.queryExecution().executedPlan().toString()
