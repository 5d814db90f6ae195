"""Catalog summaries: counts, ranges, shares, coverage and small top lists."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shelfwise.functions import text as T


def model_and_variant_counts(df: DataFrame) -> DataFrame:
    return df.agg(F.countDistinct("name").alias("models"), F.count("*").alias("variants"))


def multi_color_models(df: DataFrame) -> DataFrame:
    return df.groupBy("name").agg(F.count("*").alias("variants")).where("variants > 1")


def variants_by_model(df: DataFrame) -> DataFrame:
    """name, variants: array of (ord, color, variant, price, url) in order.

    All variants of a model stand in one value, so a model may have as many as a row can hold; `variants_in_order` has no such bound.
    """
    return df.groupBy("name").agg(F.array_sort(F.collect_list(F.struct("ord", "color", "variant", "price", "url"))).alias("variants"))


def variants_in_order(df: DataFrame) -> DataFrame:
    """The long form: one row for each variant, in ranges of (name, ord), so that rows of one frequent name are spread over tasks."""
    rows = df.select("name", "ord", "color", "variant", "price", "url")
    return rows.repartitionByRange("name", "ord").sortWithinPartitions("name", "ord")


def price_range(df: DataFrame, price: str = "price") -> DataFrame:
    p = T.price_to_int(F.col(price))
    return df.agg(F.min(p).alias("min_price"), F.max(p).alias("max_price"))


def category_counts(df: DataFrame) -> DataFrame:
    return df.groupBy(F.coalesce("category", F.lit("Unknown")).alias("category")).agg(F.count("*").alias("n")).orderBy("category")


def color_counts(df: DataFrame) -> DataFrame:
    """color, n and the number of colours."""
    rows = df.where(F.col("color") != "").groupBy("color").agg(F.count("*").alias("n"))
    return rows.withColumn("colors", F.count("*").over(Window.partitionBy(F.lit(0)))).orderBy("color")


def status_counts(df: DataFrame) -> DataFrame:
    return df.groupBy("status").agg(F.count("*").alias("n"))


def brand_status_summary(df: DataFrame) -> DataFrame:
    """Per brand and in total (brand null, is_total 1): all, new, available, discontinued."""
    one = lambda s: F.count_if(F.col("status") == s).alias(s.lower())
    return df.rollup("brand").agg(F.count("*").alias("total"), one("New"), one("Available"), one("Discontinued"), F.grouping("brand").cast("int").alias("is_total"))


def brand_share(df: DataFrame) -> DataFrame:
    rows = df.groupBy("brand").agg(F.count("*").alias("n"))
    return rows.withColumn("percent", F.round(100.0 * F.col("n") / F.sum("n").over(Window.partitionBy(F.lit(0))), 4))


def image_coverage(df: DataFrame, images: str = "n_images") -> DataFrame:
    n = F.coalesce(F.col(images), F.lit(0))
    return df.agg(F.count("*").alias("products"), F.count_if(n > 0).alias("with_images"), F.coalesce(F.sum(n), F.lit(0)).cast("long").alias("images"), F.round(100.0 * F.count_if(n > 0) / F.count("*"), 4).alias("coverage"))


def image_stats_by_brand(df: DataFrame, images: str = "n_images") -> DataFrame:
    n = F.coalesce(F.col(images), F.lit(0))
    return df.groupBy("brand").agg(F.count_if(n > 0).alias("with_images"), F.sum(n).cast("long").alias("images"), F.round(F.avg(n), 4).alias("average"))


def snapshot_scores(snapshots: DataFrame, n_cols: int | None = None) -> DataFrame:
    """(brand, snapshot, score = rows x columns)."""
    width = n_cols or len(snapshots.columns)
    return snapshots.groupBy("brand", "snapshot").agg((F.count("*") * width).alias("score"))


def column_fill(df: DataFrame) -> DataFrame:
    """One pass: for every column the number of rows with a value."""
    cols = df.columns
    counted = df.agg(*[F.count(F.when(F.col(f"`{c}`").cast("string") != "", 1)).alias(f"c{i}") for i, c in enumerate(cols)])
    return counted.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(f"c{i}").alias("filled")) for i, c in enumerate(cols)])).alias("x")).select("x.*")


def skus_by_name(df: DataFrame) -> DataFrame:
    """name, skus: the distinct numbers of a name in one sorted array, as many as a row can hold."""
    return df.groupBy("name").agg(F.array_sort(F.collect_set("sku")).alias("skus"))


def top_price(df: DataFrame, n: int = 5, price: str = "price") -> DataFrame:
    p = T.price_to_int(F.col(price))
    return df.withColumn("price_int", p).where("price_int is not null").orderBy(F.col("price_int").desc(), "ord").limit(n)


def first_n_multi_color(df: DataFrame, n: int = 5) -> DataFrame:
    """The first n models with several rows, and how many remain."""
    models = df.groupBy("name").agg(F.count("*").alias("variants"), F.min("ord").alias("first_ord")).where("variants > 1")
    total = models.agg(F.count("*").alias("total"))
    top = models.orderBy("first_ord").limit(n)
    return top.join(total, F.lit(True)).select("name", "variants", "first_ord", F.greatest(F.col("total") - n, F.lit(0)).alias("remaining"))


def newest_files(manifest: DataFrame) -> DataFrame:
    return manifest.orderBy(F.col("mtime").desc(), F.col("path").desc())
