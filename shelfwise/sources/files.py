"""Readers and writers of snapshots, masters, pages and exports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfwise.operators import dedupe
from shelfwise.sources import ranges, store

_IMAGE = T.StructType([T.StructField(n, T.StringType()) for n in ("url", "local_path", "filename")])
_COLOR = T.StructType([T.StructField(n, T.StringType()) for n in ("id", "name", "url")])
#: Superset of the keys that snapshot records have; every key may be missing.
SNAPSHOT_SCHEMA = T.StructType(
    [T.StructField(n, T.StringType()) for n in ("name", "url", "full_url", "series", "base_url", "brand", "category", "price", "sku", "variant", "color", "description")]
    + [
        T.StructField("specifications", T.MapType(T.StringType(), T.StringType())),
        T.StructField("colors", T.ArrayType(_COLOR)),
        T.StructField("color_names", T.ArrayType(T.StringType())),
        T.StructField("color_ids", T.ArrayType(T.StringType())),
        T.StructField("hero_images", T.ArrayType(_IMAGE)),
    ]
)


def read_snapshot_csv(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """All columns as text; quoted fields may hold line breaks; empty is null. One file is read by many tasks; see `ranges.read_csv` for bad records."""
    return ranges.read_csv(spark, path).rows


def read_snapshot_json(spark: SparkSession, path: str | list[str], schema: T.StructType = SNAPSHOT_SCHEMA) -> DataFrame:
    """The objects of array files, one file by many tasks; see `ranges.read_json_objects` for bad ones and for VARIANT records without a schema."""
    return ranges.read_json_objects(spark, path, schema).rows


#: <brand>_bikes_<yyyyMMdd>_<HHmmss>.csv anywhere in a path: a file, or a folder of part files.
_ARCHIVE_NAME = r"([^/=]+)_bikes_(\d{8}_\d{6})\.csv"


def archive_scores(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(brand, snapshot, score, files, columns): rows times columns of each archived snapshot; the brand is the part of its name, in small letters.

    Snapshots with a record that can't be read are left out, as are other files; empty ones have no row.
    """
    sizes = ranges.csv_sizes(spark, path)
    named = sizes.select(F.lower(F.regexp_extract("file", _ARCHIVE_NAME, 1)).alias("brand"), F.regexp_extract("file", _ARCHIVE_NAME, 2).alias("snapshot"), "file", "n_rows", "n_cols", "n_bad", "columns")
    whole = named.where("brand <> ''").groupBy("brand", "snapshot").agg((F.sum("n_rows") * F.max("n_cols")).alias("score"), F.sum("n_bad").alias("n_bad"), F.collect_list("file").alias("files"), F.array_distinct(F.flatten(F.sort_array(F.collect_set("columns")))).alias("columns"))
    return whole.where("n_bad = 0").drop("n_bad")


def read_best_archives(spark: SparkSession, path: str | list[str], max_brands: int = 10_000, columns: list[str] | None = None) -> DataFrame:
    """Rows of the most complete snapshot of each brand, the newest of equal ones, with brand_name, snapshot and snapshot_date (the time part of its name).

    All files are counted; only the chosen ones are read as rows. Their names come to the driver: a snapshot for each brand, an error beyond max_brands.
    Columns are those of all counted snapshots, chosen or not, in the order of brands and snapshots, or `columns`; null where a file doesn't have them.
    """
    scores = archive_scores(spark, path).persist()
    best = dedupe.best_archive(scores)
    chosen = scores.join(best, ["brand", "snapshot"]).select("files").limit(max_brands + 1).collect()
    if columns is None:
        heads = scores.groupBy("columns").agg(F.min(F.struct("brand", "snapshot")).alias("first")).orderBy("first").collect()
        columns = list(dict.fromkeys(n for r in heads for n in r["columns"]))
    scores.unpersist()
    if len(chosen) > max_brands:
        raise ValueError(f"more than {max_brands} brands")
    if not chosen:
        named = T.StructType([T.StructField(n, T.StringType()) for n in ("brand_name", "snapshot", "snapshot_date", *columns)])
        return spark.createDataFrame([], named)
    rows = ranges.read_csv(spark, [f for r in chosen for f in r["files"]], file_column="__file", columns=columns).rows
    part = lambda g: F.regexp_extract("__file", _ARCHIVE_NAME, g)
    return rows.select(F.lower(part(1)).alias("brand_name"), part(2).alias("snapshot"), F.substring_index(part(2), "_", -1).alias("snapshot_date"), *[f"`{c}`" for c in rows.columns if c != "__file"])


def dealt(table: DataFrame, per_core: int = 4) -> DataFrame:
    """A table as read from files; where these give fewer than `per_core` splits a core, its rows are dealt out to so many partitions.

    A few MB of Parquet are one split, and a row group is never shared, so one task would do all of the work that follows. Larger tables are not shuffled.
    """
    wanted = per_core * table.sparkSession.sparkContext.defaultParallelism
    return table.repartition(wanted) if table.rdd.getNumPartitions() < wanted else table


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).select("page_id", "url", "html")


def parse_snapshot_name(name: Column) -> tuple[Column, Column]:
    """(brand, time stamp) of <brand>_bikes_<yyyyMMdd>_<HHmmss>.<ext>; null where the name has another form."""
    pattern = r"^(.+)_bikes_(\d{8}_\d{6})\.\w+$"
    part = lambda g: F.when(F.regexp_extract(name, pattern, g) != "", F.regexp_extract(name, pattern, g))
    return part(1), F.try_to_timestamp(part(2), F.lit("yyyyMMdd_HHmmss"))


def detect_brand_snapshots(files: DataFrame, name: str = "file_name") -> DataFrame:
    """The *_bikes_latest.csv files, with their brand."""
    stem = F.regexp_extract(name, r"^(.+)_bikes_latest\.csv$", 1)
    return files.withColumn("brand", F.initcap(F.replace(stem, F.lit("_"), F.lit(" ")))).where(stem != "")


def write_csv_quote_all(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).option("quoteAll", True).option("escape", '"').csv(path)


def write_csv_minimal(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def write_json_records(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def write_json_arrays(arrays: DataFrame, path: str, keys: list[str], ord_col: str, value: str = "value") -> None:
    """JSON arrays (texts, none empty) with the same `keys` one after another, as the array of one file below key=.../key=...

    Few large files instead of one for each array; the objects of a file are never one text.
    """
    along = Window.partitionBy(*keys).orderBy(ord_col)
    inside = F.expr(f"substring(`{value}`, 2, length(`{value}`) - 2)")
    first, last = F.lag(value).over(along).isNull(), F.lead(value).over(along).isNull()
    line = F.concat(F.when(first, "[").otherwise(","), inside, F.when(last, "]").otherwise(""))
    lines = arrays.select(*keys, ord_col, line.alias(value)).sortWithinPartitions(*keys, ord_col)
    lines.drop(ord_col).write.partitionBy(*keys).text(path)


def write_versioned_latest(df: DataFrame, base: str, ts: str) -> None:
    """One version for each time stamp, kept; readers see it when it is whole, through a commit."""
    store.write_version(df, base, ts)


def read_latest(spark: SparkSession, base: str) -> DataFrame:
    """The version of the greatest time stamp, no other version is opened."""
    return store.read_version(spark, base)


def write_by_brand(df: DataFrame, base: str) -> None:
    """Folders brand=<brand> below base in one pass; base itself reads as all brands."""
    df.write.mode("overwrite").partitionBy("brand").parquet(base)
