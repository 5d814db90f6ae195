"""Counts over snapshots from theta sketches: a snapshot is read once, later comparisons read its sketch only.

A sketch holds up to 2^lg_k hashes of distinct keys. Below that many its counts are exact; above, a union is within 2 / sqrt(2^lg_k) of its size in 95 of 100
cases, and an intersection or difference within that share of the size of the union. `error` gives this bound as a number of keys, 0 where counts are exact.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from shelfwise.sources.store import Store, read_version, write_version

LG_K = 16


def _known(keys: list[str]) -> Column:
    return reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in keys])


def snapshot_sketches(df: DataFrame, by: list[str], keys: list[str], lg_k: int = LG_K) -> DataFrame:
    """by, variants (rows) and sketch of the distinct keys, for each group; sketches are made before the shuffle and merged after it.

    Rows with a null key are counted as variants, not as keys; a null group is a group.
    """
    key = F.when(_known(keys), F.to_json(F.struct(*keys)))
    return df.groupBy(*by).agg(F.count("*").alias("variants"), F.theta_sketch_agg(key, lg_k).alias("sketch"))


def merged(sketches: DataFrame, by: list[str], lg_k: int = LG_K) -> DataFrame:
    """Sketches of coarser groups: all snapshots of a brand, all brands."""
    return sketches.groupBy(*by).agg(F.sum("variants").alias("variants"), F.theta_union_agg("sketch", lg_k).alias("sketch"))


def model_counts(sketches: DataFrame, lg_k: int = LG_K) -> DataFrame:
    """The groups with models instead of the sketch, and the error of it."""
    models = F.theta_sketch_estimate("sketch")
    return sketches.select(*[c for c in sketches.columns if c != "sketch"], models.alias("models"), _error(models, lg_k).alias("error"))


def _error(union: Column, lg_k: int) -> Column:
    return F.when(union < F.lit(1 << lg_k), F.lit(0)).otherwise(F.ceil(union * (2 / (1 << lg_k) ** 0.5))).cast("long")


def overlap_counts(pairs: DataFrame, new: str = "sketch", old: str = "old_sketch", lg_k: int = LG_K) -> DataFrame:
    """Rows with two sketches: models there now, added, kept and gone, all models and the error; the sketches are left out. No older snapshot is none."""
    both = F.theta_union(new, F.coalesce(old, new), lg_k)
    estimate = F.theta_sketch_estimate
    lone = F.col(old).isNull()
    rest = [c for c in pairs.columns if c not in (new, old)]
    return pairs.select(
        *rest,
        estimate(new).alias("models"),
        F.when(lone, estimate(new)).otherwise(estimate(F.theta_difference(new, old))).alias("added"),
        F.when(lone, F.lit(0)).otherwise(estimate(F.theta_intersection(new, old))).cast("long").alias("kept"),
        F.when(lone, F.lit(0)).otherwise(estimate(F.theta_difference(old, new))).cast("long").alias("gone"),
        estimate(both).alias("either"),
        _error(estimate(both), lg_k).alias("error"),
    )


def successive(sketches: DataFrame, by: list[str], date: str) -> DataFrame:
    """Each snapshot with the sketch of the one before it in its group; one row a snapshot, so groups are as long as there are dates."""
    return sketches.withColumn("old_sketch", F.lag("sketch").over(Window.partitionBy(*by).orderBy(date)))


def add_snapshot(df: DataFrame, base: str, date: str, by: list[str], keys: list[str], lg_k: int = LG_K) -> int:
    """Commit the sketches of the snapshot of `date` beside those of other dates; a date that is there already is replaced. Snapshots are not read again."""
    new = snapshot_sketches(df, by, keys, lg_k).withColumn("snapshot_date", F.lit(date))
    if Store(df.sparkSession, base).latest() is not None:
        new = all_snapshots(df.sparkSession, base).where(F.col("snapshot_date") != date).unionByName(new)
    return write_version(new, base, f"{len(Store(df.sparkSession, base).numbers()):020d}")


def all_snapshots(spark: SparkSession, base: str) -> DataFrame:
    return read_version(spark, base)
