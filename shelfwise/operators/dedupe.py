"""First, last and longest row of a key; retention of files; image rules. Row order is always an explicit column."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfwise.functions import text as T
from shelfwise.sources.scratch import scratch


def first_by(df: DataFrame, keys: list, ord_col: str = "ord") -> DataFrame:
    """The first row of each key (minima combine before the shuffle, so a frequent key costs no more than others)."""
    names = df.columns
    named = [(F.col(k) if isinstance(k, str) else k).alias(f"_k{i}") for i, k in enumerate(keys)]
    packed = df.select(*named, F.struct(F.col(ord_col).alias("_o"), F.struct(*names).alias("_r")).alias("_x"))
    return packed.groupBy(*[f"_k{i}" for i in range(len(keys))]).agg(F.min_by("_x", "_x._o").alias("_x")).select(*[F.col(f"_x._r.{c}").alias(c) for c in names])


def first_by_name(df: DataFrame, key: str = "name", ord_col: str = "ord", drop_empty: bool = False) -> DataFrame:
    rows = df.where(F.col(key).isNotNull() & (F.col(key) != "")) if drop_empty else df
    return first_by(rows, [key], ord_col)


def first_by_base_url(df: DataFrame, url: str = "url", ord_col: str = "ord") -> DataFrame:
    return first_by(df, [T.base_url(F.col(url))], ord_col)


def first_by_url(df: DataFrame, url: str = "url", ord_col: str = "ord") -> DataFrame:
    return first_by(df, [url], ord_col)


def last_value_by_key(df: DataFrame, keys: list[str], value: str, ord_col: str = "ord") -> DataFrame:
    return df.groupBy(*keys).agg(F.max_by(value, ord_col).alias(value))


def first_value_by_key(df: DataFrame, keys: list[str], value: str, ord_col: str = "ord") -> DataFrame:
    return df.groupBy(*keys).agg(F.min_by(value, ord_col).alias(value))


def longest_value_by_key(df: DataFrame, keys: list[str], value: str, ord_col: str = "ord") -> DataFrame:
    return df.groupBy(*keys).agg(F.max_by(value, F.struct(F.length(value), -F.col(ord_col))).alias(value))


def best_archive(scores: DataFrame) -> DataFrame:
    """(brand, snapshot) of the largest score over 0; the newest snapshot wins ties."""
    return scores.where("score > 0").groupBy("brand").agg(F.max(F.struct("score", "snapshot"))["snapshot"].alias("snapshot"))


def retention(manifest: DataFrame, n: int, by: list[str], mtime: str = "mtime", tie: str = "path") -> DataFrame:
    """Manifest with archive = beyond the newest n of its group; an empty `by` counts all files together.

    No group is sorted whole: each task keeps its newest n + 1 files of a group, the n-th of these is the cut, and every row is compared with the
    cut of its group. The cuts are written, so the manifest is read twice: for them and for the result. Only where the file after the cut equals
    it in both columns (a manifest that lists a file twice), a third read numbers the rows that equal a cut.
    """
    if n <= 0:
        return manifest.withColumn("archive", F.lit(True))
    names = [f"__by{i}" for i in range(len(by))]
    keyed = manifest.withColumns({x: F.col(f"`{b}`") for x, b in zip(names, by)} | {"__key": F.struct(F.col(mtime).alias("m"), F.col(tie).alias("t"))})
    if by:
        w = Window.partitionBy(*names).orderBy(F.col("__key").desc())
        newest = keyed.select(*names, "__key", F.row_number().over(w).alias("__place")).where(F.col("__place") <= n + 1)
    else:
        newest = keyed.select("__key").orderBy(F.col("__key").desc()).limit(n + 1)
    cuts = newest.groupBy(*names).agg(F.sort_array(F.collect_list("__key"), asc=False).alias("__top"))
    last, after = F.get("__top", F.lit(n - 1)), F.get("__top", F.lit(n))
    cuts = cuts.select(*[F.col(x).alias(f"{x}c") for x in names], last.alias("__last"), F.size(F.filter("__top", lambda k: k > last)).alias("__newer"), (after == last).alias("__more"))
    path = scratch(manifest.sparkSession, "cuts")
    cuts.write.parquet(path)
    cuts = manifest.sparkSession.read.schema(cuts.schema).parquet(path)

    def beside(limits: DataFrame) -> DataFrame:
        if not by:
            return keyed.crossJoin(F.broadcast(limits))  # one row at most
        return keyed.join(limits, reduce(lambda a, b: a & b, [F.col(x).eqNullSafe(F.col(f"{x}c")) for x in names]))

    rows, twice = beside(cuts), cuts.where("__more")
    out = [*[f"`{x}`" for x in manifest.columns if x != "archive"], "archive"]
    older = F.coalesce(F.col("__key") < F.col("__last"), F.lit(False))
    if by and twice.isEmpty():
        return rows.withColumn("archive", older).select(*out)
    # With one cut for all, adaptive execution drops this branch where `twice` is empty.
    tied = F.coalesce(F.col("__more") & (F.col("__key") == F.col("__last")), F.lit(False))
    inside = Window.partitionBy(*names, "__key").orderBy(F.col(tie).desc())
    numbered = beside(twice).where(tied).withColumn("archive", F.row_number().over(inside) + F.col("__newer") > n)
    return rows.where(~tied).withColumn("archive", older).unionByName(numbered).select(*out)


def archive_target_name(to_archive: DataFrame, archived: DataFrame, ts: str, name: str = "file_name") -> DataFrame:
    """target: the file's name, or name_archived_<ts>.ext where that is taken."""
    taken = archived.select(F.col(name).alias("__taken")).distinct()
    joined = to_archive.join(taken, F.col(name) == F.col("__taken"), "left")
    stem, ext = F.regexp_extract(name, r"^(.*)(\.[^.]*)$", 1), F.regexp_extract(name, r"^(.*)(\.[^.]*)$", 2)
    return joined.withColumn("target", F.when(F.col("__taken").isNull(), F.col(name)).otherwise(F.concat(stem, F.lit(f"_archived_{ts}"), ext))).drop("__taken")


def image_medium_cap(images: DataFrame, cap: int = 10, product: str = "product", ord_col: str = "ord") -> DataFrame:
    """High quality always stays, medium only among the first `cap` candidates of its product.

    No product is sorted whole: each task keeps its first `cap` candidates of a product, and medium ones are compared with the last of the first `cap` by
    order and address. Equal candidates are one; a null product is a product.
    """
    rows = images.withColumns({"__quality": T.image_quality(F.col("url")), "__at": F.struct(F.col(ord_col).alias("o"), F.col("url").alias("u"))})
    rows = rows.where(F.col("__quality").isin("high", "medium"))
    w = Window.partitionBy("__product").orderBy("__at")
    first = rows.select(F.col(product).alias("__product"), "__at").withColumn("__place", F.dense_rank().over(w)).where(F.col("__place") <= cap)
    last = first.groupBy("__product").agg(F.max("__at").alias("__last"))
    medium = rows.where("__quality = 'medium'").join(last, F.col(product).eqNullSafe(F.col("__product"))).where(F.col("__at") <= F.col("__last"))
    return rows.where("__quality = 'high'").select(*images.columns).unionByName(medium.select(*images.columns))


def image_dedupe(images: DataFrame, product: str = "product", ord_col: str = "ord") -> DataFrame:
    return first_by(images, [product, T.image_base_path(F.col("url"))], ord_col)


def image_position(images: DataFrame, n: int = 10, product: str = "product", ord_col: str = "ord") -> DataFrame:
    w = Window.partitionBy(product).orderBy(ord_col)
    return images.withColumn("position", F.row_number().over(w)).where(F.col("position") <= n)


def by_pattern(file_name: Column) -> Column:
    """The pattern that a versioned file belongs to: its name without time stamp."""
    return F.regexp_replace(file_name, r"_\d{8}_\d{6}", "")
