"""Long and wide forms of specifications, images and shop-import rows."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfwise.functions import rules as R
from shelfwise.functions import text as T
from shelfwise.operators.summary import column_fill


#: Distinct keys that may become columns.
MAX_COLUMNS = 2000


def specs_to_wide_dynamic(products: DataFrame, keys: list[str] | None = None, specs: str = "specs") -> DataFrame:
    """spec_* columns for the given keys, or for all distinct keys: they become columns, so more than MAX_COLUMNS of them is an error."""
    if keys is None:
        keys = sorted(r[0] for r in products.select(F.explode(F.map_keys(specs))).distinct().limit(MAX_COLUMNS + 1).collect())
        if len(keys) > MAX_COLUMNS:
            raise ValueError(f"more than {MAX_COLUMNS} distinct keys; give the keys that should become columns")
    wide = [F.try_element_at(specs, F.lit(k)).alias("spec_" + k.replace(" ", "_").replace("/", "_")) for k in keys]
    return products.select(*[c for c in products.columns if c != specs], *wide)


def hot_keys(products: DataFrame, n: int = 200, tracked: int = 10_000, specs: str = "specs") -> list[str]:
    """At most n keys that hold a value most often, found in one pass by a frequent-item sketch of bounded size.

    With N filled values in all, a key that is left out holds at most 2.7 * N / tracked more values than one that is chosen; with fewer distinct keys than
    `tracked` the choice is exact. Equal counts are broken by the sketch's own order.
    """
    key = products.select(F.explode(F.map_entries(specs)).alias("e")).where(F.trim("e.value") != "").select(F.col("e.key").alias("key"))
    top = key.agg(F.expr(f"approx_top_k(key, {int(n)}, {int(tracked)})").alias("top")).first()["top"]
    return [r["item"] for r in top or []]


def specs_to_wide_hot(products: DataFrame, n: int = 200, tracked: int = 10_000, specs: str = "specs", keys: list[str] | None = None) -> DataFrame:
    """spec_* columns for the n most frequent keys (or the given ones), everything else in the VARIANT spec_overflow (null where nothing is left).

    Any number of distinct keys may occur and no value is lost: keys that would get the column of another key, or one that the products have, stay in the overflow.
    """
    name = lambda k: "spec_" + k.replace(" ", "_").replace("/", "_")
    taken, chosen = {x.lower() for x in products.columns if x != specs} | {"spec_overflow"}, []
    for k in hot_keys(products, n, tracked, specs) if keys is None else keys:
        if name(k).lower() not in taken:
            taken.add(name(k).lower())
            chosen.append(k)
    wide = [F.try_element_at(specs, F.lit(k)).alias(name(k)) for k in sorted(chosen)]
    rest = F.map_filter(specs, lambda k, v: ~F.coalesce(k.isin(chosen), F.lit(False))) if chosen else F.col(specs)
    overflow = F.when(F.size(rest) > 0, F.to_variant_object(rest)).alias("spec_overflow")
    return products.select(*[f"`{c}`" for c in products.columns if c != specs], *wide, overflow)


def overflow_value(key: str, overflow: str = "spec_overflow") -> Column:
    """The text of one key in the overflow; null where it isn't there."""
    if re.fullmatch(r"[\w ./-]+", key):
        return F.try_variant_get(overflow, f"$['{key}']", "string")
    return F.try_element_at(F.try_variant_get(overflow, "$", "map<string,string>"), F.lit(key))  # paths can't quote every key


def specs_to_wide_fixed(products: DataFrame, names: list[str] = R.REQUIRED_SPECS, specs: str = "specs") -> DataFrame:
    fields = T.required_spec_defaults(F.col(specs), [*names, *R.EXTRA_SPECS])
    return products.select(*[c for c in products.columns if c != specs], *[f.alias(f"spec_{n}") for f, n in zip(fields, [*names, *R.EXTRA_SPECS])])


def images_to_wide(products: DataFrame, n: int, images: str = "images") -> DataFrame:
    """hero_image_{i}_url, _path and _filename from an array of (url, local_path, filename)."""
    wide = [F.get(images, F.lit(i - 1))[field].alias(f"hero_image_{i}_{name}") for i in range(1, n + 1) for field, name in (("url", "url"), ("local_path", "path"), ("filename", "filename"))]
    return products.select(*[c for c in products.columns if c != images], *wide)


def explode_colors(df: DataFrame, colors: str = "colors") -> DataFrame:
    """One row for each colour; products without colours keep one row with ''."""
    filled = F.when(F.size(colors) > 0, F.transform(colors, lambda x: F.coalesce(x, F.lit("")))).otherwise(F.array(F.lit("")))
    return df.select(*[c for c in df.columns if c not in (colors, "color")], F.explode(filled).alias("color"))


def specs_to_long(df: DataFrame, ids: list[str], prefix: str = "spec_") -> DataFrame:
    """(ids, key, value) for the non-null columns with the prefix."""
    cols = [c for c in df.columns if c.startswith(prefix)]
    pairs = F.explode(F.array(*[F.struct(F.lit(c.removeprefix(prefix)).alias("key"), F.col(f"`{c}`").cast("string").alias("value")) for c in cols])).alias("_p")
    return df.select(*ids, pairs).select(*ids, "_p.key", "_p.value").where("value is not null")


# Column names of the shop import.
IMPORT_NAMES = {"name": "post_title", "description": "post_content", "sku": "sku", "price": "regular_price", "category": "product_cat", "brand": "brand", "url": "product_url", "variant": "variant", "color": "color"}
IMPORT_CONSTANTS = {"post_status": "publish", "post_type": "product"}


def meta_name(column: str) -> str:
    return "meta:" + column.replace("spec_", "")


def wide_to_meta(df: DataFrame, extra: dict[str, str] | None = None, images: list | None = None) -> DataFrame:
    """Import columns that the input has, constants, meta:* for every spec_ column, image columns and extra constants."""
    named = [F.col(c).alias(n) for c, n in IMPORT_NAMES.items() if c in df.columns]
    fixed = [F.lit(v).alias(n) for n, v in IMPORT_CONSTANTS.items()]
    meta = [F.col(f"`{c}`").alias(meta_name(c)) for c in df.columns if "spec_" in c]
    return df.select(*named, *fixed, *meta, *(images or []), *[F.lit(v).alias(n) for n, v in (extra or {}).items()])


def meta_images(df: DataFrame, n: int = 5, only_filled: bool = False) -> list:
    """Columns: image 1 as `images`, images 2..n as meta:additional_image_i, local paths; with only_filled those with any value."""
    have = set(df.columns)
    if only_filled:
        wanted = [c for c in df.columns if c.startswith("hero_image_")]
        have = {r["column_name"] for r in column_fill(df.select(*wanted)).where("filled > 0").collect()} if wanted else set()
    out = []
    for i in range(1, n + 1):
        if f"hero_image_{i}_url" in have:
            out.append(F.col(f"hero_image_{i}_url").alias("images" if i == 1 else f"meta:additional_image_{i}"))
        if f"hero_image_{i}_path" in have:
            out.append(F.col(f"hero_image_{i}_path").alias(f"meta:image_{i}_local_path"))
    return out


def date_discontinued_second(df: DataFrame) -> DataFrame:
    first, *rest = df.columns
    return df.select(first, F.col("last_seen_date").alias("date_discontinued"), *[F.col(f"`{c}`") for c in rest])


def sorted_custom_fields(df: DataFrame) -> list[str]:
    return sorted(c for c in df.columns if c.startswith("meta:"))


def custom_field_counts(df: DataFrame) -> DataFrame:
    """(place, field, filled): the meta:* fields in order of their names, and how many rows have a value in each. One pass over the rows."""
    fields = sorted_custom_fields(df)
    counts = df.agg(*[F.count_if(F.trim(F.col(f"`{f}`")) != "").alias(f"n{i}") for i, f in enumerate(fields)])
    rows = F.array(*[F.struct(F.lit(i).cast("long").alias("place"), F.lit(f).alias("field"), F.col(f"n{i}").alias("filled")) for i, f in enumerate(fields)])
    return counts.select(F.inline(rows))


def unify_brands(dfs: list[DataFrame]) -> DataFrame:
    """Union by column name; missing columns are null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), dfs)


def filter_brands(df: DataFrame, brands: list[str]) -> DataFrame:
    return df.where(F.col("brand").isin(brands))


def distinct_brands(df: DataFrame) -> DataFrame:
    return df.select("brand").distinct()
