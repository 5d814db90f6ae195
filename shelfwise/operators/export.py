"""Shop-import exports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfwise.operators.reshape import filter_brands, meta_images, wide_to_meta
from shelfwise.sources.files import write_by_brand

#: Brands that one export may name.
MAX_BRANDS = 1000
STATE_META = {"status": "meta:availability_status", "first_seen_date": "meta:first_seen_date", "last_seen_date": "meta:last_seen_date", "last_updated": "meta:last_updated"}


def available_only(df: DataFrame, statuses: list[str] = ("Available",)) -> DataFrame:
    return df.where(F.col("status").isin(list(statuses)))


def drop_untitled(df: DataFrame) -> DataFrame:
    return df.where(F.col("post_title").isNotNull())


def export_single(snapshot: DataFrame, as_of: str, source: str, n: int = 5) -> DataFrame:
    """All rows of a snapshot as import rows with up to n images."""
    return drop_untitled(wide_to_meta(snapshot, {"meta:import_date": as_of, "meta:import_source": source}, meta_images(snapshot, n)))


def export_unified(master: DataFrame, brands: list[str], as_of: str, statuses: list[str] = ("Available",), n: int = 10) -> DataFrame:
    """Rows of the given brands and statuses as import rows with status columns and filled images."""
    rows = available_only(filter_brands(master, brands), statuses)
    state = [F.col(c).alias(m) for c, m in STATE_META.items() if c in rows.columns]
    return drop_untitled(wide_to_meta(rows, {"meta:import_date": as_of, "meta:import_brands": ", ".join(brands)}, [*state, *meta_images(rows, n, only_filled=True)]))


def export_per_brand_and_all(master: DataFrame, base: str, as_of: str) -> None:
    """One export of all brands, written once in folders by brand; the whole is the folder above.

    The names of the brands stand in every row, so more than MAX_BRANDS of them is an error.
    """
    brands = sorted(r[0] for r in master.select("brand").distinct().where("brand is not null").limit(MAX_BRANDS + 1).collect())
    if len(brands) > MAX_BRANDS:
        raise ValueError(f"more than {MAX_BRANDS} brands")
    write_by_brand(export_unified(master, brands, as_of), base)
