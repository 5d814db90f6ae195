"""Sharding by sampled splitters.

Records are ordered by the hash of their text. A size-weighted Poisson sample of these hashes (its expected
size is a parameter) gives quantile boundaries of many more ranges than shards; records are range-partitioned by
them. A range that holds more than twice its share of bytes or rows is subdivided by key first: a text whose copies alone hold that much becomes a cell of its
own, and what is left of the range is cut at even distances of the hash. Cells of one text stay whole: they go to the emptiest shard, the
largest first. Only a text whose copies don't fit into any shard is dealt out by the hash of the id. The other cells then fill the room that
is left, in the order of keys, so shards are near equal in bytes.

Cases: null text is a record of size 1 (no bytes) and groups with other null texts; repeated rows are separate records; equal texts
stand in one shard unless their group exceeds what a shard can take; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections import defaultdict, deque

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from shelfwise.llm.common import cut, table, unit_hash

#: Ranges for each shard, and expected sample rows for each range.
RANGES_PER_SHARD, SAMPLE_PER_RANGE = 128, 8
#: A group of equal texts is dealt out if it would fill the emptiest shard beyond its share by more than this.
SLACK = 0.01


def record_size(text: Column) -> Column:
    """UTF-8 bytes plus 1; a null text has none."""
    return (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long")


def splitters(records: DataFrame, total: int, n_ranges: int, per_range: int = SAMPLE_PER_RANGE) -> np.ndarray:
    """Size-weighted quantiles of column `key`. At most about n_ranges * per_range rows reach the driver."""
    wanted = n_ranges * per_range
    share = F.col("size") * F.lit(wanted / max(total, 1))
    drawn = records.where(unit_hash(F.lit(17), F.col("key"), F.col("sub")) < share)
    rows = drawn.groupBy("key").agg(F.sum(F.greatest(share, F.lit(1.0))).alias("w")).collect()
    if not rows:
        return np.zeros(0, np.int64)
    keys = np.array([r["key"] for r in rows], np.int64)
    order = np.argsort(keys)
    keys, weight = keys[order], np.array([r["w"] for r in rows])[order]
    at = np.searchsorted(np.cumsum(weight), np.arange(1, n_ranges) * weight.sum() / n_ranges)
    return np.unique(keys[np.minimum(at, len(keys) - 1)])


def range_of(bounds: np.ndarray):
    """The range number of a key: that of the first boundary that is not below it."""

    @F.pandas_udf("int")
    def find(keys: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(bounds, keys.to_numpy(np.int64), side="left").astype(np.int32))

    return find


def planned(counts: list[dict], n_shards: int) -> dict[tuple[int, int, int], tuple[int, int]]:
    """(shard, rows in front of it there) of every (range, cell, part); `counts` has a row for each, a few times the number of ranges in all."""
    room = max(1.0, sum(r["bytes"] for r in counts) / n_shards)
    load, place, groups = np.zeros(n_shards), {}, defaultdict(list)
    for r in sorted(counts, key=lambda r: (r["range"], r["cell"], r["part"])):
        groups[(r["range"], r["cell"]) if r["cell"] < 0 else ()].append(r)
    others = groups.pop((), [])
    units = deque(sorted(groups.values(), key=lambda g: -sum(r["bytes"] for r in g)))
    while units:
        group = units.popleft()
        size, at = sum(r["bytes"] for r in group), int(load.argmin())
        if len(group) > 1 and load[at] + size > room * (1 + SLACK):
            units.extend([r] for r in group)
            continue
        load[at] += size
        place |= {(r["range"], r["cell"], r["part"]): at for r in group}
    left = np.maximum(room - load, 0)
    ends = np.cumsum(left) * sum(r["bytes"] for r in others) / max(left.sum(), 1e-9)
    before = 0
    for r in others:
        place[r["range"], r["cell"], r["part"]] = min(n_shards - 1, int(np.searchsorted(ends, before + r["bytes"] / 2, side="right")))
        before += r["bytes"]
    rows, out = np.zeros(n_shards, np.int64), {}
    for r in sorted(counts, key=lambda r: (r["range"], r["cell"], r["part"])):
        key = r["range"], r["cell"], r["part"]
        out[key] = place[key], int(rows[place[key]])
        rows[place[key]] += r["rows"]
    return out


def shard(docs: DataFrame, n_shards: int = 16, id_col: str = "doc_id", text_col: str = "text", ranges_per_shard: int = RANGES_PER_SHARD) -> DataFrame:
    """(id, size, text_crc32, range, cell, part, shard, slot) for every record; slot counts from 0 in each shard."""
    spark, text = docs.sparkSession, F.col(text_col)
    records = docs.select(
        F.col(id_col).alias("id"),
        record_size(text).alias("size"),
        F.coalesce(F.crc32(text), F.lit(0)).cast("long").alias("text_crc32"),
        F.xxhash64(text, F.lit(3)).alias("key"),
        F.xxhash64(F.col(id_col), text, F.lit(5)).alias("sub"),
    )
    records = cut(records)
    total, n_rows = (x or 0 for x in records.agg(F.sum("size"), F.count("*")).first())
    n_ranges = n_shards * ranges_per_shard
    ideal, ideal_rows = max(total / n_ranges, 1.0), max(n_rows / n_ranges, 1.0)
    # What a number of bytes and of rows is, in shares of a range: short texts fill a range by their number.
    shares = lambda size, rows: F.greatest(F.col(size) / ideal, F.col(rows) / ideal_rows)
    placed = records.withColumn("range", range_of(splitters(records, total, n_ranges))(F.col("key")))
    sizes = placed.groupBy("range").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows"), F.min("key").alias("low"), F.max("key").alias("high"))
    # At most n_ranges ranges hold more than twice their share of bytes or rows, and at most as many texts do.
    over = F.broadcast(sizes.where(shares("bytes", "rows") > 2).select("range"))
    hot = placed.join(over, "range", "left_semi").groupBy("range", "key").agg(F.sum("size").alias("hot_bytes"), F.count("*").alias("hot_rows")).where(shares("hot_bytes", "hot_rows") > 2)
    hot = cut(hot.withColumn("hot_cell", -F.row_number().over(Window.partitionBy("range").orderBy("key"))))
    taken = hot.groupBy("range").agg(F.sum("hot_bytes").alias("taken_bytes"), F.sum("hot_rows").alias("taken_rows"))
    rest = sizes.join(taken, "range", "left").withColumns({x: F.col(x) - F.coalesce(f"taken_{x}", F.lit(0)) for x in ("bytes", "rows")})
    rest = rest.select("range", "low", "high", F.greatest(F.lit(1), F.ceil(shares("bytes", "rows"))).cast("int").alias("cells"))
    along = (F.col("key").cast("double") - F.col("low").cast("double")) / (F.col("high").cast("double") - F.col("low").cast("double") + 1.0)
    celled = placed.join(F.broadcast(hot), ["range", "key"], "left").join(F.broadcast(rest), "range")
    celled = celled.withColumn("cell", F.coalesce("hot_cell", F.least(F.col("cells") - 1, F.floor(along * F.col("cells")).cast("int"))))
    parts = F.coalesce(F.ceil(shares("hot_bytes", "hot_rows") / 2), F.lit(1))
    celled = celled.withColumn("part", F.floor(unit_hash(F.lit(23), F.col("sub")) * parts).cast("int"))
    celled = cut(celled.select("id", "size", "text_crc32", "key", "sub", "range", "cell", "part"))
    # A row for each part: at most about four times n_ranges, whatever the number of records.
    counts = celled.groupBy("range", "cell", "part").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows")).collect()
    found = [(*k, *v) for k, v in planned([r.asDict() for r in counts], n_shards).items()]
    cells = spark.createDataFrame(found, "range int, cell int, part int, shard int, before long")
    row = Window.partitionBy("range", "cell", "part").orderBy("key", "sub", "id")
    out = celled.join(F.broadcast(cells), ["range", "cell", "part"]).withColumn("slot", F.col("before") + F.row_number().over(row) - 1)
    return out.select("id", "size", "text_crc32", "range", "cell", "part", "shard", F.col("slot").cast("long").alias("slot"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = shard(table(spark, sf_dir, "documents"))
    return out.select(F.col("id").alias("doc_id"), "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
