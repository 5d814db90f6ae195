"""SimHash near-duplicate detection: segment-popcount embedding, grid join, exact verification.

A 64-bit fingerprint is cut into 32 segments of two bits. Its embedding holds the number of one bits of every segment,
packed as unary digits (0 -> 00, 1 -> 01, 2 -> 11), so the Manhattan distance of two embeddings is the bit count of
their XOR and never exceeds the Hamming distance of the fingerprints. The space of either half of the segments is a grid whose cells are
its points (16 counts, so 3**16 cells). Of two fingerprints within d bits one half is within Manhattan distance d // 2: the range join
looks up, on both halves, the own cell and all cells within that distance, of two cells always the upper from the lower one.
Inside the join the Manhattan bound of the whole embedding goes first, then the exact Hamming distance, and a pair counts only in the first half that holds it.

Cases: null text counts as empty; texts without words have fingerprint zero and link like any other; repeated texts
and rows share one fingerprint, which enters the join once; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfwise.llm.common import ROW_KEY, connected_components, cut, row_key, table

BITS, SEGMENT_BITS, SHINGLE, SEED = 64, 2, 3, 42
_BLOCK = 1 << 15
_M = (1 << 64) - 1


def simhash(text: str | None, width: int = SHINGLE) -> int:
    """Majority bits of the XXH64 values of all `width`-word shingles, as an unsigned integer."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    n = len(words)
    if not n:
        return 0
    buf = b" ".join(words)
    if n < width:
        spans = [(0, len(buf))]
    else:
        lengths = np.fromiter(map(len, words), np.int64, n)
        ends = np.cumsum(lengths + 1) - 1
        spans = zip((ends - lengths)[: n - width + 1].tolist(), ends[width - 1 :].tolist())
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(buf[a:b], SEED) for a, b in spans], dtype="<u8")
    ones = np.zeros(BITS, np.int64)
    for i in range(0, len(hashes), _BLOCK):
        ones += np.unpackbits(hashes[i : i + _BLOCK].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def _simhash_batch(texts: pd.Series) -> pd.Series:
    return pd.Series(np.array([simhash(x) for x in texts], dtype=np.uint64).view(np.int64))


def simhash_column(text: Column) -> Column:
    return F.pandas_udf(_simhash_batch, "long")(text)


def embedding(fp: Column) -> Column:
    """Packed one-bit counts of the two-bit segments."""
    low = F.lit(0x5555555555555555)
    half = F.shiftrightunsigned(fp, 1)
    return fp.bitwiseOR(half).bitwiseAND(low).bitwiseOR(F.shiftleft(fp.bitwiseAND(half).bitwiseAND(low), 1))


def halves() -> list[int]:
    """Masks of the two halves of the embedding, as signed 64-bit integers."""
    return [(1 << 32) - 1, -(1 << 32)]


def upward(cells: Column, half: int) -> Column:
    """The cells that are one step up from `cells` (an array) on one segment of a half: a count of 0 becomes 1, of 1 becomes 2."""
    first = half * BITS // 2

    def steps(cell: Column) -> Column:
        moved = [
            cell.bitwiseOR(F.lit(signed(1 << s))).bitwiseOR(F.shiftleft(cell, 1).bitwiseAND(F.lit(signed(2 << s))))
            for s in range(first, first + BITS // 2, SEGMENT_BITS)
        ]
        return F.filter(F.array(*moved), lambda x: x != cell)

    return F.array_distinct(F.flatten(F.transform(cells, steps)))


def downward(cells: Column, half: int) -> Column:
    """The cells that are one step down from `cells`."""
    first = half * BITS // 2

    def steps(cell: Column) -> Column:
        moved = []
        for s in range(first, first + BITS // 2, SEGMENT_BITS):
            two = cell.bitwiseAND(F.lit(signed(2 << s))) != 0
            moved.append(F.when(two, cell.bitwiseAND(F.lit(signed(~(2 << s) & _M)))).otherwise(cell.bitwiseAND(F.lit(signed(~(1 << s) & _M)))))
        return F.filter(F.array(*moved), lambda x: x != cell)

    return F.array_distinct(F.flatten(F.transform(cells, steps)))


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def looked_up(cell: Column, half: int, reach: int) -> Column:
    """The cells within Manhattan distance `reach` that are not below `cell` in the order of (sum of counts, cell): every pair of cells meets from one side."""
    near, ring = [F.array(cell)], F.array(cell)
    for _ in range(reach):
        ring = F.array_union(upward(ring, half), downward(ring, half)) if reach > 1 else upward(ring, half)
        near.append(ring)
    found = F.array_distinct(F.concat(*near))
    if reach > 1:
        place = lambda c: F.struct(F.bit_count(c).alias("sum"), c.alias("cell"))
        found = F.filter(found, lambda c: place(c) >= place(cell))
    return found


def link_fingerprints(fps: DataFrame, distance: int = 3) -> DataFrame:
    """Pairs (a, b), a < b, of the distinct values of column `fp` with at most `distance` differing bits."""
    reach, masks = distance // 2, halves()
    e = fps.select("fp", embedding(F.col("fp")).alias("e"))
    own = [F.col("e").bitwiseAND(F.lit(m)) for m in masks]
    cells = e.select("fp", F.explode(F.array(*[F.struct(F.lit(h).alias("half"), c.alias("cell")) for h, c in enumerate(own)])).alias("x")).select("fp", "x.half", "x.cell")
    at = lambda h: lambda x: F.struct(F.lit(h).alias("half"), x.alias("cell"))
    visits = [F.transform(looked_up(c, h, reach), at(h)) for h, c in enumerate(own)]
    visits = e.select("fp", F.explode(F.concat(*visits)).alias("x")).select("fp", "x.half", "x.cell")
    a, b = visits.alias("a"), cells.alias("b")
    fa, fb = F.col("a.fp"), F.col("b.fp")
    apart = embedding(fa).bitwiseXOR(embedding(fb))
    there = [F.bit_count(apart.bitwiseAND(F.lit(m))) for m in masks]
    # Two fingerprints of one cell meet from both sides; two of different cells from one.
    once = F.when(F.col("a.half") == 0, (there[0] > 0) | (fa < fb)).otherwise((there[0] > reach) & ((there[1] > 0) | (fa < fb)))
    on = (F.col("a.half") == F.col("b.half")) & (F.col("a.cell") == F.col("b.cell")) & (fa != fb)
    on = on & (F.bit_count(apart) <= distance) & (F.bit_count(fa.bitwiseXOR(fb)) <= distance) & once
    return a.join(b, on).select(F.least(fa, fb).alias("a"), F.greatest(fa, fb).alias("b"))


def with_component(fps: DataFrame, distance: int = 3) -> DataFrame:
    """`fps`, a row for each fingerprint, with the least fingerprint that links reach."""
    parts = connected_components(link_fingerprints(fps, distance))
    return fps.join(parts.withColumnRenamed("node", "fp"), "fp", "left").withColumn("component", F.coalesce("component", "fp"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", distance: int = 3) -> DataFrame:
    """(id, fp, component_id): 64-bit fingerprint of each whole text and the least id that links reach."""
    marked = cut(docs.select(F.col(id_col).alias("id"), simhash_column(F.col(text_col)).alias("fp")))
    named = with_component(marked.groupBy("fp").agg(F.min("id").alias("least_id")), distance)
    least = named.groupBy("component").agg(F.min("least_id").alias("component_id"))
    by_fp = named.join(least, "component").select("fp", "component_id")
    return marked.join(by_fp, "fp").select("id", "fp", "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", distance: int = 3) -> DataFrame:
    """One row of `docs` (all its columns) for each group: the least by id (null last), fingerprint and row key.

    Groups are found on ids and keys alone; a second read of `docs` then fetches the chosen rows, so a text is shuffled once. Rows
    that are equal in every column are repeats of each other and are combined before that shuffle.
    """
    keyed = docs.withColumns(row_key(*docs.columns))
    marked = cut(keyed.select(F.col(id_col).alias("id"), *ROW_KEY, simhash_column(F.col(text_col)).alias("fp")))
    place = F.struct(F.col("id").isNull().alias("none"), "id", "fp", *ROW_KEY)
    named = with_component(marked.groupBy("fp").agg(F.min(place).alias("least")), distance)
    chosen = named.groupBy("component").agg(F.min("least").alias("least")).select(*[F.col("least")[k].alias(k) for k in ROW_KEY])
    return keyed.dropDuplicates(ROW_KEY).join(chosen, ROW_KEY, "left_semi").select(*docs.columns)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
