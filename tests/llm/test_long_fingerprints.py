"""Long texts of many lines, and ids that many rows share."""

import random

import pytest
from pyspark.sql import functions as F

from shelfwise.llm import fingerprints as fp


def lines(seed, n):
    rng = random.Random(seed)
    return [f"{rng.getrandbits(60):x} line" for _ in range(n)]


def differing(spark, pairs):
    df = spark.createDataFrame([(i, "\n".join(a), "\n".join(b)) for i, (a, b) in enumerate(pairs)], "k int, ta string, tb string")
    df = df.select("k", fp.digests(F.col("ta")).alias("a"), fp.digests(F.col("tb")).alias("b"))
    for name in "ab":
        df = df.withColumn(f"{name}s", F.expr(fp.sketch(f"`{name}`", 1, fp.STORED_WIDTH)))
    return fp.differing(df, "a", "b", "as", "bs", "d")


def test_twenty_thousand_lines(spark):
    base = lines(1, 20_000)
    pairs = [(base, base[:10_000] + lines(2, 10_000)), (base, lines(3, 20_000)), (base, base[5:] + lines(4, 20)), (base, base), (base, []), (lines(5, 4000), lines(6, 3000))]
    for r in differing(spark, pairs).collect():
        assert len(r["d"]) == len(set(r["d"])) and set(r["d"]) == set(r["a"]) ^ set(r["b"])
        assert len(r["d"]) == len(set(pairs[r["k"]][0]) ^ set(pairs[r["k"]][1]))


def test_estimate_follows_the_difference(spark):
    pairs = [(lines(i, n + 300), lines(i, 300)) if i % 2 else (lines(i, 300) + lines(-i - 1, n), lines(i, 300) + lines(-i - 2000, n)) for i in range(40) for n in (30, 300)]
    out = differing(spark, pairs).withColumn("e", F.expr(fp.estimated_difference(fp.subtract("`as`", "`bs`"), fp.STORED_WIDTH))).collect()
    ratios = sorted(r["e"] / len(r["d"]) for r in out)
    assert 0.75 < sum(ratios) / len(ratios) < 1.25 and ratios[4] > 0.4 and ratios[-5] < 2
    # Sub-tables for 30 differing digests of 20,000 hold fewer cells than there are digests.
    assert 1.5 * 2 * 30 / fp.PLANNED * 3 * fp.RETRY_WIDTH * 3 < 20_000


def test_sub_tables_hold_every_digest_once(spark):
    df = spark.createDataFrame([(list(range(n)), parts) for n, parts in ((0, 1), (1, 4), (50, 1), (500, 7), (37, 90))], "keys array<bigint>, parts int")
    for r in df.withColumn("dealt", F.expr(fp.dealt("keys", 3, "parts"))).withColumn("want", F.transform("keys", lambda k: F.pmod(F.xxhash64(k, F.lit(53)), F.col("parts")))).collect():
        assert len(r["dealt"]) == r["parts"]
        assert [sorted(x) for x in r["dealt"]] == [[k for k, p in zip(r["keys"], r["want"]) if p == i] for i in range(r["parts"])]


@pytest.mark.parametrize("buckets", [1, 3, 40])
def test_next_text_where_many_rows_share_an_id(spark, buckets):
    rows = [(None, f"null {i}") for i in range(300)] + [(5, f"five {i % 90}") for i in range(300)] + [(i, f"own {i}") for i in range(10, 200)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    key = {t: h for t, h in df.select("text", F.xxhash64("text")).distinct().collect()}
    order = [t for _, _, t in sorted((-(1 << 63) if i is None else i, key[t], t) for i, t in rows)]
    found = fp.with_next(df, buckets=buckets).collect()
    assert sorted((r["text"], r["next_text"]) for r in found) == sorted(zip(order, order[1:] + order[:1]))


def test_shared_ids_are_spread(spark):
    df = spark.range(4000).select(F.when(F.col("id") % 3 > 0, F.col("id")).alias("doc_id"), F.concat(F.lit("t"), F.col("id").cast("string")).alias("text"))
    plan = fp.with_next(df, buckets=64)
    assert plan.count() == 4000 and plan.select("text").distinct().count() == 4000 and plan.select("next_text").distinct().count() == 4000
