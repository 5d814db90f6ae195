"""Shards against plain counting: sizes, checksums, slots, and groups of equal texts."""

import random
import zlib
from collections import Counter, defaultdict

import pytest

from shelfwise.llm import sharding

SCHEMA = "doc_id long, text string, size string, shard int"


def checked(rows, found, n_shards):
    """Records, sizes and slots are right; returns the bytes of each shard and the shards of each text."""
    texts = {i: t for i, t, _, _ in rows}
    want = Counter((i, len((t or "").encode()) * (t is not None) + 1, zlib.crc32((t or "").encode())) for i, t, _, _ in rows)
    assert Counter((r["id"], r["size"], r["text_crc32"]) for r in found) == want
    size, slots, groups = Counter(), defaultdict(list), defaultdict(set)
    for r in found:
        size[r["shard"]] += r["size"]
        slots[r["shard"]].append(r["slot"])
        groups[texts[r["id"]]].add(r["shard"])
    assert all(0 <= s < n_shards for s in slots) and all(sorted(x) == list(range(len(x))) for x in slots.values())
    return size, groups


def rows_of(texts):
    return [(i, t, "x", 3) for i, t in enumerate(texts)]


def test_groups_stay_whole_and_shards_are_near_equal(spark):
    rng = random.Random(4)
    texts = [f"{rng.getrandbits(64)} " * rng.randint(1, 40) for _ in range(6000)]
    for k, copies in enumerate((900, 400, 300, 200, 100, 50, 9, 2)):
        texts += [f"copied {k} " * 30] * copies
    texts += [None, None, "", "ü" * 2000, "long " * 9000]
    rows = rows_of(texts)
    size, groups = checked(rows, sharding.shard(spark.createDataFrame(rows, SCHEMA), n_shards=8).collect(), 8)
    assert all(len(x) == 1 for x in groups.values())
    assert len(size) == 8 and max(size.values()) < 1.03 * min(size.values())


def test_only_a_group_over_a_shard_is_dealt_out(spark):
    rng = random.Random(5)
    texts = [f"{rng.getrandbits(64)} " * 4 for _ in range(4000)] + ["hot " * 20] * 3000 + ["warm " * 16] * 300
    rows = rows_of(texts)
    found = sharding.shard(spark.createDataFrame(rows, SCHEMA), n_shards=8).collect()
    size, groups = checked(rows, found, 8)
    assert [k for k, x in groups.items() if len(x) > 1] == ["hot " * 20]
    assert max(size.values()) < 1.05 * min(size.values())
    assert sorted(map(str, found)) == sorted(map(str, sharding.shard(spark.createDataFrame(rows[::-1], SCHEMA), n_shards=8).collect()))


@pytest.mark.parametrize("texts", [[], ["one"], [None] * 50, ["same"] * 500, ["a", "b"] * 3])
def test_odd_tables(spark, texts):
    rows = rows_of(texts) + [(None, t, None, None) for t in texts[:3]]
    checked(rows, sharding.shard(spark.createDataFrame(rows, SCHEMA), n_shards=4).collect(), 4)


def test_many_empty_texts_are_numbered_in_parts(spark):
    rows = rows_of([None] * 9000 + [f"{i} text of some length " * 9 for i in range(2000)])
    found = sharding.shard(spark.createDataFrame(rows, SCHEMA), n_shards=4, ranges_per_shard=32).collect()
    size, groups = checked(rows, found, 4)
    assert all(len(x) == 1 for x in groups.values()) and max(size.values()) < 1.05 * min(size.values())
    parts = Counter((r["range"], r["cell"], r["part"]) for r in found)
    assert max(parts.values()) < 4 * len(rows) / (4 * 32)
