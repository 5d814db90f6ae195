"""Folded bases of the rollup against SQL over the same changes, and what counts as a copy."""

import random

import duckdb
from pyspark.sql import functions as F

from shelfwise.llm import rollups

CHANGES = "batch string, op string, source string, lang string, old_version string, old_tokens long, tokenizer_version string, tokens long"


def made(seed, n=400):
    rng = random.Random(seed)
    maybe = lambda *xs: rng.choice([*xs, None])
    return [(f"b{rng.randrange(12):02d}", rng.choice(["insert", "delete", "revise", "other"]), maybe("s", "t"), maybe("en"), rng.choice("vw"), maybe(3, 50), rng.choice("vw"), maybe(7, 10**12)) for _ in range(n)]


def by_sql(spark, rows):
    con = duckdb.connect()
    con.register("c", spark.createDataFrame(rows, CHANGES).toPandas())
    return sorted(
        con.sql("""
            SELECT source, lang, version, sum(n)::BIGINT AS docs, sum(n * t)::BIGINT AS tokens FROM (
              SELECT source, lang, tokenizer_version AS version, 1 AS n, coalesce(tokens, 0)::BIGINT AS t FROM c WHERE op IN ('insert', 'revise')
              UNION ALL SELECT source, lang, old_version, -1, coalesce(old_tokens, 0)::BIGINT FROM c WHERE op IN ('delete', 'revise'))
            GROUP BY ALL HAVING docs <> 0 OR tokens <> 0
        """).fetchall(),
        key=repr,
    )


def test_folding_changes_nothing(spark, tmp_path):
    rows, table = made(1), rollups.RollupTable(spark, f"{tmp_path}/r")
    assert not table.fold() and table.totals().count() == 0
    df = spark.createDataFrame(rows, CHANGES)
    names = sorted({r[0] for r in rows})
    for i, name in enumerate(names):
        own = df.where(F.col("batch") == name)
        assert table.commit(name, own) and not table.commit(name, own)
        if i % 4 == 3:
            assert table.fold() and not table.fold()
            assert not table.commit(name, own) and not table.commit(names[0], own)
        got = sorted((tuple(r) for r in table.totals().collect()), key=repr)
        assert got == by_sql(spark, [r for r in rows if r[0] <= name]), name
    # The folders of batches that the base before the last held are gone; a folder that comes back under a folded id counts nothing.
    assert table.batches() == names[8:] and table.base().endswith("2")
    rollups.deltas(df.where(F.col("batch") == names[0])).write.parquet(f"{tmp_path}/r/batch={names[0]}")
    assert sorted((tuple(r) for r in table.totals().collect()), key=repr) == by_sql(spark, rows)


def test_two_folders_at_once(spark, tmp_path, monkeypatch):
    rows = spark.createDataFrame([("b", "insert", "s", "en", None, 0, "v", 5)], CHANGES)
    one, two = (rollups.RollupTable(spark, f"{tmp_path}/r") for _ in range(2))
    one.commit("b", rows)
    whole = two._sum
    monkeypatch.setattr(two, "_sum", lambda base, new: (one.fold(), whole(base, new))[1])
    assert not two.fold() and [tuple(r) for r in one.totals().collect()] == [("s", "en", "v", 1, 5)]


def test_copies_of_null_and_repeated_ids(spark):
    docs = spark.createDataFrame([(1, "x"), (2, "x"), (2, "x"), (None, "x"), (3, "y"), (3, "y"), (None, "z"), (None, "z")], "doc_id long, digest string")
    assert sorted((r["doc_id"], r["digest"]) for r in rollups.copies(docs).collect()) == [(2, "x"), (2, "x")]
