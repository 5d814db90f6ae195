"""The pipeline's stages on a small table."""

import corpus_pipeline as P
from shelfwise.llm.common import table


def test_pipeline_runs_all_stages(spark, sf_dir):
    docs, seen = table(spark, sf_dir, "documents").select(*P.COLUMNS), []
    n = docs.count()
    for i, (name, stage) in enumerate(P.STAGES):
        out = stage(spark, docs, sf_dir).persist()
        if i < len(P.STAGES) - 1:
            assert out.columns == P.COLUMNS
        seen.append((name, out.count()))
        docs = out
    counts = dict(seen)
    assert counts["quality"] < n and counts["near_dedup"] <= counts["quality"] and counts["pii"] == counts["near_dedup"]
    assert counts["pieces"] == counts["mixing"] > 0
    assert docs.where("not lossless").count() == 0


def test_registry_names():
    from shelfwise.llm import registry

    names = list(registry.queries())
    assert [n.split("_")[0] for n in names] == [*(f"op{i}" for i in range(1, 14)), "pipeline"]
    assert set(registry.oracle_sql()) <= set(names)


ODD = [
    (None, None, None, None, None),
    (None, "a text without an id that is long enough to be kept here", "en", "s", 1),
    (1, "", "en", None, 0),
    (2, "short", None, "s", 5),
    (3, "word " * 30000, "en", "s", 1),
    (4, "the same words stand in two documents of this table", "en", "s", 1),
    (5, "the same words stand in two documents of this table", "en", "t", 1),
    (6, "a row that is there twice", "en", "t", 1),
    (6, "a row that is there twice", "en", "t", 1),
]


def test_stages_on_odd_rows(spark, sf_dir):
    docs = spark.createDataFrame(ODD, "doc_id long, text string, lang string, source string, n_chars long")
    for name, stage in P.STAGES:
        for odd in (docs, docs.limit(0), docs.selectExpr("*", "doc_id AS id", "text AS fp", "1 AS _id", "2 AS size", "3 AS score")):
            rows = stage(spark, odd, sf_dir).collect()
            if name == "near_dedup" and rows:
                ids = [r["doc_id"] for r in rows]
                assert ids.count(6) == 1 and 5 not in ids and 4 in ids
            if name == "pii" and rows:
                assert len(rows) == len(ODD)
            if name == "pieces":
                assert all(r["lossless"] for r in rows)
