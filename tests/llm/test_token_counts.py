"""Rollups of piece counts against plain counting, and writers of one batch id."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

from shelfwise.llm import pieces, rollups
from shelfwise.llm.common import table


@pytest.fixture(scope="module")
def library():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)


def count(coder, text):
    return sum(len(coder.merge(w, 0)) for w in coder.units.findall(" " + text)) if text else 0


def test_counts_of_both_versions(spark, library, monkeypatch):
    monkeypatch.setattr(rollups, "REMEMBERED", 50)
    texts = [None, "", "  spaces   and\nlines\t", "representation " * 50, "naïve 日本 🙂 " + "x" * 200, " ".join(f"word{i}" for i in range(500))]
    rows = spark.createDataFrame([(t,) for t in texts], "text string").select("text", rollups.token_counts(F.col("text")).alias("n")).collect()
    few = pieces.Pieces(dropout=0.0, merges=rollups.VERSIONS["pieces-1"])
    assert len(rows) == len(texts) and max(few.rank.values()) < 8000
    for r in rows:
        assert r["n"]["pieces-2"] == (len(library.encode(r["text"])) if r["text"] else 0)
        assert r["n"]["pieces-1"] == count(few, r["text"]) >= r["n"]["pieces-2"]


def test_query_against_plain_counting(spark, sf_dir, library):
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "text").collect()
    first = {}
    for d in docs:
        first[d["text"] or ""] = min(first.get(d["text"] or "", d["doc_id"]), d["doc_id"])
    want, tokens = Counter(), Counter()
    for d in docs:
        if d["doc_id"] == first[d["text"] or ""]:
            want[d["source"], d["lang"]] += 1
            tokens[d["source"], d["lang"]] += len(library.encode(d["text"])) if d["text"] else 0
    got = rollups.query(spark, sf_dir).collect()
    assert {(r["source"], r["lang"]): (r["docs"], r["tokens"]) for r in got} == {k: (n, tokens[k]) for k, n in want.items()}
    assert {r["tokenizer_version"] for r in got} == {"pieces-2"}


def test_of_two_writers_one_succeeds(spark, tmp_path):
    class Late(rollups.RollupTable):
        """A writer that looked before the other one was done."""

        looked = False

        def committed(self, batch_id):
            seen, self.looked = self.looked, True
            return seen and super().committed(batch_id)

    changes = spark.createDataFrame([("insert", "a", "en", None, 0, "v", 5)], "op string, source string, lang string, old_version string, old_tokens long, tokenizer_version string, tokens long")
    one, late = rollups.RollupTable(spark, f"{tmp_path}/t"), Late(spark, f"{tmp_path}/t")
    assert one.commit("1", changes) and not late.commit("1", changes)
    assert [tuple(r) for r in one.totals().collect()] == [("a", "en", "v", 1, 5)] and one.batches() == ["1"]
    assert not [p for p in (tmp_path / "t").rglob("*") if "_staged" in p.name]


def test_copies_of_a_hot_text(spark):
    rows = [(i, "hot") for i in range(300)] + [(i, f"own {i}") for i in range(300, 500)] + [(7000, "own 301"), (None, "hot")]
    found = rollups.copies(spark.createDataFrame(rows, "doc_id long, digest string"))
    assert sorted(r["doc_id"] for r in found.collect()) == [*range(1, 300), 7000]
