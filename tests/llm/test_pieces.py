"""Merge-dropout against a plain agenda that decides every candidate by its own hash."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from shelfwise.llm import pieces

STRIDE, MASK = 0x9E3779B97F4A7C15, (1 << 64) - 1


def occurrence(start, number):
    return pieces.scattered((start + number * STRIDE) & MASK)


def plain_agenda(coder, word, key):
    """Take the best candidate of all again and again."""
    symbols, gone = list(enumerate(word)), set()
    while True:
        pairs = [(coder.rank[a[1] + b[1]], a[0], i) for i, (a, b) in enumerate(zip(symbols, symbols[1:])) if a[1] + b[1] in coder.rank and (a, b) not in gone]
        if not pairs:
            break
        rank, place, i = min(pairs)
        if coder.skips(key, place, rank):
            gone.add((symbols[i], symbols[i + 1]))
        else:
            symbols[i : i + 2] = [(place, symbols[i][1] + symbols[i + 1][1])]
    return [x for _, s in symbols for x in ([coder.ids[s]] if s in coder.ids else [coder.of_byte[b] for b in s.encode()])]


def brute(coder, text, start):
    return [x for n, w in enumerate(coder.units.findall(" " + text), 1) for x in plain_agenda(coder, w, occurrence(start, n))] if text else []


@pytest.mark.parametrize("dropout", [0.1, 0.5, 1.0])
def test_every_candidate_has_its_own_hash(dropout):
    coder, rng = pieces.Pieces(dropout=dropout), np.random.default_rng(6)
    texts = ["".join(rng.choice(list("aabcdeeinorstéçTH   \n1,日"), rng.integers(1, 60))) for _ in range(300)]
    texts += ["", " ", "     two  spaces   ", "▁ of ▁▁ its own", "longword" * 40, "x" * 9 + " " + "representation" * 4, "a" * 64 + "b", "🙂🙂 é"]
    starts = [pieces.text_key(42, i, i % 3) for i in range(len(texts))]
    got = coder.encode_many(texts, starts)
    for text, start, ids in zip(texts, starts, got):
        assert ids.tolist() == brute(coder, text, start), text
        assert coder.decode(ids.tolist()) == text
    flat, counts = coder.encode_flat(texts, starts)
    assert [bytes(b).decode() for b in coder.decoded_bytes(flat, counts)] == texts


def test_without_dropout_as_the_library():
    import sentencepiece

    library, coder = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL), pieces.Pieces(dropout=0.0)
    for text in ("the same words", "      spaces\tand\nlines  ", "representation" * 30, "naïve façade, 日本語 🙂"):
        assert coder.encode(text) == library.encode(text)


def test_many_segmentations_of_one_sentence():
    coder, sentence = pieces.Pieces(), "understanding the representation of segmentations"
    found = [tuple(coder.encode(sentence, key)) for key in range(2000)]
    assert len(set(found)) > 500 and all(coder.decode(ids) == sentence for ids in set(found))
    assert len({tuple(coder.encode(sentence, 7, epoch)) for epoch in range(20)}) > 10
    inside = [coder.piece[i] for i in coder.encode("representation " * 400, 7)]
    assert "".join(inside).replace("▁", " ") == " " + "representation " * 400 and len(set(inside)) > 25


def test_skips_at_their_rate():
    for rate in (0.1, 0.3):
        coder = pieces.Pieces(dropout=rate)
        keys = pieces.scattered(np.arange(2_000_000, dtype=np.uint64))
        for place, rank in ((0, 5), (3, 5), (3, 20000)):
            drawn = coder._skipped(keys, np.full(len(keys), place), np.full(len(keys), rank))
            assert abs(drawn.mean() / rate - 1) < 0.01
            assert all(coder.skips(int(k), place, rank) == d for k, d in zip(keys[:500], drawn[:500]))
        # A word with one candidate: it stays apart at the rate.
        apart = np.mean([len(x) == 2 for x in coder.encode_many(["a"] * 100_000, [pieces.text_key(42, k) for k in range(100_000)])])
        assert abs(apart / rate - 1) < 0.03


def test_slices_and_portions_change_nothing(monkeypatch):
    coder, rng = pieces.Pieces(), np.random.default_rng(8)
    texts = [" ".join("".join(rng.choice(list("etaoinshr"), rng.integers(1, 12))) for _ in range(rng.integers(0, 60))) for _ in range(50)] + ["no-space" * 90]
    starts = [pieces.text_key(1, k) for k in range(len(texts))]
    whole = coder.encode_many(texts, starts)
    monkeypatch.setattr(pieces, "TOGETHER", 64)
    assert all((a == b).all() for a, b in zip(whole, coder.encode_many(texts, starts)))


def test_epochs_nulls_and_clashing_columns(spark):
    rows = [(1, "some words to cut", 0), (1, "some words to cut", 1), (1, "some words to cut", None), (None, None, 1), (None, "", 2), (2, "x", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, epoch int").withColumn("pieces", F.lit("clash")).withColumn("proof", F.lit(1))
    docs = docs.unionByName(docs.limit(0))
    out = pieces.encode_documents(docs, epoch_col="epoch", proof="proof").collect()
    by = {(r["doc_id"], r["text"], r["epoch"]): r for r in out}
    assert len(out) == len(rows) and by[1, "some words to cut", 0]["pieces"] == by[1, "some words to cut", None]["pieces"]
    assert by[None, None, 1]["pieces"] is None and by[None, None, 1]["proof"] is None and by[None, "", 2]["pieces"] == []
    back = pieces.decode_documents(pieces.encode_documents(docs, epoch_col="epoch"), out="back")
    assert back.where(~F.col("back").eqNullSafe(F.col("text"))).count() == 0
