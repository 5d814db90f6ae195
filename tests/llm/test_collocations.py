"""Collocations against counting and scoring in plain Python, and the index of a shard against the text."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from shelfwise.llm import collocations as C


def occurrences(ids, gram):
    return [i for i in range(len(ids) - len(gram) + 1) if list(ids[i : i + len(gram)]) == list(gram)]


@pytest.mark.parametrize("seed", range(8))
def test_index_extends_both_ways(seed):
    rng = random.Random(seed)
    ids = np.array([rng.randrange(5) for _ in range(rng.randint(1, 200))])
    index = C.FMIndex(ids, 3)
    for w in range(1, int(ids.max()) + 1):
        lo, hi = index.starts[w], index.starts[w + 1]
        assert hi - lo == len(occurrences(ids, [w]))
        sizes = lambda found: {k: b - a for k, (a, b) in found.items()}
        assert sizes(index.left(lo, hi)) == {v: n for v in range(1, 5) if (n := len(occurrences(ids, [v, w])))}
        for v, (a, b) in index.right(lo, hi, 1).items():
            assert b - a == len(occurrences(ids, [w, v]))
            assert sizes(index.left(a, b)) == {u: n for u in range(1, 5) if (n := len(occurrences(ids, [u, w, v])))}
            assert sizes(index.right(a, b, 2)) == {u: n for u in range(1, 5) if (n := len(occurrences(ids, [w, v, u])))}
    want = Counter(tuple(ids[i : i + n].tolist()) for n in (1, 2, 3) for i in range(len(ids) - n + 1) if (ids[i : i + n] > 0).all())
    got = Counter()
    for grams, counts in index.grams(len(ids)):
        got.update({tuple(g): n for g, n in zip(grams.tolist(), counts.tolist())})
    assert got == want


def pieces_of(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return [re.findall(r"[^\x20\x09]+", p) for p in re.split(r"[.,;:!?\x0A-\x0D]", low)]


def by_definition(rows, max_words=3, min_count=10, top=2000):
    f, n = defaultdict(Counter), Counter()
    for lang, text in rows:
        for ws in pieces_of(text):
            n["und" if lang is None else lang] += len(ws)
            for k in range(1, max_words + 1):
                for i in range(len(ws) - k + 1):
                    f["und" if lang is None else lang][tuple(ws[i : i + k])] += 1
    out = []
    for lang, counts in f.items():
        often = {g: a for g, a in counts.items() if a >= min_count and len(g) > 1}
        left = []
        for g, a in often.items():
            score, k = min((10**6 * a * a // (counts[g[:k]] * counts[g[k:]]), k) for k in range(1, len(g)))
            longer = [b for h, b in often.items() if len(h) > len(g) and any(h[i : i + len(g)] == g for i in range(len(h)))]
            if not any(100 * b >= 50 * a for b in longer):
                left.append((-score, -a, " ".join(g).encode(), counts[g[:k]], counts[g[k:]]))
        out += [(lang, i + 1, p.decode(), -a, l, r, n[lang], -s) for i, (s, a, p, l, r) in enumerate(sorted(left)[:top])]
    return sorted(out)


def made(seed, n=400):
    rng = random.Random(seed)
    word = lambda: rng.choice(["the", "The", "of", "new", "york", "City", "é", "ÉA", "x\x00y", "b\xa0c", "d e"])
    sep = lambda: rng.choice([" ", " ", " ", "  ", "\t", ". ", ", ", "\n", "\x0b", "!?", "\x1c"])
    return [(rng.choice(["en", "fr", None, ""]), "".join(word() + sep() for _ in range(rng.randint(0, 60)))) for _ in range(n)]


@pytest.mark.parametrize(("max_words", "shard"), [(2, 1 << 21), (3, 7), (3, 1000), (4, 50)])
def test_against_definition(spark, monkeypatch, max_words, shard):
    monkeypatch.setattr(C, "BLOCK_BYTES", 40)
    rows = [*made(max_words), ("en", None), ("en", ""), ("fr", "one two three " * 40), ("fr", "one two three " * 40), (None, " . , ")]
    df = spark.createDataFrame(rows, "lang string, text string").withColumns({"a": F.lit("clash"), "phrase": F.lit(1), "w": F.lit(2)})
    got = sorted(tuple(r) for r in C.collocations(df, max_words=max_words, shard_words=shard, top=30).collect())
    assert got == by_definition(rows, max_words, top=30) and len(got) > 40


def test_texts_in_blocks_and_shards():
    """Blocks and shards of any size give the same counts."""
    text = " ".join(random.Random(1).choice(["a", "b", "c.", "d,e", "f"]) for _ in range(400)).encode()

    def counts(block, size):
        C.BLOCK_BYTES, kept = block, C.BLOCK_BYTES
        try:
            shards, out = C.Shards(3, size), Counter()
            for lang in ("x", "y", "x"):
                for b in [*shards.add(lang, text)]:
                    out.update({(x, p): n for x, p, n in zip(*[c.to_pylist() for c in b.columns])})
            for b in shards.flush():
                for x, p, n in zip(*[c.to_pylist() for c in b.columns]):
                    out[x, p] += n
            return out
        finally:
            C.BLOCK_BYTES = kept

    whole = counts(1 << 20, 1 << 20)
    assert whole["x", ""] == 2 * whole["y", ""] > 0
    assert all(counts(1 << 20, size) == whole for size in (1, 2, 3, 10, 500))
    for block in (1, 10, 100):
        got = counts(block, 1 << 20)
        assert got == whole


def test_filter_has_no_false_negatives(spark, monkeypatch):
    rows = [(f"l{i % 3}", f"w{i} v{i * 7 % 11}") for i in range(500)]
    df = spark.createDataFrame(rows, "lang string, phrase string").repartition(5)
    for block, bits in ((1 << 13, 1 << 16), (16, 1 << 12), (64, 1 << 8)):
        monkeypatch.setattr(C, "FILTER_BLOCK", block)
        made_bits = C.phrase_filter(df, bits)
        test = lambda lang, phrase: bool(C.in_filter(C.gram_keys(lang, np.array([[C.xxhash.xxh64_intdigest(w) for w in phrase.split(" ")]], np.uint64)), made_bits)[0])  # noqa: B023, E731
        assert all(test(*r) for r in rows)
    monkeypatch.setattr(C, "FILTER_BLOCK", 1 << 13)
    made_bits = C.phrase_filter(df, 1 << 16)
    assert sum(test(f"l{(i + 1) % 3}", f"w{i} v{i * 7 % 11}") for i in range(500)) < 20


def test_full_filter_changes_nothing(spark, monkeypatch):
    rows = made(9)
    df = spark.createDataFrame(rows, "lang string, text string")
    monkeypatch.setattr(C, "FILTER_BITS", 1 << 4)
    assert sorted(tuple(r) for r in C.collocations(df, top=30).collect()) == by_definition(rows, top=30)


def test_tournament(spark):
    df = spark.range(5000).select(F.when(F.col("id") % 10 < 7, "a").otherwise("b").alias("g"), (F.col("id") * 7919 % 5003).alias("v"))
    want = {g: sorted((r["v"] for r in df.collect() if r["g"] == g), reverse=True)[:20] for g in "ab"}
    got = C.best_of_each(df, "g", [F.desc("v")], 20, 5000, part_rows=50).collect()
    assert {g: [r["v"] for r in sorted(got, key=lambda r: r["rank"]) if r["g"] == g] for g in "ab"} == want


def test_exact_scores(spark, monkeypatch):
    """Counts whose products pass 64 bits."""
    rows = [("en", "", 10**15), ("en", "a", 10**12 + 7), ("en", "b", 10**12 + 9), ("en", "a b", 10**12 - 1), ("en", "c", 10**12), ("en", "c b", 10)]
    monkeypatch.setattr(C, "ngram_counts", lambda *a, **b: spark.createDataFrame(rows, "lang string, phrase string, f long"))
    got = {r["phrase"]: r["score"] for r in C.collocations(None).collect()}
    assert got == {"a b": 10**6 * (10**12 - 1) ** 2 // ((10**12 + 7) * (10**12 + 9)), "c b": 0}


def test_empty_table(spark):
    df = spark.createDataFrame([], "lang string, text string")
    assert C.collocations(df).collect() == []
