"""Periodic runs against their definition, word by word."""

import hashlib
import random
import zlib
from itertools import product

import numpy as np
import pytest

from shelfwise.llm import runs
from shelfwise.llm import words as W
from shelfwise.llm.common import table


def runs_by_definition(words, min_words):
    """(start, length, period): maximal stretches by every period, without those that a smaller period explains."""
    n, found = len(words), []
    for q in range(1, n):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j - i >= q and not any(s <= i and s + m >= j + q for s, m, _ in found):
                found.append((i, j + q - i, q))
            i = max(j, i + 1)
    return sorted(((s, m, q) for s, m, q in found if m >= min_words), key=lambda r: (r[0], r[2]))


def found(texts, min_words):
    parts = [t.split() for t in texts]
    ids, owner = W.numbered(parts)
    start, length, period = runs.find_runs(ids, owner, min_words)
    begins = np.cumsum([0] + [len(p) for p in parts])
    out = [[] for _ in texts]
    for s, m, q in zip(start.tolist(), length.tolist(), period.tolist()):
        out[owner[s]].append((s - int(begins[owner[s]]), m, q))
    return out


@pytest.mark.parametrize(("letters", "most"), [("ab", 11), ("abc", 7)])
def test_all_short_texts(letters, most):
    texts = [" ".join(t) for n in range(1, most + 1) for t in product(letters, repeat=n)]
    got = found([t.encode() for t in texts], 1)
    for text, own in zip(texts, got):
        assert own == runs_by_definition(text.split(), 1), text


def repeating(rng):
    """A text of words that repeat with several periods, some inside others."""
    words = [rng.choice("abcdef"[: rng.randint(1, 6)]) for _ in range(rng.randint(0, 12))]
    for _ in range(rng.randint(0, 5)):
        a = rng.randint(0, len(words))
        piece = words[a : a + rng.randint(1, 40)] * rng.randint(1, 6)
        words[a:a] = piece[: rng.randint(0, 90)]
    return words


def test_random_texts_many_in_a_slice():
    rng = random.Random(4)
    texts = [repeating(rng) for _ in range(400)]
    for own, words in zip(found([" ".join(t).encode() for t in texts], 12), texts):
        assert own == runs_by_definition(words, 12), words


def test_long_periods():
    rng = random.Random(5)
    for q in (63, 64, 65, 500, 1023, 1024, 1500):
        unit = [f"w{rng.randrange(10**9)}" for _ in range(q)]
        words = ["x", *unit, *unit, *unit[: q // 3], "y"]
        assert found([" ".join(words).encode()], 12) == [[(1, 2 * q + q // 3, q)]]
    assert found([b"a " * 100_000, b"a " * 11], 12) == [[(0, 100_000, 1)], []]
    # Copies in other texts are no repetitions, nor are stretches across two texts.
    assert found([b"a b c d e f g a b c d e f", b"g a b c d e f g"], 12) == [[], []]


def test_collapsed_text():
    text = b"start " + b"p q r " * 5 + b"p end\tend " + b"end " * 20 + b"\n z"
    (n, own, collapsed), = runs.runs_of([text])
    assert n == 1 + 16 + 22 + 1 and own == [(1, 16, 3), (17, 22, 1)]
    assert collapsed == b"start p q r end z"
    assert list(runs.runs_of([])) == [] and list(runs.runs_of([b"", b" \n "])) == [(0, [], b""), (0, [], b"")]


def edited(doc_id, words):
    h = zlib.crc32(str(doc_id).encode())
    n, g = len(words), h // 10
    if h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]


def test_query(spark, sf_dir):
    rows = {r["doc_id"]: r for r in runs.query(spark, sf_dir).collect()}
    texts = {r["doc_id"]: r["text"] for r in table(spark, sf_dir, "documents").collect()}
    assert set(rows) == set(texts) and sum(r["n_runs"] > 0 for r in rows.values()) > 10
    for doc_id, text in texts.items():
        words, r = edited(doc_id, text.encode().split()), rows[doc_id]
        want = runs_by_definition(words, 12) if len(words) < 900 else None
        if want is None:
            continue
        gone = {i for s, m, q in want for i in range(s + q, s + m)}
        best = max(want, key=lambda x: (x[1], -x[0], -x[2]), default=(None, None, None))
        assert (r["n_runs"], r["start"], r["length"], r["period"]) == (len(want), *best)
        assert r["exponent_milli"] == (best[1] * 1000 // best[2] if want else None)
        assert r["runs_sha256"] == hashlib.sha256("".join(f"{s},{m},{q}\n" for s, m, q in want).encode()).hexdigest()
        assert r["collapsed_sha256"] == hashlib.sha256(b" ".join(w for i, w in enumerate(words) if i not in gone)).hexdigest()


def test_odd_rows(spark):
    rows = [(None, None, "x"), (1, "", "x"), (2, None, "x"), (2, "a " * 30, "x"), (2, "a " * 30, "x"), (3, "ü ü ü " * 9, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, runs string")
    got = sorted((r["id"] or 0, r["n_words"], [tuple(x) for x in r["runs"]], r["collapsed"]) for r in runs.find(df).collect())
    assert got == [(0, 0, [], ""), (1, 0, [], ""), (2, 0, [], ""), *[(2, 30, [(0, 30, 1)], "a")] * 2, (3, 18, [(0, 18, 2)], "ü ü ü")]
    assert runs.find(df.limit(0)).count() == 0
