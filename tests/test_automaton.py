"""The automaton gives what a chain of contains gives, and takes no longer for more words."""

import random
import time

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from shelfwise.functions import automaton as M
from shelfwise.functions import rules as R
from shelfwise.operators import extract as E


def brute(words, text):
    return next((i for i, w in enumerate(words) if text is not None and w in text), len(words))


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text("abß𝒳", min_size=1, max_size=5), max_size=12), st.lists(st.one_of(st.none(), st.text("abcß𝒳 ", max_size=40)), max_size=8))
def test_equals_contains(words, texts):
    assert M.Automaton(tuple(words)).first(texts).tolist() == [brute(words, t) for t in texts]


def test_words_across_stretches():
    rng = random.Random(1)
    words = ["needle" * 3, "x" * 40, "ab"]
    texts = []
    for cut in range(M.STRETCH - 45, M.STRETCH + 3):
        texts += ["-" * cut + w + "-" * rng.randrange(2000) for w in words]
    assert M.Automaton(tuple(words)).first(texts).tolist() == [brute(words, t) for t in texts]
    assert M.Automaton(("",)).first(["a", ""]).tolist() == [0, 0]


def test_blocks_of_long_texts(monkeypatch):
    monkeypatch.setattr(M, "BLOCK", 700)
    rng = random.Random(5)
    words = ("abcabc", "cba" * 10, "bb")
    texts = ["".join(rng.choice("abc" if rng.random() < 0.2 else "ac") for _ in range(rng.choice([0, 5, 699, 700, 701, 5000]))) for _ in range(60)]
    texts += ["-" * cut + "cba" * 10 + "-" * 900 for cut in range(665, 705)] + [None]
    assert M.Automaton(words).first(texts).tolist() == [brute(words, t) for t in texts]


def test_equals_case_for_all_rules(spark):
    rng = random.Random(2)
    words = [w for w, _ in R.SPEC_KEY_RULES + R.COMPONENT_TITLE_RULES]
    texts = [None, "", *["".join(rng.choice([rng.choice(words), rng.choice(words)[:4], " ", "é", "Zz"]) for _ in range(rng.randrange(6))) for _ in range(3000)]]
    df = spark.createDataFrame([(t,) for t in texts], "x string").repartition(4)
    for rules in (R.SPEC_KEY_RULES, R.COMPONENT_TITLE_RULES, sorted(R.SPEC_KEY_RULES, key=lambda r: -len(r[0]))):
        for default in (None, "none"):
            got = df.select(R.first_rule(F.col("x"), rules, default).alias("a"), M.first_word(F.col("x"), rules, default).alias("b"))
            assert got.where(~F.col("a").eqNullSafe(F.col("b"))).count() == 0


def test_many_rules_take_the_automaton(spark):
    rules = [(f"word{i:04d}", f"v{i}") for i in range(6000)]
    df = spark.createDataFrame([("Xword5999: word-0007",), ("word-4321",), (None,), ("word 0007",)], "x string")
    assert [r[0] for r in df.select(R.first_rule(F.col("x"), rules)).collect()] == ["v5999", None, None, None]
    assert [r[0] for r in df.select(E.map_key(F.col("x"), [*rules, ("word 4321", "spaced")], longest_match=True)).collect()] == ["v5999", "spaced", None, None]


def test_time_does_not_follow_the_number_of_words():
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(15))
    texts = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(200)) for _ in range(5000)]
    spent = {}
    for n in (60, 6000):
        made = M.Automaton(tuple(word() for _ in range(n)))
        spent[n] = []
        for _ in range(3):
            began = time.process_time()
            made.first(texts)
            spent[n].append(time.process_time() - began)
    assert min(spent[6000]) < 5 * min(spent[60])  # a hundred times as many words


def test_only_slices_of_a_batch_become_strings(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(M, "BLOCK", 100)
    texts = [None, "", "é" * 30, "x" * 450, None, *["ab" * i for i in range(40)], ""]
    parts = [p.to_pylist() for p in M.slices(pa.array(texts, pa.string()))]
    assert [t for p in parts for t in p] == texts
    assert max(sum(len((t or "").encode()) for t in p[1:]) for p in parts) < 100 and len(parts) > 10
    assert list(M.slices(pa.array([], pa.string()))) == []
