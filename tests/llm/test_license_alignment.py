"""License scans against alignment without index or band."""

import random

import pytest

from shelfwise.llm import licenses

INDEX = licenses.TemplateIndex(licenses.TEMPLATES)


def common(a, b):
    """Length of the longest common subsequence of two word lists."""
    row = [0] * (len(b) + 1)
    for x in a:
        last = row
        row = [0]
        for j, y in enumerate(b):
            row.append(last[j] + 1 if x == y else max(row[j], last[j + 1]))
    return row[-1]


def test_alignment_against_the_whole_table():
    rng = random.Random(2)
    for _ in range(400):
        a, b = ([rng.choice("abcdef") for _ in range(rng.randint(1, 14))] for _ in range(2))
        matched, first, last = licenses.align(a, b, 0, 40)
        assert matched == common(a, b), (a, b)
        if matched:
            assert a[first] in b and a[last] in b and matched == common(a[first : last + 1], b)


def changed(words, n, rng, kind):
    """The words with n of them replaced, left out, or followed by another."""
    out = list(words)
    for i in sorted(rng.sample(range(1, len(words) - 1), n), reverse=True):
        out[i : i + 1] = {"replace": ["zzz"], "drop": [], "insert": [out[i], "zzz"]}[kind]
    return out


@pytest.mark.parametrize("kind", ["replace", "drop", "insert"])
@pytest.mark.parametrize("name", sorted(licenses.TEMPLATES))
def test_changed_texts_are_found(name, kind):
    rng, template = random.Random(f"{name}{kind}"), licenses.words(licenses.TEMPLATES[name])
    for share in (0, 0.05, 0.1, 0.19):
        n = min(int(share * len(template)), len(template) - 2)
        n = min(n, licenses.BAND) if kind == "insert" else n
        body = changed(template, n, rng, kind)
        filler = lambda: [rng.choice(["of", "the", "qq", "software", "license", "rr"]) for _ in range(rng.randint(0, 30))]  # noqa: B023, E731
        before, after = filler(), filler()
        text = " ".join([*before, "qqq", *body, "rrr", *after])
        start = len(" ".join([*before, "qqq", ""]))
        got = [m for m in licenses.scan(text, INDEX) if m[2] < start + len(" ".join(body)) and m[3] > start]
        # Every word of the text belongs to some template that covers as much as this one does.
        assert got, (name, kind, n)
        best = max(got, key=lambda m: m[3] - m[2])
        assert common(licenses.words(text[best[2] : best[3]]), INDEX.words[INDEX.names.index(best[0])]) == round(best[1] * len(INDEX.words[INDEX.names.index(best[0])]))
        if n == 0:
            assert best[0] == name or INDEX.words[INDEX.names.index(best[0])][: len(template)] == template, (name, best)
            assert best[1] == 1.0 and (best[2], best[3]) == (start, start + len(" ".join(body)))


def test_overlaps_and_ties():
    mit, grant = licenses.TEMPLATES["MIT-text"], licenses.TEMPLATES["MIT-grant"]
    assert [m[0] for m in licenses.scan(mit, INDEX)] == ["MIT-text"]
    assert [m[0] for m in licenses.scan(grant, INDEX)] == ["MIT-grant"]
    tie = licenses.TemplateIndex({"b": "one two three four five", "a": "one two three four five"})
    assert [m[0] for m in licenses.scan("so one two three four five", tie)] == ["a"]
    both = licenses.TemplateIndex({"x": "one two three four five six", "y": "four five six seven eight nine ten"})
    assert licenses.scan("one two three four five six seven eight nine ten", both) == [("y", 1.0, 14, 48)]
    assert licenses.scan("İ " + "Released under the MIT LİCENSE. " + "Released under the MIT License", INDEX)[-1][0] == "MIT"


def test_ordinary_words_match_nothing():
    rng = random.Random(3)
    vocabulary = sorted(INDEX.vocabulary)
    for _ in range(20):
        assert licenses.scan(" ".join(rng.choice(vocabulary) for _ in range(2000)), INDEX) == []
