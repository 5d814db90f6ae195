"""Repeated short notices, and changed words of them."""

import random
import time

from shelfwise.llm import licenses


def found(text):
    return [(name, text[a:b]) for name, _, a, b in licenses.scan(text, licenses.TemplateIndex(licenses.TEMPLATES))]


def test_notices_in_consecutive_lines():
    for name in ("MIT", "CC-BY-NC-4.0", "Apache-2.0", "GPL-3.0", "BSD"):
        notice = licenses.TEMPLATES[name]
        for n in (1, 3, 40):
            got = found("\n".join([notice] * n))
            assert got == [(name, notice.rstrip("."))] * n, (name, n, len(got))
    assert len(found(("Released under the MIT License.\n") * 1000)) == 1000


def test_one_word_of_five_replaced():
    words = licenses.TEMPLATES["MIT"].rstrip(".").split()
    for i in range(5):
        text = " ".join([*words[:i], "quux", *words[i + 1 :]])
        assert [name for name, _ in found(f"see here {text} and more")] == ["MIT"], text


def test_bridging_match_ends():
    assert found("Released under Released under the MIT License the MIT License")[0][0] == "MIT"


def test_a_megabyte_of_license_texts():
    """Every text of a long bundle of licenses is found, in time for one task."""
    texts = list(licenses.TEXTS.values())
    bundle = "\n\n".join(texts * (1 + 1_000_000 // sum(map(len, texts))))
    began = time.process_time()
    found = licenses.scan(bundle, licenses.TemplateIndex(licenses.TEMPLATES))
    assert time.process_time() - began < 60 and len(bundle) > 1_000_000
    assert [m[0] for m in found] == list(licenses.TEXTS) * (len(found) // len(texts)) and len(found) % len(texts) == 0 and all(m[1] == 1.0 for m in found)


def test_shortest_of_the_best_alignments():
    """Of the stretches that match most words, the shortest, against all of them."""
    rng = random.Random(6)

    def common(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            last, row = row, [0]
            for j, y in enumerate(b):
                row.append(last[j] + 1 if x == y else max(row[j], last[j + 1]))
        return row[-1]

    for _ in range(300):
        a, b = ([rng.choice("abcd") for _ in range(rng.randint(1, 12))] for _ in range(2))
        spans = [(-common(a[i:j], b), j - i, i) for i in range(len(a)) for j in range(i + 1, len(a) + 1)]
        most, size, _ = min(spans)
        matched, first, last = licenses.align(a, b, 0, 30)
        assert matched == -most and (not matched or last + 1 - first == size), (a, b)
