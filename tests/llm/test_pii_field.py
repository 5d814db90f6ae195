"""The random field on sentences that it was not trained on, its gradient, and the digest of the query."""

import hashlib
import re
from itertools import product

import numpy as np
import pytest

from shelfwise.llm import pii

# Held out: no sentence, digit or word of these is in the table of the operator.
HELD_OUT = {
    "phone": "if it rains call {} instead | leave a message on {} | her phone is {} | urgent: ring {} tonight | mobile number {} | fax it over to {} | you can reach him on {}",
    "card": "they billed my card {} twice | use the visa {} for this | card number {} was declined | I paid by credit card {} there",
    "email": "please send the form to {} | email me at {} | you may contact {} about it | write {} with questions",
    "ip": "the server at {} timed out | traffic from {} was dropped | connect to host {} again",
}
PLAIN = """
    the war of 1### ended in 1### with ##,### dead | release #.#.## came out on ##.##.20## | see pages ###-### and ## | order no. ############ shipped on 20##-##-##
    a ratio of #.## to #.# in ## cases | he won #-# and #-# in 20## | token ##af##be##cd was revoked | it sold #,###,### copies for $##.## | meet at ##:## in room ###
    chapter ## has ## pages | the ##th of May 19## | item ####-## costs ##.## | id=########## is in use | isbn 978-#-###-#####-# again
"""


def spans_of(words, labels):
    """(first word, last word, kind) of the runs of one kind."""
    out, i = set(), 0
    while i < len(words):
        j = i
        while j < len(words) and labels[j] == labels[i]:
            j += 1
        if labels[i]:
            out.add((i, j, int(labels[i])))
        i = j
    return out


def found_in(words, model):
    text = " ".join(words)
    starts = np.cumsum([0] + [len(w) + 1 for w in words])
    got = set()
    for a, kind, b in pii.added_spans([text], [[]], model)[0]:
        got.add((int(np.searchsorted(starts, a, side="right")) - 1, int(np.searchsorted(starts, b, side="left")), kind + 1))
    return got


def test_precision_and_recall_on_held_out_sentences():
    model = pii.train()
    rows = pii.labelled_table(HELD_OUT, pii.VALUES, PLAIN, made=30, seed=99)
    right = added = there = 0
    for words, labels in rows:
        want, got = spans_of(words, labels), found_in(words, model)
        right, added, there = right + len(want & got), added + len(got), there + len(want)
    assert len(rows) > 800 and right / added > 0.97 and right / there > 0.97, (right / added, right / there)


@pytest.mark.parametrize("end", ["", ".", ",", "!", "?", ";", ")", '"', "..."])
def test_signs_behind_a_number(end):
    model = pii.train()
    for text, kind, span in ((f"call 555-555-0142{end}", "phone", (5, 17)), (f"my card 4111.1111.1111.1111{end} is", "card", (8, 27)), (f"write to ann@localhost{end} now", "email", (9, 22))):
        assert pii.joined(pii.added_spans([text], [[]], model)[0]) == f"{kind}:{span[0]}:{span[1]}", text


def test_length_changes_nothing():
    model = pii.train()
    for n in (3, 255, 300, 5000):
        text = "my card 4111.1111.1111.1111" + "." * n
        assert pii.added_spans([text], [[]], model)[0] == [(8, 2, 27)]
    assert pii.shape("a" * 70 + "1") == pii.shape("a" * 7000 + "1") != pii.shape("a" * 70)
    assert pii.added_spans(["9" * 100_000 + " " + "+" * 100_000], [[]], model)[0] == []


def test_gradient_against_all_paths():
    rng = np.random.default_rng(3)
    field = pii.ConditionalRandomField(labels=3, l2=0.0)
    seqs = [([[0, 2], [1], [3, 1]], [1, 0, 2]), ([[3], [2, 0], [1]], [0, 0, 1])]
    field.emit, field.move = rng.standard_normal((4, 3)), rng.standard_normal((3, 3))

    def likelihood():
        total = 0.0
        for ids, ys in seqs:
            score = lambda y: sum(field.emit[i][:, k].sum() for i, k in zip(ids, y)) + sum(field.move[a, b] for a, b in zip((0, *y), (*y, 0)))
            total += score(ys) - np.log(sum(np.exp(score(y)) for y in product(range(3), repeat=3)))
        return total

    flat = [x for ids, _ in seqs for x in ids]
    counts = np.array([len(x) for x in flat])
    ge, gm = np.zeros((4, 3)), np.zeros((3, 3))
    field._gradient(np.concatenate([np.array(x) for x in flat]), counts, np.cumsum(counts) - counts, np.eye(3)[np.array([y for _, y in seqs])], 3, ge, gm)
    for grad, weights in ((ge, field.emit), (gm, field.move)):
        for at in np.ndindex(weights.shape):
            weights[at] += 1e-5
            up = likelihood()
            weights[at] -= 2e-5
            assert grad[at] == pytest.approx((up - likelihood()) / 2e-5, abs=1e-5)
            weights[at] += 1e-5


def test_query_digest_and_counts(spark, sf_dir):
    from shelfwise.llm.common import table

    patterns = [r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]"]
    texts = {r["doc_id"]: r["text"] or "" for r in table(spark, sf_dir, "documents").collect()}
    rows = pii.query(spark, sf_dir).collect()
    assert len(rows) == len(texts)
    for r in rows:
        found = []
        for k, p in enumerate(patterns):
            for m in re.finditer(p, texts[r["doc_id"]]):
                n = re.sub(r"[^0-9]", "", m.group())
                if k == 0 or k == 1 and all(int(x) <= 255 for x in m.group().split(".")) or k == 2 and 12 <= len(n) <= 19 and pii.luhn(n) or k == 3 and 9 <= len(n) <= 15:
                    found.append((m.start(), k, m.end()))
        base = [f"{pii.KINDS[k]}:{a}:{b}" for a, k, b in sorted(found)]
        assert r["base_sha256"] == hashlib.sha256(",".join(base).encode()).hexdigest()
        assert [r[f"n_{kind}"] for kind in pii.KINDS] == [sum(k == i for _, k, _ in found) for i in range(4)]
        spans = r["spans"].split(",") if r["spans"] else []
        assert set(base) <= set(spans) and spans == sorted(spans, key=lambda s: (int(s.split(":")[1]), pii.KINDS.index(s.split(":")[0]), int(s.split(":")[2])))
