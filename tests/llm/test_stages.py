"""Each stage of the pipeline against plain Python over the same rows, odd ones among them."""

import hashlib
import math
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline as P
from shelfwise.llm import mixing, pieces, pii, quality, simhash
from shelfwise.llm.common import table

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
ODD = [
    (None, None, None, None, None),
    (None, "a text without an id that says something of its own here", "en", "src0", 1),
    (None, "another text without an id, about rivers and the towns on them", "en", None, 1),
    (900, "", "en", None, 0),
    (901, "word " * 3000, "en", "src1", 1),
    (902, "mail me at ann@localhost or call (555) 555-0199, not 10.0.0.1", "en", "src1", 61),
    (903, "one id stands for this text", "en", "src2", 1),
    (903, "and the same id for this one, which is not like it", "en", "src2", 1),
    (904, "a row that is there twice", "en", "src3", 1),
    (904, "a row that is there twice", "en", "src3", 1),
]


@pytest.fixture(scope="module")
def docs(spark, sf_dir):
    given = table(spark, sf_dir, "documents").select(*P.COLUMNS)
    return given.unionByName(spark.createDataFrame(ODD, SCHEMA)).withColumns({"size": F.lit("clash"), "fp": F.lit(1)}).persist()


@pytest.fixture(scope="module")
def rows(docs):
    return [tuple(r) for r in docs.select(*P.COLUMNS).collect()]


def result(stage, spark, docs, sf_dir):
    out = stage(spark, docs, sf_dir)
    return out.columns, [tuple(r) for r in out.collect()]


def test_quality_stage(spark, sf_dir, docs, rows):
    words, net = quality.train(docs, table(spark, sf_dir, "labels"))
    score = net.probability(quality.pooled([t for _, t, _, _, _ in rows], words))
    columns, got = result(P.quality_stage, spark, docs, sf_dir)
    assert columns == P.COLUMNS and Counter(got) == Counter(r for r, s in zip(rows, score) if s >= quality.THRESHOLD)
    assert 0 < len(got) < len(rows)


def test_near_dedup_stage(spark, sf_dir, docs, rows):
    fps = [simhash.simhash(t) for _, t, _, _, _ in rows]
    group = list(range(len(rows)))
    for i, a in enumerate(fps):
        for j in range(i):
            if (a ^ fps[j]).bit_count() <= 3:
                old, new = group[i], group[j]
                group = [new if g == old else g for g in group]
    columns, got = result(P.near_dedup_stage, spark, docs, sf_dir)
    least = defaultdict(lambda: (True, 0))
    for r, g in zip(rows, group):
        least[g] = min(least[g], (r[0] is None, r[0] or 0))
    kept = Counter(group[rows.index(r)] for r in got)
    assert columns == P.COLUMNS and set(kept) == set(group) and set(kept.values()) == {1}
    assert all((r[0] is None, r[0] or 0) == least[group[rows.index(r)]] for r in got)


def test_pii_stage(spark, sf_dir, docs, rows):
    columns, got = result(P.pii_stage, spark, docs, sf_dir)
    model, want = pii.train(), Counter()
    for i, t, lang, source, _ in rows:
        if t is None:
            want[i, None, lang, source, None] += 1
            continue
        spans = sorted(pii.base_spans(t) + pii.added_spans([t], [pii.base_spans(t)], model)[0])
        covered = [None] * len(t)
        for n, (a, k, b) in enumerate(spans):
            for at in range(a, b):
                covered[at] = covered[at] or (n, k)
        out, last, end = [], None, -1
        for at, c in enumerate(covered):
            if c is None:
                out.append(t[at])
            elif at > end:
                # The first of overlapping spans goes on to the furthest end.
                end = at
                while end + 1 < len(t) and covered[end + 1] is not None and any(a <= end < b - 1 or a <= end + 1 < b and a < end + 1 for a, _, b in spans):
                    end += 1
                out.append(f"<{pii.KINDS[c[1]]}>")
        text = "".join(out)
        want[i, text, lang, source, len(text)] += 1
    assert columns == P.COLUMNS and Counter(got) == want
    assert sum(r[1] is not None and "<" in r[1] for r in got) > 3


def test_mixing_stage(spark, sf_dir, docs, rows):
    def key(i, t):
        u = (int(hashlib.md5(f"{'null' if i is None else i}:42:{t or ''}".encode()).hexdigest()[:13], 16) + 0.5) / 2**52
        clean = re.sub(r"[#$%&*!|<>{}\[\]\\~^_=]", "", t or "")
        return -math.log(u) / (max(0.05, (len(clean) / len(t)) ** 4) if t else 0.05)

    sized = [(r, len(re.findall(r"[^\x20\x09-\x0D]+", r[1] or ""))) for r in rows]
    size, names = Counter(), sorted({r[3] for r in rows}, key=lambda s: (s is None, s or ""))
    for r, n in sized:
        size[r[3]] += n
    weight = {s: i % 3 + 1 for i, s in enumerate(names)}
    target, open_sources, left = {}, set(names), float(sum(size.values()))
    while open_sources:
        level = left / sum(weight[s] for s in open_sources)
        full = {s for s in open_sources if level * weight[s] > 3 * size[s]}
        for s in full or open_sources:
            target[s] = 3.0 * size[s] if full else level * weight[s]
        left -= sum(target[s] for s in full)
        open_sources = open_sources - full if full else set()
    want = Counter()
    for s in names:
        own = sorted((x for x in sized if x[0][3] == s), key=lambda x: (key(x[0][0], x[0][1]), x[0][0] is not None, x[0][0] or 0))
        epochs = min(3, int(target[s] // size[s])) if size[s] else 0
        budget, start = math.floor(target[s] + 0.5) - epochs * size[s], 0
        for r, n in own:
            taken = epochs * n + min(n, max(0, budget - start))
            want[r] += math.floor(taken / n + 0.5) if n else max(epochs, 1)
            start += n
    columns, got = result(P.mixing_stage, spark, docs, sf_dir)
    assert columns == P.COLUMNS and Counter(got) == +want
    assert mixing.MAX_EPOCHS == 3 and max(Counter(got).values()) >= 2


def test_pieces_stage(spark, sf_dir, docs, rows):
    some = docs.where("doc_id % 5 = 0 or doc_id >= 900 or doc_id is null").unionByName(docs.where("doc_id = 10"))
    ids = {r["doc_id"]: r["h"] for r in some.select("doc_id", F.xxhash64("doc_id").alias("h")).collect()}
    coder, want = pieces.Pieces(), Counter()
    for r, n in Counter(tuple(r) for r in some.select(*P.COLUMNS).collect()).items():
        for epoch in range(n):
            start = pieces.text_key(coder.seed, ids[r[0]] & ((1 << 64) - 1), epoch)
            words = coder.units.findall(" " + r[1]) if r[1] else []
            coded = [x for k, w in enumerate(words, 1) for x in coder.merge(w, pieces.scattered((start + k * 0x9E3779B97F4A7C15) & ((1 << 64) - 1)))]
            want[r[0], r[3], r[2], None if r[1] is None else tuple(coded), None if r[1] is None else len(coded), True] += 1
    out = P.pieces_stage(spark, some, sf_dir)
    assert Counter((r["doc_id"], r["source"], r["lang"], None if r["pieces"] is None else tuple(r["pieces"]), r["n_pieces"], r["lossless"]) for r in out.collect()) == want
    twice = [tuple(r["pieces"]) for r in out.where("doc_id = 10").collect()]
    assert len(twice) == 2 and len(set(twice)) == 2


def test_stages_on_an_empty_table(spark, sf_dir, docs):
    for _, stage in P.STAGES:
        assert stage(spark, docs.limit(0), sf_dir).count() == 0
