"""Small tests of the ten operators against brute force, and their defined results in odd cases."""

import hashlib
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from shelfwise.llm import embeddings, fingerprints, licenses, mixing, pieces, pii, quality, rollups, sharding, simhash
from shelfwise.llm.common import connected_components

DOCS = "doc_id long, text string, lang string, source string, n_chars long, fp string, id long"
LONG = "word and more " * 4000


@pytest.fixture(scope="module")
def docs(spark):
    """Nulls, empty and very long texts, copies, near copies, repeated rows, and columns with clashing names."""
    base = " ".join(f"w{i}" for i in range(200))
    rows = [
        (1, "one line\nanother line\nthird", "en", "a", 28, "x", 7),
        (2, "", "en", "a", 0, None, None),
        (3, None, None, None, None, "y", 1),
        (4, base, "en", "b", 1, "z", 2),
        (5, base, "fr", "b", 1, "z", 2),
        (6, base + " w200", "fr", None, 1, "z", 2),
        (7, LONG, "en", "a", 1, "z", 2),
        (8, "Ünï ▁ çödé \U0001f600 x\ty\n", "de", "c", 1, "z", 2),
        (8, "Ünï ▁ çödé \U0001f600 x\ty\n", "de", "c", 1, "z", 2),
        (9, "mail a.b+c@mail.example.com or +1 (316) 555-2121, 10.0.0.255 and 4111 1111 1111 1111.", "en", "c", 1, "z", 2),
    ]
    return spark.createDataFrame(rows, DOCS)


def empty(docs):
    return docs.limit(0)


def paragraphs(text):
    return set(re.findall(r"[^\n]{1,400}", text or ""))


def jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def test_fingerprints_against_sets(docs):
    rows = sorted(docs.dropDuplicates(["doc_id"]).select("doc_id", "text").collect())
    found = {r["id"]: r for r in fingerprints.with_next(docs.dropDuplicates(["doc_id"]), buckets=3).collect()}
    texts = [r["text"] or "" for r in rows]
    for i, r in enumerate(rows):
        assert found[r["doc_id"]]["next_text"] == texts[(i + 1) % len(texts)]
    assert fingerprints.with_next(empty(docs)).count() == 0
    assert fingerprints.with_next(docs).count() == docs.count()


def test_peeling_recovers_differences(spark):
    rows = [(i, list(range(i, i + 3 * i)), list(range(2 * i, 2 * i + 2 * i))) for i in range(1, 40)]
    df = spark.createDataFrame([(i, [x * 7919 for x in a], [x * 7919 for x in b]) for i, a, b in rows], "k int, a array<bigint>, b array<bigint>")
    for name in "ab":
        df = df.withColumn(f"{name}s", F.expr(fingerprints.sketch(f"`{name}`", 1, fingerprints.STORED_WIDTH)))
    for r in fingerprints.differing(df, "a", "b", "as", "bs", "d").collect():
        assert sorted(r["d"]) == sorted(set(r["a"]) ^ set(r["b"]))


def test_fingerprint_query(spark, sf_dir):
    from shelfwise.llm.common import table

    texts = [r["text"] for r in table(spark, sf_dir, "documents").orderBy("doc_id").collect()]
    rows = fingerprints.query(spark, sf_dir).orderBy("doc_id").collect()
    assert len(rows) == len(texts)
    by_text = {}
    for i, r in enumerate(rows):
        t, nxt = texts[i], texts[(i + 1) % len(texts)]
        edited = t[: len(t) - len(t) // 2] + nxt[: len(t) // 2]
        assert r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert r["near_edited"] == pytest.approx(jaccard(paragraphs(t), paragraphs(edited)))
        assert r["near_next"] == pytest.approx(jaccard(paragraphs(t), paragraphs(nxt)))
        assert by_text.setdefault(t, r["fingerprint"]) == r["fingerprint"]


def components(n, links):
    parent = list(range(n))

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = top(a), top(b)
        parent[max(a, b)] = min(a, b)
    return [top(i) for i in range(n)]


def test_simhash_links(spark):
    rng = np.random.default_rng(1)
    base = rng.integers(-(2**62), 2**62, 60)
    fps = {int(x) for x in base}
    for x in base:
        for bits in (1, 2, 3, 4):
            mask = sum(1 << int(b) for b in rng.choice(62, bits, replace=False))
            fps.add(int(x) ^ mask)
    fps = sorted(fps)
    want = {(a, b) for i, a in enumerate(fps) for b in fps[i + 1 :] if ((a ^ b) & (2**64 - 1)).bit_count() <= 3}
    found = simhash.link_fingerprints(spark.createDataFrame([(x,) for x in fps], "fp long")).collect()
    assert len(found) == len(want) and {(r["a"], r["b"]) for r in found} == want


@pytest.mark.parametrize("distance", [0, 1, 2, 5])
def test_simhash_links_at_other_distances(spark, distance):
    rng = np.random.default_rng(10 + distance)
    base = [int(x) for x in rng.integers(-(2**63), 2**63, 12)] + [0, -1]
    fps = sorted({(x ^ sum(1 << int(b) for b in rng.choice(64, bits, replace=False))) % 2**64 for x in base for bits in (0, 1, 2, 3, 5)})
    fps = sorted(x - 2**64 if x >= 2**63 else x for x in fps)
    want = {(a, b) for i, a in enumerate(fps) for b in fps[i + 1 :] if ((a ^ b) & (2**64 - 1)).bit_count() <= distance}
    found = simhash.link_fingerprints(spark.createDataFrame([(x,) for x in fps], "fp long"), distance).collect()
    assert len(found) == len(want) and {(r["a"], r["b"]) for r in found} == want


def test_simhash_bits_against_counting():
    import xxhash

    def count(text):
        words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
        grams = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
        hashes = [xxhash.xxh64(g.encode(), seed=42).intdigest() for g in grams]
        return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))

    for text in (None, "", " \t", "One", "Two WORDS", "ÄÖ İ ẞ Straße A\u00a0b c\x85d\x1ce", "a b c a b c a b c", "the cat sat on the mat " * 50, "x\ny\x0bz\x0cw\rv"):
        assert simhash.simhash(text) == count(text), text


def test_simhash_cases(docs):
    rows = {r["id"]: r for r in simhash.near_duplicates(docs).collect()}
    assert rows[2]["fp"] == rows[3]["fp"] == 0 and rows[3]["component_id"] == 2
    assert rows[4]["fp"] == rows[5]["fp"] and rows[5]["component_id"] == 4
    assert simhash.near_duplicates(docs).count() == docs.count()
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns and sorted(r["doc_id"] for r in kept.collect()).count(8) == 1
    assert simhash.near_duplicates(empty(docs)).count() == 0


def test_connected_components(spark):
    rng = np.random.default_rng(2)
    links = [(int(a), int(b)) for a, b in rng.integers(0, 200, (150, 2))] + [(i, i + 1) for i in range(300, 340)]
    want = components(400, links)
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert all(want[k] == v for k, v in got.items()) and {x for a, b in links if a != b for x in (a, b)} == set(got)


def test_mixing(docs):
    rows = mixing.mix(docs).collect()
    assert len(rows) == docs.count()
    by = {}
    for r in rows:
        assert 0 <= r["taken"] <= 3 * r["size"]
        by.setdefault(r["source"], []).append(r)
    for rs in by.values():
        assert abs(sum(r["taken"] for r in rs) - rs[0]["target"]) <= 1
    assert sum(rs[0]["target"] for rs in by.values()) == pytest.approx(sum(r["size"] for r in rows))
    assert sorted(map(str, rows)) == sorted(map(str, mixing.mix(docs).collect()))
    assert mixing.mix(empty(docs)).count() == 0
    assert mixing.repeat_documents(docs).columns == docs.columns and mixing.repeat_documents(empty(docs)).count() == 0


def test_repeats_go_by_rows_not_ids(spark):
    rows = [(i if i % 3 else None, f"text {i} of its own " * (1 + i % 4), "abc"[i % 7 % 3], "x" if i % 2 else None) for i in range(90)]
    rows += [(7, "one id", "a", None), (7, "one id and another text", "a", None), (7, "one id", "b", None), (8, None, "a", None), (None, "swap", "b", None), (None, "swap", None, "b")] + [(9, "same", "c", "y")] * 5
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, size string")
    mixed, out = mixing.mix(docs).collect(), [tuple(r) for r in mixing.repeat_documents(docs).collect()]
    assert set(out) <= set(rows)
    want, texts = {}, {}
    for r in mixed:
        taken = int(r["taken"] / r["size"] + 0.5) if r["size"] else max(1, r["epochs"])
        want[r["id"], r["source"]] = want.get((r["id"], r["source"]), 0) + taken
    for r in out:
        texts[r[0], r[2]] = texts.get((r[0], r[2]), 0) + 1
    assert texts == {k: v for k, v in want.items() if v}
    assert len({r["order_key"] for r in mixed if r["id"] is None}) == 31


def test_mixing_order_favours_quality(spark):
    df = spark.createDataFrame([(i, "a b c d", "s") for i in range(2000)], "doc_id long, text string, source string")
    weight = F.when(F.col("doc_id") % 2 == 0, 1.0).otherwise(0.1)
    first = mixing.mix(df.withColumn("source", F.concat("source", (F.col("doc_id") % 4 < 2).cast("string"))), quality=weight).orderBy("order_key").limit(500)
    assert first.where("id % 2 = 0").count() > 400


def test_pieces(docs):
    coder = pieces.Pieces()
    plain = pieces.Pieces(dropout=0.0)
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
    for r in docs.collect():
        t = r["text"]
        if t is not None:
            assert coder.decode(coder.encode(t, 5)) == t and plain.decode(plain.encode(t)) == t
            assert coder.encode(t, 5) == pieces.Pieces().encode(t, 5)
            if "▁" not in t:
                assert plain.encode(t) == library.encode(t)
    both = pieces.decode_documents(pieces.encode_documents(docs), out="back")
    assert both.where(~F.col("back").eqNullSafe(F.col("text"))).count() == 0 and both.count() == docs.count()
    assert pieces.encode_documents(empty(docs)).count() == 0


def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int, unit string")


def test_embeddings_against_brute_force(spark):
    rng = np.random.default_rng(3)
    base = rng.standard_normal((120, 16))
    near = base[rng.integers(0, 120, 200)] + rng.standard_normal((200, 16)) * rng.choice([0.05, 0.2, 0.35], (200, 1))
    hot = base[0] + rng.standard_normal((150, 16)) * 0.05
    x = np.vstack([base, near, hot, base[:5]])
    label = rng.integers(0, 2, len(x))
    label[-155:] = 0
    rows = [(i, [float(c) for c in v], int(k), "u") for i, (v, k) in enumerate(zip(x, label))]
    bad = [(900, None, 0, "u"), (901, [], 0, "u"), (902, [0.0] * 16, 0, "u"), (903, [float("nan")] * 16, 0, "u"), (904, [None] + [1.0] * 15, 0, "u"), (905, rows[0][1], None, "u")]
    n = x / np.linalg.norm(x, axis=1, keepdims=True)
    link = (n @ n.T >= 0.93) & (label[:, None] == label[None, :])
    np.fill_diagonal(link, False)
    want = components(len(x), zip(*np.nonzero(link)))
    got = {r["id"]: r for r in embeddings.near_duplicates(vectors(spark, rows + bad)).collect()}
    found = sum(got[i]["n_links"] for i in range(len(x)))
    assert found <= link.sum() and found >= 0.99 * link.sum() and sum(got[i]["n_links"] == link[i].sum() for i in range(len(x))) >= 0.98 * len(x)
    assert np.mean([got[i]["component_id"] == want[i] for i in range(len(x))]) > 0.99
    for i in range(900, 906):
        assert got[i]["n_links"] == 0 and got[i]["component_id"] == i
    assert embeddings.near_duplicates(vectors(spark, []).limit(0)).count() == 0
    assert embeddings.near_duplicates(vectors(spark, bad)).count() == len(bad)


def test_sharding(docs):
    rows = sharding.shard(docs, n_shards=4).collect()
    assert len(rows) == docs.count()
    for s in {r["shard"] for r in rows}:
        assert sorted(r["slot"] for r in rows if r["shard"] == s) == list(range(sum(r["shard"] == s for r in rows)))
    assert sharding.shard(empty(docs)).count() == 0


def test_sharding_splits_hot_groups(spark):
    df = spark.range(3000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, F.lit("same text")).otherwise(F.concat(F.lit("text "), F.col("id").cast("string"))).alias("text"))
    sizes = [r["b"] for r in sharding.shard(df, n_shards=8).groupBy("shard").agg(F.sum("size").alias("b")).collect()]
    assert len(sizes) == 8 and max(sizes) < 1.05 * min(sizes)


def test_license_scan(docs, spark):
    header = licenses.TEMPLATES["Apache-2.0-header"]
    texts = ["x " * 50 + "Released under the MIT License. more", header.replace("may not", "must never"), "the license of the work", None, "", "This work is licensed under the GNU General Public License, version 3. And: Released under the mit license"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = licenses.find(df).orderBy("id", "span_start").collect()
    assert [(r["id"], r["license"]) for r in rows] == [(0, "MIT"), (1, "Apache-2.0-header"), (5, "GPL-3.0"), (5, "MIT")]
    assert texts[0][rows[0]["span_start"] : rows[0]["span_end"]] == "Released under the MIT License" and rows[0]["coverage"] == 1.0
    assert 0.8 <= rows[1]["coverage"] < 1
    assert licenses.find(empty(docs)).count() == 0 and licenses.find(docs).count() == 0


PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def brute_spans(text):
    out = []
    for k, (kind, pattern) in enumerate(PATTERNS.items()):
        for m in re.finditer(pattern, text):
            digits = re.sub(r"\D", "", m.group())
            good = {"email": True, "ip": all(int(p) <= 255 for p in m.group().split(".")) if kind == "ip" else 0, "card": 12 <= len(digits) <= 19 and pii.luhn(digits), "phone": 9 <= len(digits) <= 15}[kind]
            if good:
                out.append((m.start(), k, m.end()))
    return sorted(out)


def test_pii_patterns_against_brute_force():
    rng = np.random.default_rng(4)
    for _ in range(3000):
        text = "".join(rng.choice(list("ab1234567890@@..-+ ()\n%_é"), rng.integers(0, 40)))
        assert pii.base_spans(text) == brute_spans(text), text


def test_pii_viterbi_against_all_paths():
    from itertools import product

    model = pii.train()
    rng = np.random.default_rng(5)
    for n in (1, 2, 3, 4):
        e = rng.standard_normal((n, model.n)) * 3
        # The words in front of and behind a run are O.
        best = max(product(range(model.n), repeat=n), key=lambda y: sum(e[t, y[t]] for t in range(n)) + sum(model.move[a, b] for a, b in zip((0, *y), (*y, 0))))
        assert tuple(model.viterbi([e])[0]) == best
    right = total = 0
    for words, labels in pii.labelled_table():
        for a, b in pii._runs(words):
            got = model.viterbi([model.emissions(words, a, b)])[0]
            right, total = right + int((got == labels[a:b]).sum()), total + b - a
    assert right / total > 0.95


def test_pii_find_and_redact(docs):
    rows = {r["id"]: r for r in pii.find(docs).collect()}
    assert (rows[9]["n_email"], rows[9]["n_ip"], rows[9]["n_card"], rows[9]["n_phone"]) == (1, 1, 1, 1)
    assert rows[3]["spans"] == rows[2]["spans"] == rows[4]["spans"].replace(rows[4]["spans"], "") == ""
    out = {r["doc_id"]: r["text"] for r in pii.redact(docs).collect()}
    assert out[9] == "mail <email> or <phone>, <ip> and <card>." and out[3] is None and out[1] == "one line\nanother line\nthird"
    assert pii.find(empty(docs)).count() == 0
    text = "call (555) 555-0199 now"
    assert pii.joined(pii.added_spans([text], [[]], pii.train())[0]) == "phone:5:19"
    assert pii.base_spans("a" * 200000 + "@" + "b" * 200000) == []


def test_rollups(spark, docs, tmp_path):
    table = rollups.RollupTable(spark, f"{tmp_path}/r")
    assert table.totals().count() == 0
    schema = "op string, source string, lang string, old_version string, old_tokens long, tokenizer_version string, tokens long"
    first = spark.createDataFrame([("insert", "a", "en", None, None, "v1", 5), ("insert", "a", "en", None, None, "v1", 7), ("insert", None, None, None, None, "v1", None)], schema)
    second = spark.createDataFrame([("revise", "a", "en", "v1", 5, "v2", 6), ("delete", None, None, "v1", 0, None, None)], schema)
    assert table.commit("1", first) and table.commit("2", second) and not table.commit("1", first)
    got = {(r["source"], r["tokenizer_version"]): (r["docs"], r["tokens"]) for r in table.totals().collect()}
    assert got == {("a", "v1"): (1, 7), ("a", "v2"): (1, 6)}
    assert table.commit("3", first.limit(0)) and table.totals().count() == 2


def test_quality(spark, docs):
    good = [(i, f"the river and the town of number {i} are calm and the road is long", None) for i in range(300)]
    junk = [(1000 + i, f"THE!! RIVER### {i}%%% AND&&& TOWN*** OF###", None) for i in range(300)]
    df = spark.createDataFrame(good + junk, "doc_id long, text string, score string")
    labels = spark.createDataFrame([(i, 1) for i, *_ in good] + [(i, 0) for i, *_ in junk] + [(5, None)], "doc_id long, quality int")
    rows = quality.score(df, labels).collect()
    held = [r for r in rows if r["held_out"]]
    assert held and np.mean([r["predicted"] == (r["id"] < 1000) for r in held]) > 0.95
    assert all(0 <= r["score"] <= 1 for r in quality.score(docs, labels).collect())
    assert quality.score(empty(docs), labels).count() == 0
    assert {r["score"] for r in quality.score(docs, labels.limit(0)).collect()} == {0.5}
    assert quality.accepted(df, labels).columns == df.columns


def test_context_vectors_against_loop(spark):
    texts = ["a b c a", "b ! b", None, ""]
    index, want = quality.index_table(), np.zeros((quality.ROWS, quality.DIM))
    for t in texts:
        ids = quality.rows_of(t).tolist()
        for i, x in enumerate(ids):
            for j in range(max(0, i - quality.WINDOW), min(len(ids), i + quality.WINDOW + 1)):
                if j != i:
                    want[x] += index[ids[j]]
    got = quality.context_vectors(spark.createDataFrame([(t,) for t in texts], "text string"))
    assert np.allclose(got, want)


def test_partly_linked_balls_are_counted_in_blocks(spark):
    rng = np.random.default_rng(12)
    unit = rng.standard_normal((90, 8))
    unit[:60] = unit[0] + 0.3 * unit[:60]
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    ball = np.repeat([7, 8, 9], 30)
    copies = rng.integers(1, 4, 90)
    members = spark.createDataFrame([(int(b), i, [float(v) for v in u], int(n)) for i, (b, u, n) in enumerate(zip(ball, unit, copies))], "ball long, vec long, unit array<double>, copies long")
    balls = members.groupBy("ball").agg(F.count("*").alias("n"))
    pairs = [(7, 8), (8, 9), (7, 9)]
    sides = spark.createDataFrame(pairs, "a long, b long").join(members.select(F.col("ball").alias("a"), F.col("vec").alias("x"), F.col("unit").alias("u"), F.col("copies").alias("n")), "a")
    want = {}
    for a, b in pairs:
        for i, j in zip(*np.nonzero((unit @ unit.T >= 0.8) & (ball[:, None] == a) & (ball[None, :] == b))):
            for v, n in ((i, copies[j]), (j, copies[i])):
                want[a, b, int(v)] = want.get((a, b, int(v)), 0) + int(n)
    for block in (4, 1000):
        got = embeddings._verified(sides, members, balls, 0.8, block).collect()
        assert want and {(r["a"], r["b"], r["vec"]): r["n"] for r in got} == want
    assert embeddings._verified(sides.limit(0), members, balls, 0.8).count() == 0
