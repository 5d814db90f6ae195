"""Quality rules against plain Python."""

import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from shelfwise.llm import line_rules as R
from shelfwise.llm.common import table

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def normal(line):
    return " ".join(WORDS.findall("".join(c.lower() if "A" <= c <= "Z" else "0" if c in "123456789" else c for c in line)))


def counts_by_definition(text):
    words = WORDS.findall(text)
    lines = [x for x in text.split("\n") if WORDS.search(x)]
    windows = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    inside = {j for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for j in range(i, i + 3)}
    return [len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(inside)]


def judged(rows, max_docs):
    """{(id, host, text): (counts, base_failed, frequent lines, words left, kept)}"""
    holders = defaultdict(set)
    for _, host, text in rows:
        for line in (text or "").split("\n"):
            if WORDS.search(line):
                holders[host, normal(line)].add(text)
    out = []
    for i, host, text in rows:
        c = counts_by_definition(text or "")
        gone = [x for x in (text or "").split("\n") if WORDS.search(x) and len(holders[host, normal(x)]) > max_docs]
        left = c[0] - sum(len(WORDS.findall(x)) for x in gone)
        failed = c[0] < 50 or 100 * c[4] > 50 * c[0]
        out.append((i, *c, failed, len({normal(x) for x in gone}), left, not failed and left >= 50 and left >= 0.5 * c[0]))
    return sorted(out, key=repr)


BODY = " ".join(f"own{i} w{i} of{i} text{i}" for i in range(20))
ODD = [
    *[(i, "a", f"Shared LINE 1{i}\n{BODY.replace('own', 'u' + 'abcde'[i])}\nshared  line\t2{i} ") for i in range(5)],
    *[(50 + i, "a", f"{BODY}\nonly copies") for i in range(4)],
    *[(60 + i, "b", f"Shared line 1{i}\n{BODY.replace('own', 'v' + 'abcde'[i])}") for i in range(2)],
    *[(70 + i, None, f"x{i}\n{BODY}\nof no host") for i in range(4)],
    *[(80 + i, "c", f"{BODY}\nshort {'abcd'[i]}") for i in range(4)],
    (None, "a", None), (1, "a", ""), (2, None, " \n\t\n"), (90, "a", "a b c " * 40), (90, "a", "a b c " * 40), (91, "", "é " * 60 + "*#$ <b>&|%\r\x0b\x0c"), (92, "a", "word\n" * 20000),
]


@pytest.fixture(scope="module")
def odd(spark):
    df = spark.createDataFrame(ODD, "doc_id long, source string, text string")
    return df.withColumns({"id": F.lit("clash"), "lines": F.lit(1), "__line": F.lit(2), "frequent": F.lit("x")})


def test_odd_rows(odd):
    got = sorted((tuple(r) for r in R.judge(odd, max_docs=3).collect()), key=repr)
    assert got == judged(ODD, 3)
    by_id = {r[0]: r for r in got}
    assert by_id[3][7] == 1 and by_id[3][-1] and by_id[60][7] == 0 and by_id[50][7] == 0
    assert not by_id[80][-1] and by_id[80][8] == 2 and not by_id[70][-1]
    assert R.judge(odd.limit(0)).count() == 0


def test_clean(odd):
    holders = defaultdict(set)
    for _, host, text in ODD:
        for line in (text or "").split("\n"):
            holders[host, normal(line)].add(text)
    kept = lambda host, text: None if text is None else "\n".join(x for x in text.split("\n") if not WORDS.search(x) or len(holders[host, normal(x)]) <= 3)
    got = R.clean(odd, max_docs=3)
    assert got.columns == odd.columns
    assert Counter((r["doc_id"], r["source"], r["text"]) for r in got.collect()) == Counter((i, h, kept(h, t)) for i, h, t in ODD)


def test_query(spark, sf_dir):
    rows = [(r["doc_id"], r["source"], r["text"]) for r in table(spark, sf_dir, "documents").collect()]
    got = sorted((tuple(r) for r in R.query(spark, sf_dir).collect()), key=repr)
    assert got == judged(rows, R.MAX_DOCS)
    assert 0 < sum(r[-1] for r in got) < len(got)
