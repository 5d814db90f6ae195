"""Every group of near-duplicates keeps one row, whatever the ids."""

from shelfwise.llm import mixing, simhash

ROWS = [(None, f"unrelated text {i} " + " ".join(f"w{i}x{j}" for j in range(40))) for i in range(30)]
ROWS += [(1, ROWS[0][1]), (2, "one id " + "stands for this " * 9), (2, " ".join(f"other{j}" for j in range(40))), (None, None), (3, ""), (4, "twice"), (4, "twice")]


def test_every_group_keeps_one_row(spark):
    docs = spark.createDataFrame(ROWS, "doc_id long, text string")
    kept = [tuple(r) for r in simhash.keep_one(docs).collect()]
    fps = [simhash.simhash(t) for _, t in kept]
    assert all((a ^ b).bit_count() > 3 for i, a in enumerate(fps) for b in fps[:i])
    assert len(fps) == len({simhash.simhash(t) for _, t in ROWS})
    assert (1, ROWS[0][1]) in kept and (3, "") in kept and kept.count((4, "twice")) == 1 and [i for i, _ in kept].count(2) == 2
    assert [i for i, _ in kept].count(None) == 29


def test_nulls_in_other_places_are_other_rows(spark):
    a, b = " ".join(f"a{j}" for j in range(40)), " ".join(f"b{j}" for j in range(40))
    docs = spark.createDataFrame([(None, a, "en", None), (None, a, None, "en"), (1, b, "x", "y"), (1, b, "x", "y"), (1, b, None, "y")], "doc_id long, text string, lang string, fp string")
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns and sorted(r["text"] for r in kept.collect()) == [a, b]
    assert simhash.keep_one(docs.limit(0)).count() == 0


def test_texts_are_shuffled_once(spark):
    docs = spark.createDataFrame([(1, "x y z", "s")], "doc_id long, text string, source string")
    for out in (simhash.keep_one(docs), mixing.repeat_documents(docs)):
        plan = out._jdf.queryExecution().optimizedPlan().toString() and out._jdf.queryExecution().executedPlan().toString()
        exchanged = [line for line in plan.splitlines() if "Exchange hashpartitioning(__row_a" in line]
        assert len(exchanged) <= 2 and "Exchange hashpartitioning(text" not in plan, plan
