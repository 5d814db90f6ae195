"""Splittable CSV and JSON against Spark's readers of whole files, at split sizes down to a few bytes."""

import json
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfwise.sources import files as IO
from shelfwise.sources import ranges as R


@pytest.fixture
def split_size(spark):
    """Sets the bytes of a split for one test."""
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    before = {n: spark.conf.get(n) for n in names}
    yield lambda n: [spark.conf.set(name, str(n)) for name in names]
    for n, v in before.items():
        spark.conf.set(n, v)


def whole_file(spark, path):
    return spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)


def field(rng):
    kind = rng.randrange(7)
    if kind < 3:
        return rng.choice(["", "a", "word", "12.5", "é ü", " x "])
    text = "".join(rng.choice(["a", "b", ",", '""', "\n", "\r\n", " ", "ö"]) for _ in range(rng.choice([0, 3, 10, 60])))
    return f'"{text}"' if kind < 6 else rng.choice(['mid"quote', '5" tall', '"x"y'])


@pytest.mark.parametrize("seed", range(2))
def test_csv_equals_whole_file_reader(spark, tmp_path, split_size, seed):
    rng = random.Random(seed)
    end = ["\n", "\r\n"][seed % 2]
    lines = ['"na,me",price,"no""te"'] + [",".join(field(rng) for _ in range(3)) for _ in range(150)] + ["", "only one"]
    (tmp_path / "a.csv").write_bytes(end.join(lines).encode() + b"\n" * (seed % 3))
    want = Counter(tuple(r) for r in whole_file(spark, f"{tmp_path}/a.csv").collect())
    for size in (97, 5000):
        split_size(size)
        got = R.read_csv(spark, f"{tmp_path}/a.csv")
        assert got.rows.columns == ["na,me", "price", 'no"te'], size
        assert Counter(tuple(r) for r in got.rows.collect()) == want, size
        assert got.bad.count() == 0
    split_size(1 << 20)
    assert Counter(tuple(r) for r in R.read_csv(spark, f"{tmp_path}/a.csv").rows.collect()) == want


def test_bad_csv(spark, tmp_path, split_size):
    (tmp_path / "a.csv").write_text('a,b\n1,2\n1,2,3\n4\n"x,y",5\n"u","v","w"\n7,"never closed\n8,9\n10,11\n')
    (tmp_path / "b.csv").write_text("b,c\n12,13\n")
    (tmp_path / "empty.csv").write_text("")
    for size in (9, 1 << 20):
        split_size(size)
        got = R.read_csv(spark, f"{tmp_path}/*.csv")
        assert sorted(map(repr, (r.asDict() for r in got.rows.select("a", "b", "c").collect()))) == sorted(
            map(repr, ({"a": a, "b": b, "c": x} for a, b, x in [("1", "2", None), ("4", None, None), ("x,y", "5", None), (None, "12", "13")]))
        )
        bad = got.bad.orderBy("file", "start", "number").collect()
        assert sorted(r["text"] for r in bad if r["reason"] == "more fields than the header") == ['"u","v","w"', "1,2,3"]
        assert "\n".join(r["text"] for r in bad if r["reason"] == "quote without an end") == '7,"never closed\n8,9\n10,11'


def test_splits_that_change_are_an_error(spark, tmp_path, split_size):
    (tmp_path / "a.csv").write_text("a,b\n" + '1,"x\ny"\n' * 100)
    split_size(100)
    rows = R.read_csv(spark, f"{tmp_path}/a.csv").rows
    split_size(130)
    with pytest.raises(Exception, match="cut otherwise"):
        rows.collect()


def value(rng, depth=0):
    kind = rng.randrange(8 if depth < 3 else 5)
    if kind == 0:
        return rng.choice([None, True, 1.5, 7])
    if kind < 5:
        return "".join(rng.choice(['"', "\\", "{", "}", "[", "]", ",", "\n", "a", "é"]) for _ in range(rng.choice([0, 4, 30])))
    if kind == 5:
        return [value(rng, depth + 1) for _ in range(rng.randrange(3))]
    return {rng.choice("kl{"): value(rng, depth + 1) for _ in range(rng.randrange(3))}


@pytest.mark.parametrize("indent", [None, 2, "lines"])
def test_json_equals_whole_file_reader(spark, tmp_path, split_size, indent):
    rng = random.Random(7)
    records = [{"name": f"n{i}", "price": rng.choice([None, "1}", '{"']), "more": value(rng)} for i in range(80)]
    text = "\n".join(map(json.dumps, records)) if indent == "lines" else json.dumps(records, indent=indent, ensure_ascii=False)
    (tmp_path / "a.json").write_text(text)
    schema = T.StructType([T.StructField("name", T.StringType()), T.StructField("price", T.StringType())])
    want = Counter((r["name"], r["price"]) for r in records)
    if indent != "lines":
        assert Counter(tuple(r) for r in spark.read.schema(schema).option("multiLine", True).json(f"{tmp_path}/a.json").collect()) == want
    for size in (141, 1 << 20):
        split_size(size)
        got = R.read_json_objects(spark, f"{tmp_path}/a.json", schema)
        assert Counter(tuple(r) for r in got.rows.collect()) == want and got.bad.count() == 0, size
        free = R.read_json_objects(spark, f"{tmp_path}/a.json")
        back = [json.loads(r[0]) for r in free.rows.select(F.to_json("record")).collect()]
        key = lambda r: r["name"]
        assert sorted(back, key=key) == sorted(records, key=key) and free.bad.count() == 0, size


def test_bad_json(spark, tmp_path, split_size):
    (tmp_path / "a.json").write_text('[{"name": "a"}, 5, "x{y", {"name": wrong}, {"name": "b"},\n {"name": "cut')
    (tmp_path / "b.json").write_text('[{"name": "c"}, {"name": "d"')
    (tmp_path / "c.json").write_text("[]")
    (tmp_path / "d.json").write_text("")
    schema = T.StructType([T.StructField("name", T.StringType())])
    for size in (11, 1 << 20):
        split_size(size)
        for got in (R.read_json_objects(spark, f"{tmp_path}/*.json", schema), R.read_json_objects(spark, f"{tmp_path}/*.json")):
            names = got.rows.select("name") if "name" in got.rows.columns else got.rows.select(F.variant_get("record", "$.name", "string"))
            assert sorted(r[0] for r in names.collect()) == ["a", "b", "c"], size
            bad = sorted((r["reason"], r["text"]) for r in got.bad.collect())
            assert [b for b in bad if b[0] == "no JSON of this form"] == [("no JSON of this form", '{"name": wrong}')]
            assert [b[1] for b in bad if b[0] == "no object"] == ['5, "x{y"']
            assert "".join(b[1] for b in bad if b[0] == "object without an end").count("name") == 2


def test_snapshot_readers_use_them(spark, tmp_path, split_size):
    split_size(64)
    (tmp_path / "s.csv").write_text('name,note\n' + 'x,"a\nb"\n' * 50)
    got = IO.read_snapshot_csv(spark, f"{tmp_path}/s.csv")
    assert got.rdd.getNumPartitions() > 3 and Counter(map(tuple, got.collect())) == {("x", "a\nb"): 50}


def test_only_json_files_of_several_splits_are_surveyed(spark, tmp_path, split_size):
    (tmp_path / "a.json").write_text("[" + ",".join(json.dumps({"name": f"n{i}"}) for i in range(200)) + "]")
    (tmp_path / "b.json").write_text('[{"name": "small"}]')
    split_size(500)
    cut = R.survey(R._chunks(spark, str(tmp_path), R.JsonObjects, cut_files=True), R.JsonObjects)
    assert {r["file"].rsplit("/", 1)[1] for r in cut.select("file").distinct().collect()} == {"a.json"} and cut.count() > 3
    assert IO.read_snapshot_json(spark, str(tmp_path)).count() == 201
    split_size(1 << 20)
    assert R._chunks(spark, str(tmp_path), R.JsonObjects, cut_files=True).isEmpty()
    assert IO.read_snapshot_json(spark, str(tmp_path)).count() == 201
