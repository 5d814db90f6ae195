"""Golden rows of the Column functions and small cases of the catalog operators."""

import datetime

import pytest
from pyspark.sql import functions as F

from shelfwise.functions import text as T
from shelfwise.operators import dedupe as D
from shelfwise.operators import export as X
from shelfwise.operators import extract as E
from shelfwise.operators import html_blocks as H
from shelfwise.operators import lifecycle as L
from shelfwise.operators import reshape as W
from shelfwise.sources import files as IO
from shelfwise.streaming import jobs

AS_OF = "2025-08-03"
c = F.col


def values(spark, texts, make):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, x string")
    return [r["y"] for r in df.select("i", make(c("x")).alias("y")).orderBy("i").collect()]


@pytest.mark.parametrize(
    ("make", "cases"),
    [
        (T.format_color_name, {"reddark": "Red dark", "green_greenlight": "Green/Green light", "_": "", None: "", "BLUE": "Blue"}),
        (T.parse_price, {"1.849 €": 1849.0, "€ 1.849,00": 1849.0, "on request": None, "999.00": 99900.0}),
        (T.price_to_int, {"999.00": 99900, "1.849 €": 1849, "x": None}),
        (T.sku_from_url, {"https://h/a/1234.html?x=1": "1234", "https://h/a/b.html": None, "https://h/a/1234/": None}),
        (lambda x: T.is_product_url(x, "h.example", "/road/"), {"https://h.example/road/4567.html": True, "https://h.example/road/123.html": False, "https://h.example/blog-content/road/4567.html": False, None: False}),
        (T.clean_weight, {"7.5 kg / 16.5 lbs and 8 kg / 17 lbs": "7.5 kg and 7.5 kg", "8 kg": "8 kg"}),
        (lambda x: T.clean_weight(x, per_pair=True), {"7.5 kg / 16.5 lbs and 8 kg / 17 lbs": "7.5 kg and 8 kg"}),
        (T.size_in_weight, {"56 - 8.4 kg": "56 cm - 8.4 kg", "56 cm - 8.4 kg": "56 cm - 8.4 kg"}),
        (T.extract_weight_limit, {"max 125 kg (275 lbs)": "125 kg", "275 lbs": "275 lbs", "?": "?"}),
        (T.clean_shifter_sizes, {"Maat: 47, 50, 52 Tiagra": "Tiagra", "Maat: XS, S, M Sora": "Sora"}),
        (T.shifter_speed, {"X, 11-speed": "11-speed", "10 versnellingen": "10-speed", "SRAM RED AXS E1": "12-speed", "none": None}),
        (T.strip_shifter_speed, {"Tiagra, 10 speed, grey": "Tiagra grey", "Sora, 9-speed": "Sora"}),
        (T.frame_material, {"500 Series OCLV carbon, tapered": "500 Series Oclv Carbon", "Frame: light alloy, x": "light alloy"}),
        (T.is_single_chainring, {"50/34": False, "46x30": False, "40T": True, "apex 1": True, "34t": False}),
        (T.is_wide_cassette, {"11-34": False, "10-44": True, "9-50": True}),
        (T.image_file_name, {"https://h/a/b c.jpg?x": "b_c.jpg", "https://h/": "image.jpg", "https://h/pic": "pic.jpg", "https://h/Émonda SL": "Émonda_SL.jpg"}),
        (lambda x: T.to_dd_mm_yyyy(x, AS_OF), {"01-07-2025": "01-07-2025", "2025-07-01": "01-07-2025", "Unknown": "Unknown", None: "Unknown", "102343": "03-08-2025"}),
        (T.clean_field, {" a\n\tb c ": "a b c", None: ""}),
        (T.word_count, {"a b c": 3, "": 0, None: 0}),
        (T.page_weight, {"about 7,5 kg": "7.5 kg", "none": None}),
        (T.page_fork, {"A nice Carbon fork with mount. More": "carbon fork with mount", "no": None}),
        (T.fit_from_url, {"/endurace-aero/": "allroad", "/endurace/": "endurance", "/aeroad/": "race", "/x/": None}),
        (T.component_speed, {"2 speed and 12-speed": "12 speed", "3 speed": None}),
        (E.map_key, {"Framefit:": "Frame", "Zadelpen": "Zadel", "unknown": None}),
    ],
)
def test_column_functions(spark, make, cases):
    assert values(spark, list(cases), make) == list(cases.values())


def test_chain_and_drivetrain(spark):
    df = spark.createDataFrame([("SRAM Eagle", "11-34", "SRAM PC-1130, 11-speed"), ("Shimano 105", "x", "Shimano SLX M7100, 12-speed"), (None, None, None)], "r string, k string, want string")
    assert all(r["want"] == r["got"] for r in df.select("want", T.predict_chain(c("r"), c("k")).alias("got")).collect())
    row = spark.createDataFrame([("", "50/34", "10-44", "sram apex xplr", "gravel")], "a string, b string, k string, r string, n string")
    assert row.select(T.classify_drivetrain(c("a"), c("b"), c("k"), c("r"), c("n"))).first()[0] is None


def sides(spark):
    cur = spark.createDataFrame([("b", "cur", "1", 1), ("b", "cur", "9", 2), ("b", "both", "2", 3), ("b", "new", "3", 4), ("b", None, "3", 5)], "brand string, name string, price string, ord int")
    arc = spark.createDataFrame([("b", "arc", "4", "18-07-2025"), ("b", "arcmas", "5", "18-07-2025"), ("b", "cur", "6", "18-07-2025")], "brand string, name string, price string, snapshot_date string")
    mas = spark.createDataFrame([("b", "both", "7", "2025-07-01", "02-07-2025", "m"), ("b", "arcmas", "8", "01-01-2025", "02-01-2025", "m"), ("b", "mas", "9", None, None, "m")], "brand string, name string, price string, first_seen_date string, last_seen_date string, extra string")
    return cur, arc, mas


def test_update_master(spark):
    out = {r["name"]: r for r in L.update_master(*sides(spark), ["brand", "name"], AS_OF).collect()}
    assert {k: r["status"] for k, r in out.items()} == {"cur": "New", "both": "Available", "new": "New", "arc": "Discontinued", "arcmas": "Discontinued", "mas": "Discontinued"}
    assert out["cur"]["price"] == "1" and out["both"]["price"] == "2" and out["arcmas"]["price"] == "5" and out["mas"]["price"] == "9"
    assert (out["both"]["first_seen_date"], out["both"]["last_seen_date"]) == ("01-07-2025", "03-08-2025")
    assert (out["arcmas"]["last_seen_date"], out["mas"]["last_seen_date"]) == ("18-07-2025", "Unknown")
    again = L.update_master(sides(spark)[0], sides(spark)[1], L.update_master(*sides(spark), ["brand", "name"], AS_OF), ["brand", "name"], AS_OF)
    assert again.where("status = 'New'").count() == 0 and again.count() == len(out)


def test_dedupe_is_idempotent(spark):
    df = spark.createDataFrame([("a", 2, "x"), ("a", 1, "y"), ("", 3, "z"), (None, 4, "w")], "name string, ord int, v string")
    once = D.first_by_name(df)
    assert sorted(map(str, once.collect())) == sorted(map(str, D.first_by_name(once).collect())) and once.where("name = 'a'").first()["v"] == "y"
    assert D.first_by_name(df, drop_empty=True).count() == 1


def test_csv_round_trips(spark, tmp_path):
    df = spark.createDataFrame([("a\nb", 'say "x", y', ""), (None, "é", "1")], "x string, y string, z string")
    for i, write in enumerate((IO.write_csv_quote_all, IO.write_csv_minimal)):
        write(df, f"{tmp_path}/{i}")
        back = sorted(map(tuple, IO.read_snapshot_csv(spark, f"{tmp_path}/{i}").collect()), key=str)
        assert back == sorted([("a\nb", 'say "x", y', None), (None, "é", "1")], key=str)
    IO.write_json_records(df, f"{tmp_path}/j")
    assert spark.read.json(f"{tmp_path}/j").count() == 2
    for ts in ("20250718_102343", "20250718_102836"):
        IO.write_versioned_latest(df.withColumn("v", F.lit(ts)), f"{tmp_path}/v", ts)
    assert {r["v"] for r in IO.read_latest(spark, f"{tmp_path}/v").collect()} == {"20250718_102836"}


def test_snapshot_json(spark, tmp_path):
    (tmp_path / "s.json").write_text('[{"name": "A", "colors": [{"id": "1", "name": "red", "url": "u"}], "specifications": {"Frame": "x"}}, {"name": "B", "price": "3"}]')
    rows = {r["name"]: r for r in IO.read_snapshot_json(spark, f"{tmp_path}/s.json").collect()}
    assert rows["A"]["colors"][0]["name"] == "red" and rows["A"]["specifications"] == {"Frame": "x"} and rows["B"]["price"] == "3" and rows["B"]["colors"] is None


def test_export_by_brand(spark, tmp_path):
    df = spark.createDataFrame([("a", "x", "Available"), ("b", "y", "Available"), ("c", "y", "New")], "name string, brand string, status string")
    X.export_per_brand_and_all(df, f"{tmp_path}/e", AS_OF)
    assert spark.read.parquet(f"{tmp_path}/e").count() == 2 and spark.read.parquet(f"{tmp_path}/e/brand=y").count() == 1
    assert W.sorted_custom_fields(X.export_unified(df, ["x"], AS_OF)) == ["meta:availability_status", "meta:import_brands", "meta:import_date"]


PAGE = """<html><table><tr><td>* Frame:</td><td> Carbon <b>X</b></td></tr><tr><th>Rem</th><td>Old</td></tr><tr><td>Rem</td><td>Disc</td></tr><tr><td>only</td></tr></table>
<dl><dt>Rem</dt><dd>Hydraulic</dd><dt>Weight</dt><dd>8 kg</dd><dt>alone</dt></dl>
<div class="description">short</div><div class="description">A long enough description of this very good road bicycle.</div>
<ul><li class="component"><h4>Wiel</h4><span class="name">DT</span><ul><li class="feature">12x100</li><li class="feature">x</li></ul></li></ul>
<a class="color" data-color-id="1" data-color-name="Red" href="/r"></a><a class="color" data-color-id="2" data-color-name="Members only"></a><a class="color" data-color-id="3"></a>
<p class="classification">Use: 1, max 120 kg</p></html>"""


def test_html_blocks(spark):
    pages = spark.createDataFrame([(1, PAGE), (2, None), (3, "")], "page_id long, html string")
    blocks = H.extract_blocks(pages).persist()
    table = {r["key"]: r["value"] for r in H.extract_spec_table(blocks).collect()}
    assert table == {"Frame": "CarbonX", "Rem": "Disc"}
    assert {r["key"]: r["value"] for r in H.extract_spec_dl(blocks).collect()} == {"Frame": "CarbonX", "Rem": "Hydraulic", "Weight": "8 kg"}
    assert {r["field"]: r["value"] for r in H.extract_spec_rows_mapped(blocks).collect()}["Rem"] == "Hydraulic"
    parts = H.extract_components(blocks)
    assert parts.first()[2:] == ("Wiel", "DT", ["12x100", "x"])
    assert {r["field"]: r["value"] for r in E.component_special_rules(parts).collect()} == {"Naaf_voor": "DT", "Velg": "DT"}
    assert H.extract_description(blocks).first()["description"].startswith("A long enough")
    assert [(x["id"], x["name"]) for x in H.extract_color_picker(blocks).first()["colors"]] == [("1", "Red")]
    assert H.extract_classification_limit(blocks).first()["weight_limit"] == "120 kg"


def test_enrich_specs(spark):
    df = spark.createDataFrame([("Domane SL 6 AXS", "road", "A carbon fork for all. x", {"Cassette": "10-44", "Crankstel": "40t ring", "Achterderailleur": "SRAM Rival", "Gewicht": "56 - 8 kg / 17 lbs", "Shifter": "Maat: 47, 50 Rival, 12-speed"})], "name string, category string, text string, specs map<string,string>")
    specs = E.enrich_specs(df).first()["specs"]
    assert specs["Framefit"] == "Endurance*" and specs["Bottom bracket"].endswith("*") and specs["Ketting"] == "SRAM Rival, 12-speed*"
    assert specs["Gewicht"] == "56 cm - 8 kg" and specs["Shifter"] == "Rival" and specs["Shifter_speed"] == "12-speed"
    assert specs["Voorderailleur"] == "1x, geen voorderailleur" and specs["Voorvork"] == "carbon fork for all"


def test_stream_master_update(spark, tmp_path):
    schema = "brand string, name string, price string, as_of string"
    for i, rows in enumerate(([("b", "x", "1", "2025-08-01"), ("b", "y", "2", "2025-08-01")], [("b", "x", "3", "2025-08-02")])):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        jobs.stream_master_update(spark, f"{tmp_path}/in", f"{tmp_path}/out", schema, ["brand", "name"]).awaitTermination()
    out = {r["name"]: (r["status"], r["price"], r["first_seen_date"]) for r in jobs.latest_master(spark, f"{tmp_path}/out").collect()}
    assert out == {"x": ("Available", "3", "01-08-2025"), "y": ("Discontinued", "2", "01-08-2025")}


def test_lifecycle_replay(spark):
    d = lambda n: datetime.date(2025, 7, n)
    df = spark.createDataFrame([("b", "x", d(1)), ("b", "x", d(3)), ("b", "y", d(2)), ("b", "z", d(3))], "brand string, name string, snapshot_date date")
    assert {r["name"]: r["status"] for r in L.lifecycle_replay(df, ["brand", "name"]).collect()} == {"x": "Available", "y": "Discontinued", "z": "New"}


def test_global_retention_over_the_whole_manifest(spark, sf_dir):
    from shelfwise.plans import adaptors as A

    rows = A.frame(spark, sf_dir, A.MANIFEST)
    newest = sorted(((r["mtime"], r["path"]) for r in rows.collect()), reverse=True)[:5]
    flagged = D.retention(rows, 5, [])
    assert flagged.count() == rows.count()
    assert sorted(((r["mtime"], r["path"]) for r in flagged.where("not archive").collect()), reverse=True) == newest
    plan = flagged._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" in plan[plan.index("Window [") :]  # only rows that tie with the n-th newest are numbered
    odd = spark.createDataFrame([(3, "a"), (3, "b"), (2, "c"), (2, "c"), (2, "c"), (1, None), (None, "x"), (None, None)], "mtime int, path string")
    for n, kept in ((0, 0), (1, 1), (2, 2), (3, 3), (4, 4), (6, 6), (7, 7), (8, 8), (20, 8)):
        out = D.retention(odd, n, [])
        assert (out.count(), out.where("not archive").count()) == (8, kept), n
        want = sorted([(3, "b"), (3, "a"), (2, "c"), (2, "c"), (2, "c"), (1, None), (None, "x"), (None, None)][:n], key=str)
        assert sorted([(r["mtime"], r["path"]) for r in out.where("not archive").collect()], key=str) == want


def test_snapshot_json_arrays_are_bounded(spark):
    import json

    from shelfwise.plans import catalog

    part = spark.range(5500).selectExpr("id AS p_partkey", "concat('n', id) AS p_name", "'hot' AS p_brand", "1 AS p_size", "'t' AS p_type")
    rows = spark.sql(catalog._ARRAY, part=part).collect()
    sizes = [len(json.loads(r["value"])) for r in rows]
    assert sum(sizes) == 5500 and max(sizes) <= 1000


def test_snapshot_json_query_returns_all_parts(spark, sf_dir):
    from shelfwise.plans import catalog

    found = catalog.queries()["read_snapshot_json"](spark, sf_dir)
    want = spark.read.parquet(f"{sf_dir}/part.parquet").selectExpr("p_name || ' ' || p_partkey AS name", "string(p_size) AS price", "p_type AS frame")
    assert found.exceptAll(want).isEmpty() and want.exceptAll(found).isEmpty()


def test_small_tables_are_dealt_out_before_costly_work(spark, sf_dir):
    from shelfwise.plans import catalog

    table = spark.read.parquet(f"{sf_dir}/part.parquet")
    assert table.rdd.getNumPartitions() == 1
    wanted = 4 * spark.sparkContext.defaultParallelism
    dealt = IO.dealt(table)
    assert dealt.rdd.getNumPartitions() == wanted and dealt.count() == table.count()
    assert IO.dealt(dealt).rdd.getNumPartitions() == wanted
    rows = catalog.queries()["enrich_specs"](spark, sf_dir)
    assert rows.select(F.spark_partition_id().alias("p")).distinct().count() > spark.sparkContext.defaultParallelism


def test_spec_dl_parses_each_page_once(spark):
    n = spark.sparkContext.accumulator(0)

    def seen(rows):
        for r in rows:
            n.add(1)
            yield r

    html = "<table><tr><td>Rem</td><td>Old</td></tr></table><dl><dt>Rem</dt><dd>Hydraulic</dd></dl><table><tr><td>Rem</td><td>New</td></tr><tr><td>Frame</td><td>Steel</td></tr></table>"
    pages = spark.createDataFrame(spark.sparkContext.parallelize([(i, html) for i in range(30)], 3).mapPartitions(seen), "page_id long, html string")
    found = H.extract_spec_dl(H.extract_blocks(pages, ["table", "dl"])).collect()
    assert sorted(map(tuple, found)) == sorted((i, k, v) for i in range(30) for k, v in (("Rem", "Hydraulic"), ("Frame", "Steel")))
    assert n.value == 30


def test_json_arrays_of_a_brand_share_a_file(spark, tmp_path):
    import json

    from shelfwise.plans import catalog

    part = spark.range(150_000).selectExpr("id AS p_partkey", "concat('n', id) AS p_name", "if(id % 3 = 0, 'a', 'b') AS p_brand", "1 AS p_size", "'t' AS p_type")
    arrays = spark.sql(catalog._ARRAY, part=part).withColumn("ranges", F.expr("part_range div 100"))
    IO.write_json_arrays(arrays.repartition(7), f"{tmp_path}/j", ["brand", "ranges"], "part_range")
    files = list((tmp_path / "j").glob("brand=*/ranges=*/part-*"))
    assert len(files) == 4  # 300 arrays
    found = {f.parent.parent.name + f.parent.name: json.loads(f.read_text()) for f in files}
    assert sum(map(len, found.values())) == 150_000
    assert {int(r["name"].split()[1]) // 1000 for r in found["brand=aranges=1"]} == set(range(100, 150))
    assert [int(r["name"].split()[1]) // 1000 for r in found["brand=branges=0"]] == sorted(int(r["name"].split()[1]) // 1000 for r in found["brand=branges=0"])
