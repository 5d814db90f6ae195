"""The most complete archive, from the files themselves."""

import pytest

from shelfwise.sources import files as IO


def write(folder, name, text):
    folder.mkdir(parents=True, exist_ok=True)
    (folder / name).write_text(text)


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_rows_times_columns_of_whole_files(spark, tmp_path):
    write(tmp_path, "trek_bikes_20250701_101010.csv", "name,price\na,1\nb,2\nc,3\n")
    write(tmp_path, "trek_bikes_20250702_111111.csv", 'name,price,color\n"a ""x""\nline",1,red\nb,2\n')  # 6 as well, newer
    write(tmp_path, "trek_bikes_20250703_121212.csv", "name,price,color,z\na,1,2,3\nb,1,2,3,4\n")  # a record that is too long
    write(tmp_path, "trek_bikes_20250704_131313.csv", 'name,price,color,z\na,1,2,3\nb,1,"2,3\nc,1,2,3\nd,1,2,3\n')  # a quote without an end
    write(tmp_path, "trek_bikes_20250705_141414.csv", "name,price,color,z\n")
    write(tmp_path, "trek_bikes_latest.csv", "name,price\n" + "a,1\n" * 50)
    write(tmp_path, "Canyon_bikes_20250701_101010.csv", "name\nx\n")
    scores = {(r["brand"], r["snapshot"]): r["score"] for r in IO.archive_scores(spark, str(tmp_path)).collect()}
    assert scores == {("trek", "20250701_101010"): 6, ("trek", "20250702_111111"): 6, ("canyon", "20250701_101010"): 1}
    got = IO.read_best_archives(spark, str(tmp_path)).select("brand_name", "snapshot", "snapshot_date", "name", "price", "color")
    assert rows(got) == sorted(
        [("trek", "20250702_111111", "111111", 'a "x"\nline', "1", "red"), ("trek", "20250702_111111", "111111", "b", "2", None), ("canyon", "20250701_101010", "101010", "x", None, None)], key=repr
    )
    with pytest.raises(ValueError):
        IO.read_best_archives(spark, str(tmp_path), max_brands=1)


def test_a_folder_of_part_files_is_one_snapshot(spark, tmp_path):
    for part in ("part-0.csv", "part-1.csv"):
        write(tmp_path / "trek_bikes_20250701_101010.csv", part, "name,price\na,1\nb,2\n")
    write(tmp_path / "trek_bikes_20250702_101010.csv", "part-0.csv", "name,price\na,1\nb,2\nc,3\n")
    got = IO.read_best_archives(spark, f"{tmp_path}/*")
    assert got.count() == 4 and {r["snapshot"] for r in got.collect()} == {"20250701_101010"}


def test_columns_of_snapshots_that_are_not_chosen(spark, tmp_path):
    write(tmp_path, "a_bikes_20250701_101010.csv", "name,price\nx,1\ny,2\nz,3\n")
    write(tmp_path, "a_bikes_20250702_101010.csv", "name,price,category\nx,1,c\n")
    write(tmp_path, "b_bikes_20250701_101010.csv", "name,category\nu,d\n")
    want = [("a", "20250701_101010", "101010", n, p, None) for n, p in (("x", "1"), ("y", "2"), ("z", "3"))]
    got = IO.read_best_archives(spark, f"{tmp_path}/a*")
    assert got.columns == ["brand_name", "snapshot", "snapshot_date", "name", "price", "category"]
    assert rows(got) == want
    assert rows(IO.read_best_archives(spark, str(tmp_path))) == sorted([*want, ("b", "20250701_101010", "101010", "u", None, "d")], key=repr)
    named = IO.read_best_archives(spark, str(tmp_path), columns=["category", "weight", "name"])
    assert named.columns[3:] == ["category", "weight", "name"]
    assert ("b", "20250701_101010", "101010", "d", None, "u") in rows(named)


def test_none(spark, tmp_path):
    write(tmp_path, "notes.csv", "a,b\n1,2\n")
    assert IO.read_best_archives(spark, str(tmp_path)).count() == 0
