"""Tables behind a commit pointer: files are written to a folder of their own, and a small commit file says which of them are the table.

A commit file is created only if its number is free, so of two writers one gets it; readers look at whole commit files alone, so a writer that dies
leaves the version before it readable, and readers keep what they opened. Creating a file if absent is atomic on HDFS and on object stores with
conditional writes; a local file system checks first and creates then, which is enough for one writer and for tests.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from shelfwise.operators import key_filter
from shelfwise.operators.lifecycle import clean_fields, first_rows, update_master


class Store:
    """Commits below `base`/_commits, data folders below `base`/data."""

    def __init__(self, spark: SparkSession, base: str):
        self.spark, self.base = spark, base.rstrip("/")

    def _path(self, name: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.base}/{name}")
        return path, path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def numbers(self) -> list[int]:
        """Numbers of all commit files, whole or not."""
        path, fs = self._path("_commits")
        names = [s.getPath().getName() for s in fs.listStatus(path)] if fs.exists(path) else []
        return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json") and n[:-5].isdecimal())

    def read(self, number: int) -> dict | None:
        """What a commit says; None if it isn't there or was not written to its end."""
        path, fs = self._path(f"_commits/{number:020d}.json")
        if not fs.exists(path):
            return None
        stream = fs.open(path)
        try:
            found = self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        try:
            return json.loads(found) if found.endswith("\n") else None
        except json.JSONDecodeError:
            return None

    def commits(self) -> list[tuple[int, dict]]:
        return [(n, c) for n in self.numbers() if (c := self.read(n)) is not None]

    def latest(self) -> tuple[int, dict] | None:
        """The last whole commit."""
        return next(((n, c) for n in reversed(self.numbers()) if (c := self.read(n)) is not None), None)

    def commit(self, number: int, content: dict) -> bool:
        """Create commit `number`; False if another writer has it. One that was not written to its end is replaced."""
        path, fs = self._path(f"_commits/{number:020d}.json")
        if fs.exists(path):
            if self.read(number) is not None:
                return False
            fs.delete(path, False)
        try:
            stream = fs.create(path, False)
        except Exception as e:
            if "FileAlreadyExists" in str(e):
                return False
            raise
        try:
            stream.write(bytearray((json.dumps(content) + "\n").encode()))
        finally:
            stream.close()
        return True

    def append(self, content: Callable[[tuple[int, dict] | None], dict]) -> int:
        """Commit under the next free number; what other writers committed meanwhile stays."""
        while True:
            last = self.latest()
            number = (self.numbers() or [-1])[-1] + 1
            if self.commit(number, content(last)):
                return number

    def stage(self) -> str:
        """A new data folder, relative to the base."""
        return f"data/{uuid.uuid4().hex}"

    def vacuum(self, keep: set[str]) -> list[str]:
        """Delete data folders that are not in `keep`; for times without writers and readers of old versions."""
        path, fs = self._path("data")
        found = [s.getPath().getName() for s in fs.listStatus(path)] if fs.exists(path) else []
        gone = [n for n in found if f"data/{n}" not in keep]
        for n in gone:
            fs.delete(self._path(f"data/{n}")[0], True)
        return gone


def write_version(df: DataFrame, base: str, ts: str) -> int:
    """Write df as the version of time stamp ts; it is there for readers at once, when all of it is written."""
    store = Store(df.sparkSession, base)
    folder = store.stage()
    df.write.parquet(f"{store.base}/{folder}")
    return store.append(lambda _: {"ts": ts, "folder": folder})


def read_version(spark: SparkSession, base: str, ts: str | None = None) -> DataFrame:
    """The version of ts, or of the greatest time stamp; of several with one time stamp the last committed. Opens no other version."""
    store = Store(spark, base)
    found = [(c["ts"], n, c["folder"]) for n, c in store.commits() if ts is None or c["ts"] == ts]
    if not found:
        raise FileNotFoundError(f"no version{'' if ts is None else ' ' + ts} below {base}")
    return spark.read.parquet(f"{store.base}/{max(found)[2]}")


class BucketedMaster:
    """A master table in hash buckets of its keys; a commit names the folder of each bucket.

    A batch is a whole snapshot: a row that it has is Available, or New if the master doesn't know its key; all other rows are Discontinued. These are
    not written again: rows keep the number of the first and last batch that had them, and the commit the number and date of the newest, so
    status and dates follow when the table is read. A batch so writes the buckets of its keys only.

    Rows with a null key drop out. Of rows of one key in a batch the least by `order` (or, without one, by all their columns) counts.
    """

    def __init__(self, spark: SparkSession, base: str, keys: list[str], buckets: int = 64, order: str | None = None):
        self.store, self.spark, self.keys, self.order = Store(spark, base), spark, keys, order
        last = self.store.latest()
        self.buckets = last[1]["n_buckets"] if last else buckets

    def merge(self, batch: DataFrame, number: int, as_of: str) -> bool:
        """Add snapshot `number`, newer than all before; False if it is there already. Numbers must grow by batch."""
        last = self.store.latest()
        if last and last[0] >= number:
            return False
        folders = dict(last[1]["folders"]) if last else {}
        rows = first_rows(batch, self.keys, self.order)
        columns = [c for c in rows.columns if c not in self.keys]
        rows = clean_fields(rows, skip=self.keys).withColumn("__bucket", F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int"))
        touched = [str(r[0]) for r in rows.select("__bucket").distinct().collect()]
        if not touched:
            return False
        old = [folders[b] for b in touched if b in folders]
        today = F.date_format(F.to_date(F.lit(as_of)), "dd-MM-yyyy")
        new = rows.withColumns({"__first": F.lit(number).cast("long"), "__last": F.lit(number).cast("long"), "first_seen_date": today, "last_seen_date": today})
        if old:
            known = self._read(old)
            kept = [c for c in known.columns if c not in (*self.keys, "__first", "__last", "first_seen_date", "last_seen_date", "__bucket")]
            a, b = new.withColumn("__new", F.lit(True)).alias("a"), known.withColumn("__old", F.lit(True)).alias("b")
            joined = a.join(b, self.keys, "full")
            here = F.col("a.__new").isNotNull()
            side = lambda c: F.when(here, F.col(f"a.`{c}`") if c in columns else F.lit(None)).otherwise(F.col(f"b.`{c}`") if c in kept else F.lit(None))
            new = joined.select(
                *self.keys,
                *[side(c).alias(c) for c in dict.fromkeys([*kept, *columns])],
                F.coalesce("b.__first", "a.__first").alias("__first"),
                F.coalesce("a.__last", "b.__last").alias("__last"),
                F.coalesce("b.first_seen_date", "a.first_seen_date").alias("first_seen_date"),
                F.coalesce("a.last_seen_date", "b.last_seen_date").alias("last_seen_date"),
                F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int").alias("__bucket"),
            )
        folder = self.store.stage()
        new.repartition(F.col("__bucket")).withColumn("bucket", F.col("__bucket")).drop("__bucket").write.partitionBy("bucket").parquet(f"{self.store.base}/{folder}")
        folders |= {b: f"{folder}/bucket={b}" for b in touched}
        return self.store.commit(number, {"as_of": as_of, "n_buckets": self.buckets, "folders": folders})

    def _read(self, folders: list[str]) -> DataFrame:
        return self.spark.read.option("mergeSchema", True).parquet(*[f"{self.store.base}/{f}" for f in folders])

    def table(self) -> DataFrame:
        """The master after the last batch, with status, first_seen_date, last_seen_date and last_updated."""
        last = self.store.latest()
        if last is None:
            raise FileNotFoundError(f"no master below {self.store.base}")
        number, content = last
        rows = self._read(list(content["folders"].values()))
        status = F.when(F.col("__last") < number, "Discontinued").when(F.col("__first") == number, "New").otherwise("Available")
        plain = [c for c in rows.columns if c not in ("__first", "__last", "first_seen_date", "last_seen_date")]
        return rows.select(*[f"`{c}`" for c in plain], status.alias("status"), "first_seen_date", "last_seen_date", F.lit(content["as_of"]).alias("last_updated"))


def write_bucketed(df: DataFrame, base: str, keys: list[str], buckets: int, ts: str, number: int | None = None, more: dict | None = None) -> int | None:
    """Write df, one row a key, in buckets of the keys and commit it as `number` (default: the next free one); None if another writer has that number.

    Rows that lie in partitions of the same keys and count (as after a join with such a table) go to one file a bucket without a shuffle.
    """
    store, name = Store(df.sparkSession, base), f"bucketed_{uuid.uuid4().hex}"
    folder = store.stage()
    df.write.format("parquet").bucketBy(buckets, *keys).sortBy(*keys).option("path", f"{store.base}/{folder}").saveAsTable(name)
    df.sparkSession.sql(f"DROP TABLE {name}")  # the files stay: tables with a path are external
    content = {"ts": ts, "folder": folder, "keys": keys, "buckets": buckets, "schema": df.schema.json(), **(more or {})}
    if number is None:
        return store.append(lambda _: content)
    return number if store.commit(number, content) else None


def read_bucketed(spark: SparkSession, base: str) -> tuple[DataFrame, int, dict]:
    """The last committed table, known to Spark as bucketed, with its commit."""
    last = Store(spark, base).latest()
    if last is None:
        raise FileNotFoundError(f"no bucketed table below {base}")
    number, content = last
    name, path = f"bucketed_{uuid.uuid4().hex}", f"{base.rstrip('/')}/{content['folder']}"
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in StructType.fromJson(json.loads(content["schema"])))
    keys = ", ".join(f"`{k}`" for k in content["keys"])
    spark.sql(f"CREATE TABLE {name} ({fields}) USING parquet CLUSTERED BY ({keys}) SORTED BY ({keys}) INTO {content['buckets']} BUCKETS LOCATION '{path}'")
    df = spark.table(name)
    df.schema  # noqa: B018 (resolved before the name goes)
    spark.sql(f"DROP TABLE {name}")
    return df, number, content


def _write_filter(words: DataFrame, base: str) -> str:
    store = Store(words.sparkSession, base)
    folder = store.stage()
    words.write.parquet(f"{store.base}/{folder}")
    return folder


def read_filter(spark: SparkSession, base: str) -> tuple[DataFrame, int]:
    """The Bloom filter of the last committed master's keys, and its number of words."""
    last = Store(spark, base).latest()
    if last is None or "filter" not in last[1]:
        raise FileNotFoundError(f"no filter below {base}")
    return spark.read.schema("word long, mask long").parquet(f"{base.rstrip('/')}/{last[1]['filter']}"), last[1]["filter_words"]


def start_master(master: DataFrame, base: str, keys: list[str], buckets: int, ts: str, filter_words: int | None = None) -> int:
    """The first bucketed master, its first row of each key; with `filter_words`, a Bloom filter of its keys is kept with it."""
    more = {}
    if filter_words is not None:
        more = {"filter": _write_filter(key_filter.key_filter(master, keys, filter_words), base), "filter_words": filter_words}
    return write_bucketed(first_rows(master, keys, "ord" if "ord" in master.columns else None), base, keys, buckets, ts, more=more)


def roll_master(current: DataFrame, archive: DataFrame, base: str, as_of: str, prefer_master_dates: bool = False) -> int:
    """The master of the next day from a bucketed one: its rows are read and written bucket by bucket, never shuffled; raises if another writer was first.

    A filter that is kept with it gets the day's keys; keys never leave a master, so the old ones are not read for it.
    """
    spark, more = current.sparkSession, {}
    master, number, content = read_bucketed(spark, base)
    keys = content["keys"]
    if "filter" in content:
        n = content["filter_words"]
        day = key_filter.key_filter(current.select(*keys).unionByName(archive.select(*keys)), keys, n)
        old = spark.read.schema("word long, mask long").parquet(f"{base.rstrip('/')}/{content['filter']}")
        more = {"filter": _write_filter(key_filter.merge_filters(old, day), base), "filter_words": n}
    new = update_master(current, archive, master, keys, as_of, prefer_master_dates, content["buckets"])
    done = write_bucketed(new, base, keys, content["buckets"], as_of, number + 1, more)
    if done is None:
        raise RuntimeError(f"commit {number + 1} below {base} was made by another writer")
    return done
