"""First records of a stream against sessions in plain Python: shuffled, late and replayed files, and the state behind the watermark."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

from shelfwise.streaming import jobs

HOUR = 3_600_000_000
SCHEMA = "user string, ts timestamp, n long, note string, tags map<string,string>"


@pytest.fixture
def rocksdb(spark):
    before = spark.conf.get(jobs.ROCKSDB[0])
    spark.conf.set(*jobs.ROCKSDB)
    yield
    spark.conf.set(jobs.ROCKSDB[0], before)


def run(spark, folder, out, **options):
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).option("latestFirst", False).parquet(folder)
    firsts = jobs.stream_first_by_key(stream, ["user"], ord_col="n", **options)
    query = firsts.writeStream.format("parquet").option("path", f"{out}/rows").option("checkpointLocation", f"{out}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    return query.recentProgress


def at(hours):
    return datetime.datetime(2025, 1, 1, tzinfo=datetime.timezone.utc) + datetime.timedelta(seconds=round(hours * 3600))


def firsts_of(rows, keep, end):
    """Rows that no row of their user precedes by at most `keep` hours, as far as the watermark at the end has come."""
    out, last = set(), {}
    for user, hours, n, note in sorted(rows, key=lambda r: (r[1], r[2], r[3] or "")):
        if user not in last or hours - last[user] > keep:
            out.add((user, at(hours), n, note))
        last[user] = hours
    return {r for r in out if r[1] < at(end)}


def written(spark, rows, folder, files):
    for i, part in enumerate(files):
        df = spark.createDataFrame([(u, at(h), n, note, {"k": note or ""}) for u, h, n, note in part], SCHEMA)
        df.coalesce(1).write.mode("append").parquet(f"{folder}")


def test_shuffled_and_replayed_files(spark, tmp_path, rocksdb):
    rng = random.Random(2)
    rows = [(rng.choice(["a", "b", "c", None]), rng.randrange(0, 400) + rng.random(), i, rng.choice(["x", 'q"{', None])) for i in range(240)]
    rows += [("tie", 30.0, 2, "second"), ("tie", 30.0, 1, "first"), ("hot", 5.0, 0, "h")] + [("hot", 5 + i / 10, i, None) for i in range(1, 900)]
    rows.sort(key=lambda r: r[1] + rng.uniform(0, 20))  # out of order, within the delay
    files = [rows[i : i + 200] for i in range(0, len(rows), 200)]
    half, late = files[:3], files[3:]
    written(spark, rows, f"{tmp_path}/in", half)
    run(spark, f"{tmp_path}/in", f"{tmp_path}/out", delay="25 hours", keep="12 hours")
    # What was there already comes again in new files, and the stream goes on from its checkpoint.
    written(spark, rows, f"{tmp_path}/in", [[r for r in half[-1] if r[1] > max(x[1] for p in half for x in p) - 20], *late])
    progress = run(spark, f"{tmp_path}/in", f"{tmp_path}/out", delay="25 hours", keep="12 hours")
    got = spark.read.schema(SCHEMA).parquet(f"{tmp_path}/out/rows").collect()
    want = firsts_of(rows, 12, max(r[1] for r in rows) - 25)
    utc = lambda t: t.astimezone(datetime.timezone.utc)
    assert {(r["user"], utc(r["ts"]), r["n"], r["note"]) for r in got} == want and len(got) == len(want) > 20
    assert all(r["tags"] == {"k": r["note"] or ""} for r in got)
    assert progress


def test_state_falls_behind_the_watermark(spark, tmp_path, rocksdb):
    files = [[(f"u{d}_{i}", d * 24 + i / 100, i, "x") for i in range(100)] for d in range(6)] + [[("end", 24 * 30, 0, "x")], [("end", 24 * 30 + 1, 0, "x")]]
    written(spark, None, f"{tmp_path}/in", files)
    # A record older than the watermark is dropped, not a first record.
    progress = run(spark, f"{tmp_path}/in", f"{tmp_path}/out", delay="1 hour", keep="6 hours")
    sizes = [p["stateOperators"][0]["numRowsTotal"] for p in progress if p["stateOperators"]]
    assert max(sizes) >= 100 and sizes[-1] < 10, sizes
    assert spark.read.schema(SCHEMA).parquet(f"{tmp_path}/out/rows").count() in (600, 601)
    written(spark, None, f"{tmp_path}/in", [[("u0_1", 0.01, 1, "late"), ("end", 24 * 31, 1, "x")]])
    run(spark, f"{tmp_path}/in", f"{tmp_path}/out", delay="1 hour", keep="6 hours")
    assert spark.read.schema(SCHEMA).parquet(f"{tmp_path}/out/rows").where("note = 'late'").count() == 0


def test_intervals():
    rng = random.Random(1)
    for _ in range(200):
        rows = [(t := rng.randrange(60), t, rng.randrange(3), f"r{i}", False) for i in range(rng.randrange(1, 12))]
        got = []
        for r in rows:
            got = jobs.merged(got, r, 5)
        ordered, want = sorted(rows, key=lambda r: (r[0], r[2], r[3])), []
        for t, _, o, row, _ in ordered:
            if want and t - want[-1][1] <= 5:
                want[-1] = (*want[-1][:1], t, *want[-1][2:])
            else:
                want.append((t, t, o, row, False))
        assert got == want


def test_many_records_at_once_are_joined_in_one_sweep():
    rng = random.Random(3)
    for _ in range(200):
        rows = [(t := rng.randrange(60), t, rng.randrange(3), f"r{i}", False) for i in range(rng.randrange(1, 20))]
        half = len(rows) // 2
        before = [(*x[:3], None, True) if rng.random() < 0.3 else x for x in jobs.joined(rows[:half], 5)]
        one_by_one = before
        for r in rows[half:]:
            one_by_one = jobs.merged(one_by_one, r, 5)
        assert jobs.joined([*before, *rows[half:]], 5) == one_by_one


class _Handle:
    """A state and its timers in memory, counting the calls that go to the JVM."""

    def __init__(self):
        self.found, self.timers, self.calls = [], set(), 0

    def getListState(self, name, schema):
        return self

    def get(self):
        self.calls += 1
        return iter(self.found)

    def put(self, found):
        self.calls, self.found = self.calls + 1, list(found)

    def clear(self):
        self.put([])

    def registerTimer(self, at):
        self.calls += 1
        self.timers.add(at)

    def deleteTimer(self, at):
        self.calls += 1
        self.timers.remove(at)

    def listTimers(self):
        self.calls += 1
        return iter(self.timers)


def test_calls_to_the_state_do_not_follow_the_records():
    from pyspark.sql import Row

    handle, processor = _Handle(), jobs.FirstRecords(10_000_000)
    processor.init(handle)
    rows = [Row(__ts=None, __ord=i, __row=f"r{i}", __at=i * 1_000_000, __name="k") for i in range(10_000, 0, -1)]
    list(processor.handleInputRows(("k",), iter(rows), None))
    assert handle.found == [(1_000_000, 10_000_000_000, 1, "r1", False)] and handle.timers == {1001} and handle.calls == 3
    list(processor.handleInputRows(("k",), iter([Row(__ts=None, __ord=0, __row="r0", __at=500_000, __name="k")]), None))
    assert handle.found == [(500_000, 10_000_000_000, 0, "r0", False)] and handle.timers == {501} and handle.calls == 7
    list(processor.handleInputRows(("k",), iter(rows[:5]), None))
    assert handle.timers == {501} and handle.calls == 9
