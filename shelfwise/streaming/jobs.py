"""Streaming forms of the batch jobs."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import islice
from typing import Any

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from shelfwise.sources.store import BucketedMaster

#: transformWithState keeps its state in RocksDB.
ROCKSDB = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
_INTERVAL = "first long, last long, ord long, row string, out boolean"


class FirstRecords(StatefulProcessor):
    """Records of a key as intervals: those at most `keep` microseconds apart are one, of which the least (time, order) record is kept.

    An interval gives its first record when the watermark has passed it, for nothing earlier can come then; it goes when the watermark
    has passed its last record by `keep`. Open intervals of a key lie within the delay, so they are few however many records it has.
    """

    def __init__(self, keep: int):
        self.keep = keep

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.state = handle, handle.getListState("intervals", _INTERVAL)

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        before = found = self._load()
        while some := list(islice(rows, AT_ONCE)):
            at, order, row = (some[0].__fields__.index(n) for n in ("__at", "__ord", "__row"))
            found = joined([*found, *[(r[at], r[at], r[order], r[row], False) for r in some]], self.keep)
        self._store(before, found)
        return iter(())

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[Row]:
        now, left, before = timerValues.getCurrentWatermarkInMs() * 1000, [], self._load()
        for first, last, order, row, out in before:
            if not out and first < now:
                yield Row(row=row)
                row, out = None, True
            if not out or last + self.keep >= now:
                left.append((first, last, order, row, out))
        self._store(before, left, fired=True)

    def close(self) -> None:
        pass

    def _load(self) -> list[tuple]:
        return [tuple(x) for x in self.state.get()]

    def _due(self, found: list[tuple]) -> int | None:
        """The one timer of a key follows from its intervals, so it need not be asked for."""
        return min((last + self.keep if out else first for first, last, _, _, out in found), default=None)

    def _store(self, before: list[tuple], found: list[tuple], fired: bool = False) -> None:
        old, new = self._due(before), self._due(found)
        if found:
            self.state.put(found)
        else:
            self.state.clear()
        if old != new:
            if old is not None and not fired:  # a fired timer is gone by itself
                self.handle.deleteTimer(old // 1000 + 1)
            if new is not None:
                self.handle.registerTimer(new // 1000 + 1)


#: Records of a key that are held in Python at a time.
AT_ONCE = 4096


def joined(intervals: list[tuple], keep: int) -> list[tuple]:
    """Intervals in one sweep by time; what is linked becomes one, with the least first record, given out if any part was."""
    found: list[tuple] = []
    for x in sorted(intervals, key=lambda x: (x[0], x[2], x[3] or "")):
        if found and x[0] <= found[-1][1] + keep:
            first, last, order, row, out = found[-1]
            out = out or x[4]
            found[-1] = (first, max(last, x[1]), order, None if out else row, out)
        else:
            found.append(x)
    return found


def merged(found: list[tuple], new: tuple, keep: int) -> list[tuple]:
    """The intervals with a new one."""
    return joined([*found, new], keep)


def stream_first_by_key(stream: DataFrame, keys: list[str], ts: str = "ts", ord_col: str | None = None, delay: str = "10 minutes", keep: str = "1 day") -> DataFrame:
    """The first whole record of each key, by time and then `ord_col`, whatever the order of arrival within the delay.

    A key is new again after `keep` without a record. A record comes out when the watermark has passed it; later records than the delay
    allows are dropped. State is dropped `keep` behind the watermark. The session needs ROCKSDB as its state store. Null keys are a key; records without
    a time are dropped; records that are equal in time and order are ordered by their JSON text.
    """
    session, names = stream.sparkSession, stream.columns
    kept = session.sql(f"SELECT CAST(date_diff(MICROSECOND, TIMESTAMP '2000-01-01', TIMESTAMP '2000-01-01' + INTERVAL '{keep}') AS BIGINT)").first()[0]
    form = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX", "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"}
    rows = stream.select(
        F.struct(*[F.col(f"`{k}`") for k in keys]).alias("__key"),
        F.col(ts).cast("timestamp").alias("__ts"),
        (F.col(ord_col) if ord_col else F.lit(0)).cast("long").alias("__ord"),
        F.to_json(F.struct(*[f"`{c}`" for c in names]), {**form, "ignoreNullFields": "false"}).alias("__row"),
    )
    timed = rows.where(F.col("__ts").isNotNull()).withColumn("__at", F.unix_micros("__ts")).withWatermark("__ts", delay)
    keyed = timed.withColumn("__name", F.to_json("__key", {"ignoreNullFields": "false"})).drop("__key")
    out = keyed.groupBy("__name").transformWithState(FirstRecords(kept), "row string", "append", "EventTime")
    return out.select(F.from_json("row", stream.schema, form).alias("r")).select(*[F.col(f"r.`{c}`").alias(c) for c in names])


def stream_master_update(spark: SparkSession, src_dir: str, base: str, schema: str, keys: list[str], as_of_col: str = "as_of", available_now: bool = True, buckets: int = 64) -> StreamingQuery:
    """Every micro-batch of snapshot files updates the bucketed master below `base`: only buckets with a key of the batch are written.

    A replayed batch changes nothing. The as-of date of a batch is the greatest in its rows.
    """
    stream = spark.readStream.schema(schema).parquet(src_dir)

    def step(batch: DataFrame, batch_id: int) -> None:
        as_of = batch.agg(F.max(as_of_col)).first()[0]
        if as_of is not None:
            BucketedMaster(batch.sparkSession, base, keys, buckets).merge(batch.drop(as_of_col), batch_id, str(as_of))

    writer = stream.writeStream.foreachBatch(step).option("checkpointLocation", f"{base}/_checkpoint")
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def latest_master(spark: SparkSession, base: str, keys: list[str] = ("brand", "name")) -> DataFrame:
    return BucketedMaster(spark, base, list(keys)).table()
