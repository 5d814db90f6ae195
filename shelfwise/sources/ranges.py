"""Records that go over line breaks, read from byte ranges of a file by many tasks.

Spark's text source gives every byte range (split) its chunks in order: pieces of the file up to a separator. Whether a chunk begins inside
quotes depends on everything before it, so a first pass works out, for each split, what it does to either state it may begin in; these
functions are composed along each file (a row a split), which gives the state at every split's start. The second pass cuts each split into
records. A record that crosses splits comes as one piece from each, and the pieces are joined by file. Splits that begin a
file need no entry, so what is sent to tasks is a few bytes for each further split of large files.

Cases: records over more than two splits; unclosed records at the end of a file are given back as pieces, one a split, not joined; empty files give
nothing; compressed files are one split. If Spark cuts the files otherwise in the second pass than in the first, the job fails.
"""

from __future__ import annotations

import csv
import re
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


class QuotedLines:
    """CSV with doubled quotes: chunks are lines, a record ends with the line that leaves no quoted field open. Quotes inside a field that doesn't
    begin with one are letters; after a closing quote a field goes on to the next comma."""

    separator, joint, starts = "\n", "\n", True

    @staticmethod
    def step(line: str, inside: bool) -> tuple[bool, int]:
        """Whether a quoted field is open after the line, and 0."""
        if not inside and '"' not in line:
            return False, 0
        at = 0
        while True:
            if inside:
                at = line.find('"', at)
                while at >= 0 and line.startswith('"', at + 1):
                    at = line.find('"', at + 2)
                if at < 0:
                    return True, 0
            elif line.startswith('"', at):
                inside, at = True, at + 1
                continue
            inside, at = False, line.find(",", at) + 1
            if not at:
                return False, 0

    @staticmethod
    def text(chunk: str, last: bool) -> str:
        return chunk


class JsonObjects:
    """Objects of a JSON array, or one after the other: chunks end at "}", a record ends where no object and no string is open."""

    separator, joint, starts = "}", "", False
    _STRING = re.compile(r'"(?:[^"\\]|\\.)*+"', re.DOTALL)
    _REST = re.compile(r'(?:[^"\\]|\\.)*+"', re.DOTALL)

    @classmethod
    def step(cls, chunk: str, inside: bool) -> tuple[bool, int]:
        """Whether a string is open after the chunk and its "}", and by how many the open objects grow."""
        at = 0
        if inside:
            if not (m := cls._REST.match(chunk)):
                return True, 0
            at = m.end()
        plain = cls._STRING.sub("", chunk[at:])
        open_at = plain.find('"')
        if open_at >= 0:
            return True, plain.count("{", 0, open_at) - plain.count("}", 0, open_at)
        return False, plain.count("{") - plain.count("}") - 1

    @staticmethod
    def text(chunk: str, last: bool) -> str:
        return chunk if last else chunk + "}"


Format = type[QuotedLines] | type[JsonObjects]


class Start(NamedTuple):
    """State at a split's start, whether its last chunk, the file's last, has no separator, and the CRC-32 of the file's first record."""

    inside: bool
    depth: int
    bare: bool
    head: int


def chunks(spark: SparkSession, path: str | list[str], form: Format) -> DataFrame:
    """(file, start, size, value): the chunks of every split, in order."""
    return _chunks(spark, path, form)


def _chunks(spark: SparkSession, path: str | list[str], form: Format, cut_files: bool = False) -> DataFrame:
    """`chunks`; with `cut_files` only those of files that have more than one split."""
    m = F.col("_metadata")
    rows = spark.read.option("lineSep", form.separator).text(path)
    rows = rows.where(m["file_block_length"] < m["file_size"]) if cut_files else rows
    return rows.select(m["file_path"].alias("file"), m["file_block_start"].alias("start"), m["file_size"].alias("size"), F.col("value"))


def _splits(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple[str, int, int], list[str]]]:
    """((file, start, size), chunks) for stretches of chunks of one split, in order."""
    for batch in batches:
        files, starts, sizes, values = (c.to_pylist() for c in batch.columns)
        a = 0
        for b in range(1, len(values) + 1):
            if b == len(values) or starts[b] != starts[a] or files[b] != files[a]:
                yield (files[a], starts[a], sizes[a]), values[a:b]
                a = b


def first_record(lines: list[str], form: Format) -> str | None:
    inside, depth = False, 0
    for i, line in enumerate(lines):
        inside, grown = form.step(line, inside)
        depth += grown
        if not inside and depth <= 0:
            return form.joint.join(form.text(x, False) for x in lines[: i + 1])
    return None


def survey(rows: DataFrame, form: Format) -> DataFrame:
    """(file, start, inside, depth, bare, head) of every split: the state it begins in, and the first record of its file."""

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[tuple[str, int, int], list] = {}
        heads: dict[str, list[str]] = {}
        for key, values in _splits(batches):
            # Bytes, and for either state at the start: the state now and the objects opened.
            s = seen.setdefault(key, [0, False, 0, True, 0])
            for v in values:
                s[0] += len(v.encode()) + 1
                s[1], d = form.step(v, s[1])
                s[2] += d
                s[3], d = form.step(v, s[3])
                s[4] += d
            head = heads.setdefault(key[0], [])
            if form.starts and key[1] == 0 and (not head or first_record(head, form) is None):
                head += values[:1000]
        found = [(*k, *s, first_record(heads[k[0]], form) if form.starts and k[1] == 0 else None) for k, s in seen.items()]
        if found:
            yield pa.RecordBatch.from_pandas(pd.DataFrame(found, columns=[f.name for f in summary]), schema=summary, preserve_index=False)

    def along(part: pd.DataFrame) -> pd.DataFrame:
        out, inside, depth = [], False, 0
        total, size = int(part["bytes"].sum()), int(part["size"].iloc[0])
        ordered = part.sort_values("start")
        for i, r in enumerate(ordered.itertuples()):
            out.append((r.file, r.start, inside, depth, i == len(part) - 1 and total > size, ordered["head"].iloc[0]))
            inside, depth = (r.end_in, depth + r.grown_in) if inside else (r.end_out, depth + r.grown_out)
        return pd.DataFrame(out, columns=["file", "start", "inside", "depth", "bare", "head"])

    summary = pa.schema([("file", pa.string()), ("start", pa.int64()), ("size", pa.int64()), ("bytes", pa.int64()), ("end_out", pa.bool_()), ("grown_out", pa.int64()), ("end_in", pa.bool_()), ("grown_in", pa.int64()), ("head", pa.string())])
    totals = rows.mapInArrow(part, "file string, start long, size long, bytes long, end_out boolean, grown_out long, end_in boolean, grown_in long, head string")
    return totals.groupBy("file").applyInPandas(along, "file string, start long, inside boolean, depth long, bare boolean, head string")


#: What a piece is: a whole record, the beginning of one, its end, or something between.
WHOLE, BEGINS, ENDS, BETWEEN = range(4)


def pieces(rows: DataFrame, form: Format, known: dict[tuple[str, int], Start]) -> DataFrame:
    """(file, start, number, kind, head, text): the records and pieces of records of every split, numbered in it; head names the first of the file."""
    schema = pa.schema([("file", pa.string()), ("start", pa.int64()), ("number", pa.int64()), ("kind", pa.int32()), ("head", pa.int64()), ("text", pa.string())])

    def cut(key: tuple[str, int, int], values: Iterator[str]) -> Iterator[tuple]:
        file, start, size = key
        if start and (file, start) not in known:
            raise RuntimeError(f"{file} was cut otherwise in the first pass; no split began at {start}")
        inside, depth, bare, head = known.get((file, start), Start(False, 0, False, 0))
        going, held, number, total, waiting = inside or depth > 0, [], 0, 0, None

        def take(chunk: str, last: bool) -> Iterator[tuple]:
            nonlocal inside, depth, going, held, number, head
            inside, grown = form.step(chunk, inside)
            depth = max(depth + grown + last * (not inside) * (form is JsonObjects), 0)
            held.append(form.text(chunk, last))
            if not inside and depth == 0:
                text = form.joint.join(held)
                head = zlib.crc32(text.encode()) if start == number == 0 else head
                yield file, start, number, ENDS if going else WHOLE, head, text
                going, held, number = False, [], number + 1

        for v in values:
            total += len(v.encode()) + 1
            if waiting is not None:
                yield from take(waiting, False)
            waiting = v
        if waiting is not None:
            yield from take(waiting, bare or (not start and total > size))
        if held:
            yield file, start, number, BETWEEN if going else BEGINS, head, form.joint.join(held)

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stretches, out = _splits(batches), []
        ahead = next(stretches, None)
        while ahead is not None:
            key = ahead[0]

            def of_split() -> Iterator[str]:
                nonlocal ahead
                while ahead is not None and ahead[0] == key:  # noqa: B023
                    values, ahead = ahead[1], None
                    yield from values
                    ahead = next(stretches, None)

            for row in cut(key, of_split()):
                out.append(row)
                if len(out) == 4096:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)
                    out = []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)

    return rows.mapInArrow(part, "file string, start long, number long, kind int, head long, text string")


#: Different first records that the files of one read may have.
MAX_HEADS = 1000


class Records(NamedTuple):
    """(file, start, number, head, text) of all records; pieces of records without an end; the different first records by their CRC-32, in the order of files."""

    whole: DataFrame
    unclosed: DataFrame
    heads: dict[int, str]


def read_records(spark: SparkSession, path: str | list[str], form: Format) -> Records:
    """Both passes. The first runs now; a row for each split that doesn't begin a file, and the different first records, come to the driver."""
    rows = chunks(spark, path, form)
    # Where nothing is asked of a file's first record, files of one split need no survey: nothing precedes their split.
    found = survey(rows if form.starts else _chunks(spark, path, form, cut_files=True), form).persist()
    crc = lambda text: zlib.crc32(text.encode()) if text is not None else 0
    known = {(r["file"], r["start"]): Start(r["inside"], r["depth"], r["bare"], crc(r["head"])) for r in found.where("start > 0").toLocalIterator()}
    heads = [r["head"] for r in found.where("start = 0").groupBy("head").agg(F.min("file").alias("file")).orderBy("file").limit(MAX_HEADS + 1).collect()] if form.starts else []
    found.unpersist()
    if len(heads) > MAX_HEADS or None in heads:
        raise ValueError(f"more than {MAX_HEADS} different headers" if None not in heads else "a file's first record is longer than its first split or has no end")
    cut = pieces(rows, form, known)
    columns = ["file", "start", "number", "head", "text"]
    whole = cut.where(F.col("kind") == WHOLE).select(columns)
    edges = cut.where(F.col("kind") != WHOLE)
    by_crc = {crc(h): h for h in heads}
    if not known:
        return Records(whole, edges.select(columns), by_crc)
    # At most two rows a split: the pieces of a record stand between a beginning and an end, in the order of splits.
    along = Window.partitionBy("file").orderBy("start", "number")
    edges = edges.withColumn("record", F.sum((F.col("kind") == BEGINS).cast("long")).over(along))
    ended = edges.withColumn("closed", F.max(F.col("kind") == ENDS).over(Window.partitionBy("file", "record")))
    parts = ended.where("closed").groupBy("file", "record").agg(F.array_sort(F.collect_list(F.struct("start", "number", "head", "text"))).alias("p"))
    first = F.col("p")[0]
    joined = parts.select("file", first["start"].alias("start"), first["number"].alias("number"), first["head"].alias("head"), F.array_join(F.transform("p", lambda x: x["text"]), form.joint).alias("text"))
    return Records(whole.unionByName(joined), ended.where(~F.col("closed")).select(columns), by_crc)


class Tables(NamedTuple):
    """Rows that could be read, and (file, start, number, reason, text) of what could not: the place of its split and its number there."""

    rows: DataFrame
    bad: DataFrame


def _bad(df: DataFrame, reason: str) -> DataFrame:
    return df.select("file", "start", "number", F.lit(reason).alias("reason"), "text")


def names_of(head: str) -> list[str]:
    """Column names of a header record: empty ones are named by their place, and it is added to repeated ones."""
    found = next(csv.reader([head.removeprefix("\ufeff").rstrip("\r")]), [])
    again = {n for n in found if found.count(n) > 1}
    return [f"_c{i}" if not n else f"{n}{i}" if n in again else n for i, n in enumerate(found)]


def _parse_csv(found: Records) -> tuple[DataFrame, Column]:
    """(parsed, long): records without the headers, with a struct of fields for each header, and whether a record has more fields than its header."""
    # A file whose header ends in CR LF has such line ends, in fields too; elsewhere CR is a letter.
    windows = F.col("head").isin([crc for crc, h in found.heads.items() if h.endswith("\r")])
    text = F.when(windows, F.regexp_replace(F.replace("text", F.lit("\r\n"), F.lit("\n")), "\r$", "")).otherwise(F.col("text"))
    data = found.whole.where(~((F.col("start") == 0) & (F.col("number") == 0))).withColumn("text", text).where("text <> ''")
    options = {"escape": '"', "columnNameOfCorruptRecord": "__wrong"}
    parsed = data
    for crc, head in found.heads.items():
        fields = ", ".join(f"c{i} string" for i in range(len(names_of(head))))
        parsed = parsed.withColumn(f"v{crc}", F.when(F.col("head") == crc, F.from_csv("text", f"{fields}, __wrong string", options)))
    # Quoted fields are taken out before commas are counted; only records with another number of fields than the header come to that.
    n_fields = F.size(F.split(F.regexp_replace("text", r'(^|,)"(?:[^"]|"")*+"', "$1"), ","))
    long = F.lit(False)
    for crc, head in found.heads.items():
        long = long | F.coalesce(F.col(f"v{crc}.__wrong").isNotNull() & (n_fields > len(names_of(head))), F.lit(False))
    return parsed, long


def read_csv(spark: SparkSession, path: str | list[str], file_column: str | None = None, columns: list[str] | None = None) -> Tables:
    """Quoted CSV with line breaks in fields, as text columns. Each file has its header; columns that a file doesn't have are null.

    Short records are filled with nulls; records with more fields than their header, and what follows a quote that is never closed, are bad.
    Empty lines are skipped, unquoted empty fields are null; partition folders give no columns. With `file_column` the first column names the file.
    Columns are those of the headers in the order of files, or `columns`, whatever files have them.
    """
    found = read_records(spark, path, QuotedLines)
    columns = list(dict.fromkeys(n for h in found.heads.values() for n in names_of(h))) if columns is None else columns
    parsed, long = _parse_csv(found)
    null = F.lit(None).cast("string")
    value = {n: F.coalesce(null, *[F.col(f"v{crc}.c{names_of(h).index(n)}") for crc, h in found.heads.items() if n in names_of(h)]) for n in columns}
    file = [F.col("file").alias(file_column)] if file_column else []
    rows = parsed.where(~long).select(*file, *[value[n].alias(n) for n in columns]) if columns else spark.createDataFrame([], "struct<>")
    return Tables(rows, _bad(parsed.where(long), "more fields than the header").unionByName(_bad(found.unclosed, "quote without an end")))


def csv_sizes(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(file, n_rows, n_cols, n_bad, columns) of every file that has more than a header: records that can be read, columns of its header, records that can't
    be, names of its columns."""
    found = read_records(spark, path, QuotedLines)
    parsed, long = _parse_csv(found)
    seen = parsed.select("file", "head", long.alias("bad")).unionByName(found.unclosed.select("file", "head", F.lit(True).alias("bad")))
    sizes = seen.groupBy("file").agg(F.count_if(~F.col("bad")).alias("n_rows"), F.count_if("bad").alias("n_bad"), F.max("head").alias("head"))
    names = F.array().cast("array<string>")
    for crc, head in found.heads.items():
        names = F.when(F.col("head") == crc, F.array(*map(F.lit, names_of(head)))).otherwise(names)
    return sizes.select("file", "n_rows", F.size(names).cast("long").alias("n_cols"), "n_bad", names.alias("columns"))


def read_json_objects(spark: SparkSession, path: str | list[str], schema=None) -> Tables:
    """The objects of JSON array files (or of files with one object after the other): columns by `schema`, or one VARIANT column `record` without.

    Bad are objects that are no JSON (or, with a schema, don't fit it), values that are no objects, and objects without an end.
    """
    found = read_records(spark, path, JsonObjects)
    between = F.regexp_extract("text", r'^((?:[^"{]|"(?:[^"\\]|\\.)*+")*+)', 1)
    split = found.whole.withColumn("before", between).withColumn("text", F.expr("substring(text, length(before) + 1)"))
    other = split.withColumn("text", F.regexp_replace("before", r"^[\s,\[\]\x{FEFF}]+|[\s,\[\]}]+$", "")).where("text <> ''")
    objects = split.where("text <> ''")
    if schema is None:
        objects = objects.withColumn("record", F.try_parse_json("text"))
        wrong, rows = F.col("record").isNull(), objects.where("record is not null").select("record")
    else:
        typed = T.StructType([*schema.fields, T.StructField("__wrong", T.StringType())])
        objects = objects.withColumn("record", F.from_json("text", typed, {"columnNameOfCorruptRecord": "__wrong"}))
        wrong, rows = F.col("record.__wrong").isNotNull(), objects.where("record.__wrong is null").select(*[F.col(f"record.`{f.name}`").alias(f.name) for f in schema.fields])
    bad = _bad(objects.where(wrong), "no JSON of this form").unionByName(_bad(other, "no object")).unionByName(_bad(found.unclosed, "object without an end"))
    return Tables(rows, bad)
