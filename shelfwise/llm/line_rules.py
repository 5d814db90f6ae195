r"""Quality rules: statistics of a text, and cross-document line frequency.

Lines are normalised (lower case A-Z, every digit 0, white space one space) and hashed. For every host, the distinct texts that hold a line are
counted; lines in more than `max_docs` texts of a host are removed there, and a text that keeps fewer than `min_words` words, or less than
`min_share` of its words, is depleted and rejected, as is one that fails the base rules. The host is the source where documents have no address.
Copies of a whole text count as one document: they are the work of near-dedup, and must not remove each other's lines.

One pass in Python gives a row of counts and line hashes for each document, written once to the checkpoint folder. Counting goes over
(host, line, text) rows: made distinct, counted by partial sums, so a line that is everywhere costs no more than others. Removal joins lines with the
frequent ones by shuffle on (host, line), which adaptive execution splits where one line is hot; nothing is broadcast by hand. Hosts, lines and
texts are named by 64-bit hashes; lines are compared within a host only: with 3e10 lines in one and 1e7 frequent ones, the chance that any line
is removed for another one's hash is about 2 %.

Cases: null texts count as empty, and fail the base rules like all short ones; null sources are one host; repeated rows each get a row
and count as one text; lines without a word are no lines; very long texts are read whole; an empty table gives no rows; `clean` keeps other columns,
`judge` ignores them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfwise.llm import words as W
from shelfwise.llm.common import cut, table

#: Most distinct texts of a host that may hold a line, least words that a text must keep, and least share of its words.
MAX_DOCS, MIN_WORDS, MIN_SHARE = 10, 50, 0.5
_SYMBOLS, _SPACE = b"#*$%&|<>", b" \t\n\x0b\x0c\r"
_NORMAL = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ123456789", b"abcdefghijklmnopqrstuvwxyz000000000")
_LINES = pa.list_(pa.struct([("line", pa.int64()), ("words", pa.int32())]))
_COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def line_hash(line: bytes) -> int:
    """Signed 64-bit hash of a line without white space at its ends and between words more than one."""
    return int(np.uint64(xxhash.xxh64_intdigest(line)).astype(np.int64))


def lines_of(text: bytes) -> dict[int, int]:
    """Hash of every distinct normalised line -> words in all its occurrences."""
    found: dict[int, int] = {}
    for line in text.translate(_NORMAL).split(b"\n"):
        if own := line.split():
            key = line_hash(b" ".join(own))
            found[key] = found.get(key, 0) + len(own)
    return found


def repeated_words(parts: list[list[bytes]]) -> np.ndarray:
    """Of each list of words, how many stand in a three-word window that occurs twice or more in the list."""
    ids, owner = W.numbered(parts)
    pairs = W.names(len(ids), *W.pair_places(W.word_names(ids, owner), 1))
    triples, _ = W.pair_places(pairs, 1)
    inside = np.zeros(len(ids), bool)
    for step in range(3):
        inside[triples + step] = True
    return np.bincount(owner[inside], minlength=len(parts))


def counts_of(texts: list[bytes]) -> np.ndarray:
    """A row of _COUNTS for each text."""
    out = np.zeros((len(texts), len(_COUNTS)), np.int64)
    for first, last in W.slices(texts):
        parts = [t.split() for t in texts[first:last]]
        out[first:last, 4] = repeated_words(parts)
        for i, text in enumerate(texts[first:last]):
            lines = [x for x in text.split(b"\n") if x.strip()]
            spaces = sum(text.count(bytes([b])) for b in _SPACE)
            chars = len(text) if text.isascii() else len(text.decode("utf-8", "surrogatepass"))
            out[first + i, :4] = len(parts[i]), chars - spaces, sum(text.count(bytes([b])) for b in _SYMBOLS), len(lines) - len(set(lines))
    return out


def _list(rows: list[dict[int, int]]) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum([len(r) for r in rows])]).astype(np.int32)
    line = np.fromiter((k for r in rows for k in r), np.int64, offsets[-1])
    words = np.fromiter((n for r in rows for n in r.values()), np.int32, offsets[-1])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.StructArray.from_arrays([pa.array(line), pa.array(words)], fields=list(_LINES.value_type)))


def keys(host: Column, text: Column) -> dict[str, Column]:
    """Hashes that name a host and a text."""
    return {"__host": F.xxhash64(host, host.isNull()), "__text": F.xxhash64(F.coalesce(text, F.lit("")))}


def statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source") -> DataFrame:
    """(id, host and text hashes, counts, base_failed, lines) of every row; lines are distinct hashes with their words."""

    def batch(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            texts = [x or b"" for x in part.column(3).to_pylist()]
            columns = [*part.columns[:3], *map(pa.array, np.ascontiguousarray(counts_of(texts).T)), _list([lines_of(t) for t in texts])]
            yield pa.RecordBatch.from_arrays(columns, names=["id", "__host", "__text", *_COUNTS, "lines"])

    named = keys(F.col(f"`{host_col}`"), F.col(f"`{text_col}`"))
    given = docs.select(F.col(f"`{id_col}`").alias("id"), *[c.alias(n) for n, c in named.items()], F.col(f"`{text_col}`").cast("binary").alias("text"))
    schema = f"id {given.schema['id'].dataType.simpleString()}, __host long, __text long, {', '.join(f'{c} long' for c in _COUNTS)}, lines array<struct<line: long, words: int>>"
    found = given.mapInArrow(batch, schema)
    return found.withColumn("base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))


def removed_lines(stats: DataFrame, max_docs: int = MAX_DOCS) -> DataFrame:
    """(host, text, frequent: hashes of its lines above the limit, n_removed: their words) for the texts that have such lines."""
    lines = stats.select("__host", "__text", F.explode("lines").alias("x")).select("__host", "x.line", "__text", "x.words").distinct()
    often = lines.groupBy("__host", "line").agg(F.count("*").alias("docs")).where(F.col("docs") > max_docs).drop("docs")
    gone = lines.join(often, ["__host", "line"])
    return gone.groupBy("__host", "__text").agg(F.collect_list("line").alias("frequent"), F.sum("words").alias("n_removed"))


def judge(docs: DataFrame, max_docs: int = MAX_DOCS, min_words: int = MIN_WORDS, min_share: float = MIN_SHARE, **columns: str) -> DataFrame:
    """(id, counts, base_failed, n_frequent_lines, words_left, kept) of every row."""
    stats = cut(statistics(docs, **columns))
    joined = stats.drop("lines").join(removed_lines(stats, max_docs), ["__host", "__text"], "left")
    joined = joined.withColumn("words_left", F.col("n_words") - F.coalesce("n_removed", F.lit(0)))
    enough = (F.col("words_left") >= min_words) & (F.col("words_left") >= min_share * F.col("n_words"))
    n_lines = F.coalesce(F.size("frequent"), F.lit(0)).cast("long")
    return joined.select("id", *_COUNTS, "base_failed", n_lines.alias("n_frequent_lines"), "words_left", (~F.col("base_failed") & enough).alias("kept"))


def without_lines(text: str, frequent: set[int]) -> str:
    """The text without its lines that hash to one of `frequent`."""
    hashed = lambda line: line_hash(b" ".join(line.encode("utf-8", "surrogatepass").translate(_NORMAL).split()))
    return "\n".join(line for line in text.split("\n") if hashed(line) not in frequent)


def clean(docs: DataFrame, max_docs: int = MAX_DOCS, text_col: str = "text", host_col: str = "source") -> DataFrame:
    """All rows and columns of `docs`, the text without the lines above the limit."""
    stats = cut(statistics(docs.withColumn("__id", F.lit(0)), "__id", text_col, host_col))

    def drop(texts: pd.Series, frequent: pd.Series) -> pd.Series:
        return pd.Series([t if t is None or f is None else without_lines(t, set(f)) for t, f in zip(texts, frequent)], dtype=object)

    keyed = docs.withColumns(keys(F.col(f"`{host_col}`"), F.col(f"`{text_col}`")))
    joined = keyed.join(removed_lines(stats, max_docs).drop("n_removed").withColumnRenamed("frequent", "__frequent"), ["__host", "__text"], "left")
    return joined.withColumn(text_col, F.pandas_udf(drop, "string")(F.col(f"`{text_col}`"), "__frequent")).select(*[f"`{c}`" for c in docs.columns])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


SQL = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), split AS (
  SELECT doc_id, source, t, unnest(string_split(t, chr(10))) AS line FROM d
), worded AS (
  SELECT *, array_to_string(regexp_extract_all(translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ123456789', 'abcdefghijklmnopqrstuvwxyz000000000'), '[^\x20\x09-\x0D]+'), ' ') AS normal FROM split
), lined AS (
  SELECT *, len(string_split(normal, ' ')) AS n FROM worded WHERE normal <> ''
), dup AS (
  SELECT doc_id, count(*) - count(DISTINCT line) AS n_dup_lines FROM lined GROUP BY doc_id
), often AS (
  SELECT source, normal FROM lined GROUP BY source, normal HAVING count(DISTINCT t) > 10
), gone AS (
  SELECT doc_id, count(DISTINCT l.normal) AS n_lines, sum(n) AS n FROM lined l JOIN often o ON l.source IS NOT DISTINCT FROM o.source AND l.normal = o.normal GROUP BY doc_id
), triple AS (
  SELECT doc_id, i, w[i:i+2] AS x FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM d)
), inside AS (
  SELECT DISTINCT doc_id, i + unnest([0, 1, 2]) AS i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, x) AS c FROM triple) WHERE c > 1
), again AS (
  SELECT doc_id, count(*) AS n_repeat_words FROM inside GROUP BY doc_id
), counted AS (
  SELECT doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars, (length(t) - length(translate(t, '#*$%&|<>', '')))::BIGINT AS n_symbols,
         coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words,
         coalesce(g.n_lines, 0)::BIGINT AS n_frequent_lines, (len(w) - coalesce(g.n, 0))::BIGINT AS words_left
  FROM d LEFT JOIN dup USING (doc_id) LEFT JOIN again USING (doc_id) LEFT JOIN gone g USING (doc_id)
), judged AS (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM counted
)
SELECT *, NOT base_failed AND words_left >= 50 AND words_left >= 0.5 * n_words AS kept FROM judged
"""
