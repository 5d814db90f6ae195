r"""Periodic runs: maximal stretches of words that repeat with a period, found with a dictionary of basic factors.

For every power of two, stretches of so many words (basic factors) get equal names if they are equal and stand in one text; a name is made
of two names of the level below, and what doesn't occur again is dropped, so ordinary texts are done after two or three levels. On the level of h words
the occurrences of a factor form arithmetic progressions; from each occurrence the next one, and each one at which the distance
changes, less than 2 h further on propose periods of h words or more (within a progression its other members would be multiples of a smaller
period). Neighbouring proposals of one period are one; each is extended to both sides by halving steps over the names of all levels,
and runs that are long enough are kept once.

A run is a stretch of words with least period q and at least max(min_words, 2 q) words that no neighbour continues. Words in a run after its
first q are repetitions: the collapsed text leaves them out, and joins the others by one space.

Cases: null, empty and short texts have no runs (collapsed: the words there are); very long texts are read whole, in memory that grows with their
words and, where they repeat, the logarithm of that; repeated rows each get a row; null ids are kept; an empty table gives no rows; other columns
are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfwise.llm import words as W
from shelfwise.llm.common import WORD, table

MIN_WORDS = 12


def proposals(places: np.ndarray, groups: np.ndarray, h: int) -> tuple[np.ndarray, np.ndarray]:
    """(place, period) from the occurrences of the factors of h words; periods are h to 2 h - 1."""
    step = np.where(np.diff(groups, prepend=-1) > 0, -1, np.diff(places, prepend=-1))
    step[:1] = -1
    changes = np.append(np.flatnonzero(step[1:] != step[:-1]) + 1, len(step))
    change = changes[np.searchsorted(changes, np.arange(len(step)), side="right")] if len(step) else changes
    found: list[tuple[np.ndarray, np.ndarray]] = []
    at = np.arange(len(places))
    other = at + 1
    while len(at):
        near = other < len(places)
        at, other = at[near], other[near]
        near = (groups[other] == groups[at]) & (places[other] - places[at] < 2 * h)
        at, other = at[near], other[near]
        period = places[other] - places[at]
        found.append((places[at][period >= h], period[period >= h]))
        other = change[other]
    return tuple(np.concatenate(x) for x in zip(*found)) if found else (places, places)


def firsts(at: np.ndarray, period: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Proposals without those that follow another one of the same period by one place."""
    order = np.lexsort((at, period))
    at, period = at[order], period[order]
    first = np.ones(len(at), bool)
    first[1:] = (period[1:] != period[:-1]) | (at[1:] > at[:-1] + 1)
    return at[first], period[first]


def find_runs(ids: np.ndarray, owner: np.ndarray, min_words: int = MIN_WORDS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, length, period) of all runs by start and period; `ids` are numbers of words, `owner` the texts they are in, in order."""
    levels = [W.word_names(ids, owner)]
    same = np.flatnonzero((levels[0][:-1] == levels[0][1:]) & (levels[0][:-1] >= 0))
    tried = [firsts(same, np.ones(len(same), np.int64))]
    h = 1
    while True:
        places, groups = W.pair_places(levels[-1], h)
        h *= 2
        if not len(places):
            break
        tried.append(firsts(*proposals(places, groups, h)))
        levels.append(W.names(len(ids), places, groups))
    at, period = (np.concatenate(x) for x in zip(*tried))
    left, right = at.copy(), at + period
    for named, size in [(x, 1 << k) for k, x in enumerate(levels)][::-1]:
        i = np.flatnonzero(right < len(ids))
        name = named[right[i]]
        right[i[(name >= 0) & (name == named[right[i] - period[i]])]] += size
        i = np.flatnonzero(left >= size)
        name = named[left[i] - size]
        left[i[(name >= 0) & (name == named[left[i] - size + period[i]])]] -= size
    length = right - left
    kept = length >= np.maximum(min_words, 2 * period)
    runs = np.unique(np.stack([left[kept], period[kept], length[kept]], axis=1), axis=0)
    return runs[:, 0], runs[:, 2], runs[:, 1]


def repetitions(n: int, start: np.ndarray, length: np.ndarray, period: np.ndarray) -> np.ndarray:
    """Whether each of n words stands in a run after its first period."""
    change = np.zeros(n + 1, np.int64)
    np.add.at(change, start + period, 1)
    np.add.at(change, start + length, -1)
    return np.cumsum(change)[:n] > 0


def runs_of(texts: list[bytes], min_words: int = MIN_WORDS) -> Iterator[tuple[int, list[tuple[int, int, int]], bytes]]:
    """(number of words, runs, collapsed text) of each text."""
    for first, last in W.slices(texts):
        parts = [t.split() for t in texts[first:last]]
        ids, owner = W.numbered(parts)
        start, length, period = find_runs(ids, owner, min_words) if len(ids) else (np.zeros(0, np.int64),) * 3
        ends = np.cumsum([len(p) for p in parts])
        begins = ends - [len(p) for p in parts]
        cuts = np.searchsorted(start, np.append(begins, ends[-1:]))
        again = repetitions(len(ids), start, length, period)
        for i, p in enumerate(parts):
            a, b = cuts[i], cuts[i + 1]
            own = [] if a == b else list(zip((start[a:b] - begins[i]).tolist(), length[a:b].tolist(), period[a:b].tolist()))
            kept = p if a == b else [w for w, x in zip(p, again[begins[i] : ends[i]].tolist()) if not x]
            yield len(p), own, b" ".join(kept)


_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """(id, n_words, runs: an array of (start, length, period) by start and period, collapsed) of every row."""

    def batch(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            n_words, runs, collapsed = [], [], []
            for n, own, text in runs_of([x or b"" for x in part.column(1).to_pylist()], min_words):
                n_words.append(n)
                runs.append([{"start": s, "length": m, "period": q} for s, m, q in own])
                collapsed.append(text)
            columns = [part.column(0), pa.array(n_words, pa.int64()), pa.array(runs, pa.list_(_RUN)), pa.array(collapsed, pa.binary()).cast(pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names=["id", "n_words", "runs", "collapsed"])

    id_type = docs.schema[id_col].dataType.simpleString()
    given = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("text"))
    return given.mapInArrow(batch, f"id {id_type}, n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string")


def with_repetition(id_col: Column, text: Column) -> Column:
    """The text; that of every tenth id by CRC-32 goes on from some word with a stretch of its own words again and again."""
    h = F.crc32(id_col.cast("string").cast("binary"))
    g = F.floor(h / F.lit(10))

    def edited(w: Column) -> Column:
        n = F.size(w).cast("long")
        a = g % n
        p = F.lit(1) + F.floor((n - a) / (F.lit(3) + g % 8))
        again = F.flatten(F.array_repeat(F.slice(w, (a + 1).cast("int"), p.cast("int")), F.ceil((n - a) / p).cast("int")))
        return F.array_join(F.concat(F.slice(w, F.lit(1), a.cast("int")), F.slice(again, F.lit(1), (n - a).cast("int"))), " ")

    # The words are bound to a name, so they are cut once.
    found = F.array(F.regexp_extract_all(text, F.lit(f"({WORD})"), F.lit(1)))
    return F.when((h % 10 == 0) & text.rlike(WORD), F.get(F.transform(found, edited), F.lit(0))).otherwise(text)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", with_repetition(F.col("doc_id"), F.col("text")).alias("text"))
    line = lambda r: F.concat_ws("", r["start"], F.lit(","), r["length"], F.lit(","), r["period"], F.lit("\n"))
    digest = lambda text: F.sha2(text.cast("binary"), 256)
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    out = find(docs).withColumn("best", best)
    return out.select(
        F.col("id").alias("doc_id"),
        F.size("runs").cast("long").alias("n_runs"),
        (-F.col("best.start")).alias("start"),
        F.col("best.length").alias("length"),
        (-F.col("best.period")).alias("period"),
        F.floor(F.col("best.length") * 1000 / -F.col("best.period")).cast("long").alias("exponent_milli"),
        digest(F.array_join(F.transform("runs", line), "")).alias("runs_sha256"),
        digest(F.col("collapsed")).alias("collapsed_sha256"),
    )


SQL = r"""
WITH given AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
         xor(list_reduce(list_prepend(4294967295::BIGINT, [ascii(x)::BIGINT FOR x IN string_split(doc_id::VARCHAR, '')]),
           lambda a, b: list_reduce(list_prepend(xor(a, b), [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]), lambda c, z: xor(c >> 1, (c & 1) * 3988292384))), 4294967295::BIGINT) AS h
  FROM documents
), placed AS (
  SELECT *, len(w)::BIGINT AS n, CASE WHEN h % 10 = 0 AND len(w) > 0 THEN (h // 10) % len(w) ELSE len(w) END AS a FROM given
), edited AS (
  SELECT doc_id, n, CASE WHEN a = n THEN w ELSE [w[1 + CASE WHEN i < a THEN i ELSE a + (i - a) % (1 + (n - a) // (3 + (h // 10) % 8)) END] FOR i IN range(n)] END AS w FROM placed
), word AS (
  SELECT doc_id, unnest(w) AS x, unnest(range(len(w))) AS i FROM edited
), pair AS (
  SELECT u.doc_id, v.i - u.i AS q, u.i FROM word u JOIN word v ON u.doc_id = v.doc_id AND u.x = v.x AND u.i < v.i
), island AS (
  SELECT doc_id, q, min(i) AS start, count(*) + q AS length
  FROM (SELECT *, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS isle FROM pair) GROUP BY doc_id, q, isle
), long AS (
  SELECT * FROM island WHERE length >= 2 * q
), run AS (
  -- A stretch of two periods or more has a smaller one if a run of that one holds it.
  SELECT * FROM long l WHERE length >= 12
    AND NOT EXISTS (FROM long s WHERE s.doc_id = l.doc_id AND s.q < l.q AND s.start <= l.start AND s.start + s.length >= l.start + l.length)
), summed AS (
  SELECT doc_id, count(*) AS n_runs, arg_max((start, length, q), (length, -start, -q)) AS best,
         string_agg(start || ',' || length || ',' || q || chr(10), '' ORDER BY start, q) AS lines
  FROM run GROUP BY doc_id
), gone AS (
  SELECT DISTINCT doc_id, i FROM (SELECT doc_id, unnest(range(start + q, start + length)) AS i FROM run)
), kept AS (
  SELECT doc_id, string_agg(x, ' ' ORDER BY i) AS text FROM word ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id
)
SELECT doc_id, coalesce(n_runs, 0)::BIGINT AS n_runs, best[1]::BIGINT AS start, best[2]::BIGINT AS length, best[3]::BIGINT AS period,
       (1000 * best[2] // best[3])::BIGINT AS exponent_milli, sha256(coalesce(lines, '')) AS runs_sha256, sha256(coalesce(text, '')) AS collapsed_sha256
FROM given LEFT JOIN summed USING (doc_id) LEFT JOIN kept USING (doc_id)
"""
