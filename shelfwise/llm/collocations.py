r"""Phrase collocations: n-grams counted by an FM-index per shard over word ids, summed over shards, scored and made maximal.

A task reads its documents into shards, one for each language, of at most SHARD_WORDS word ids in all; 0 stands between pieces. The index of a
shard holds suffixes in the order of their first `depth` words, made by backward steps: the words in front of the rows of an
order (its Burrows-Wheeler column), sorted stably, give the order one word deeper, which is the LF mapping of every interval at once. An interval extends
to the left by the symbols of its column and the LF mapping, and to the right by the symbols that follow, whose rows are neighbours in
the order. All n-grams up to `depth` words are enumerated so, with their counts; Spark adds up the counts of all shards by
language and phrase. A shard sends a phrase once, so a frequent phrase costs no more than others.

Phrases under `min_count` can be no part of a result: a part of a phrase occurs at least as often as the phrase. So words and pairs are counted
first, and a phrase of k > 2 words is sent only if both its parts of k - 1 words may be frequent by a Bloom filter of those that are. The filter has
at most FILTER_BITS bits, whatever the corpus; once it is full it lets more phrases through, which costs rows but changes no
result. What is frequent is written to the checkpoint folder; candidates, their cuts, what longer candidates hold, and ranks are equi-joins, sums and a tournament over it: no language
is sorted whole, each round keeps the best rows of bounded parts. Scores are exact, as decimals of 38 digits: up to a count of 1e16.

Cases: null texts count as empty, a null language as `und`; empty texts have no words; a piece longer than a shard is cut into shards that overlap by depth - 1
words, so that every n-gram is counted once; repeated rows count again; ids are not read; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable, Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from shelfwise.llm.common import cut, table
from shelfwise.llm.words import stable_order

#: Words of a candidate at most, its least count, rows for each language, and the share (in hundredths) of a phrase that makes it part of a longer one.
MAX_WORDS, MIN_COUNT, TOP, INSIDE = 3, 10, 2000, 50
#: Words of the shards of a task together, bytes cut into words together, and rows of one part of the tournament.
SHARD_WORDS, BLOCK_BYTES, PART_ROWS = 1 << 20, 1 << 22, 100_000
#: Rows that are sent to Spark together.
BATCH_ROWS = 1 << 15
#: Most bits of a filter, bits for each phrase in it, probes, and bytes of a block that tasks send.
FILTER_BITS, FILTER_RATE, PROBES, FILTER_BLOCK = 1 << 29, 16, 4, 1 << 13
#: A byte that no UTF-8 text holds stands for the end of a piece.
_END = b"\xff"
_FOLD = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ.,;:!?\n\x0b\x0c\r\t", b"abcdefghijklmnopqrstuvwxyz" + _END * 10 + b" ")


class FMIndex:
    """Suffixes of word ids (0: a gap) in the order of their first `depth` words, with the column of the words in front of them."""

    def __init__(self, ids: np.ndarray, depth: int = MAX_WORDS):
        self.depth = depth
        # A gap at either end, so that every word has a neighbour on both sides.
        self.ids = np.concatenate([[0], ids, np.zeros(depth, np.int64)])
        #: starts[w]: the first row of word w; rows of one word are neighbours, in the order of what follows them.
        self.starts = np.concatenate([[0], np.cumsum(np.bincount(self.ids))])
        suffix = np.arange(len(self.ids))
        for _ in range(depth):
            suffix = self._back(suffix)
        self.suffix = suffix

    @cached_property
    def before(self) -> np.ndarray:
        """The word in front of every row."""
        return self.ids[self.suffix - 1]

    @cached_property
    def lf(self) -> np.ndarray:
        """The row of the suffix that is one word longer, for every row."""
        order = stable_order(self.before)
        out = np.empty(len(order), np.int64)
        out[order] = np.arange(len(order))
        return out

    def _back(self, suffix: np.ndarray) -> np.ndarray:
        """The order one word deeper: all rows step back by one word, sorted by it."""
        return (suffix[stable_order(self.ids[suffix - 1])] - 1) % len(self.ids)

    def left(self, lo: int, hi: int) -> dict[int, tuple[int, int]]:
        """The words in front of the rows lo to hi, each with the rows of what it and they begin."""
        found: dict[int, list[int]] = defaultdict(list)
        for word, row in zip(self.before[lo:hi].tolist(), self.lf[lo:hi].tolist()):
            found[word].append(row)
        return {w: (min(rows), max(rows) + 1) for w, rows in found.items() if w}

    def right(self, lo: int, hi: int, n: int) -> dict[int, tuple[int, int]]:
        """The words behind the first n (fewer than depth) of the rows lo to hi, each with the rows of what they and it begin."""
        follow = self.ids[(self.suffix[lo:hi] + n) % len(self.ids)]
        cuts = [lo, *(np.flatnonzero(np.diff(follow)) + lo + 1).tolist(), hi]
        return {int(follow[a - lo]): (a, b) for a, b in zip(cuts, cuts[1:]) if a < b and follow[a - lo]}

    def grams(self, first: int, least: int = 1) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For n = least to depth: (ids of the n words, count) of all n-grams that begin at one of the first `first` words, by extending all intervals to the right."""
        rows = self.suffix[self.starts[1] :] if len(self.starts) > 1 else self.suffix[:0]
        rows = rows[rows <= first]
        new = np.zeros(len(rows), bool)
        new[:1] = True
        whole = np.ones(len(rows), bool)
        for n in range(self.depth):
            word = self.ids[rows + n]
            new[1:] |= word[1:] != word[:-1]
            whole &= word > 0
            if n + 1 < least:
                continue
            bounds = np.flatnonzero(new)
            counts = np.diff(np.append(bounds, len(rows)))
            kept = whole[bounds]
            yield self.ids[rows[bounds[kept]][:, None] + np.arange(n + 1)], counts[kept]


def gram_keys(lang: str, hashes: np.ndarray) -> np.ndarray:
    """64-bit keys of phrases in a language from the hashes of their words (rows of uint64)."""
    key = np.full(len(hashes), xxhash.xxh64_intdigest(lang), np.uint64)
    for k in range(hashes.shape[1]):
        key = (key ^ hashes[:, k]) * np.uint64(0x9E3779B97F4A7C15)
        key ^= key >> np.uint64(29)
    return key


def probes(keys: np.ndarray, bits: int) -> Iterator[np.ndarray]:
    """Places of every key in a filter of `bits` (a power of two) bits."""
    step = (keys >> np.uint64(32)) | np.uint64(1)
    for j in range(PROBES):
        yield ((keys + np.uint64(j) * step) & np.uint64(bits - 1)).astype(np.int64)


def in_filter(keys: np.ndarray, bits: np.ndarray) -> np.ndarray:
    """Whether each key may be in the filter."""
    out = np.ones(len(keys), bool)
    for at in probes(keys, len(bits) * 8):
        out &= (bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1 > 0
    return out


def phrase_filter(phrases: DataFrame, bits: int) -> np.ndarray:
    """A Bloom filter of (lang, phrase) as bytes: tasks send the blocks they touch, which are joined by block; bits / 8 bytes reach the driver."""

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mine = np.zeros(bits // 8, np.uint8)
        for batch in batches:
            by_lang: dict[str, list[list[int]]] = defaultdict(list)
            for lang, phrase in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                by_lang[lang].append([xxhash.xxh64_intdigest(w) for w in phrase.split(" ")])
            for lang, hashes in by_lang.items():
                for at in probes(gram_keys(lang, np.array(hashes, np.uint64)), bits):
                    np.bitwise_or.at(mine, at >> 3, np.left_shift(1, at & 7).astype(np.uint8))
        blocks = mine.reshape(-1, min(FILTER_BLOCK, len(mine)))
        touched = np.flatnonzero(blocks.any(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(touched), pa.array([blocks[i].tobytes() for i in touched], pa.binary())], names=["block", "bits"])

    def joined(group: pa.Table) -> pa.Table:
        whole = np.bitwise_or.reduce([np.frombuffer(x, np.uint8) for x in group.column("bits").to_pylist()])
        return pa.table({"block": group.column("block")[:1], "bits": pa.array([whole.tobytes()], pa.binary())})

    schema, out = "block long, bits binary", np.zeros(bits // 8, np.uint8)
    size = min(FILTER_BLOCK, len(out))
    for r in phrases.select("lang", "phrase").mapInArrow(part, schema).groupBy("block").applyInArrow(joined, schema).collect():
        out[r["block"] * size : (r["block"] + 1) * size] = np.frombuffer(r["bits"], np.uint8)
    return out


class Shards:
    """Word ids of the texts of a task, by language; counts phrases of `least` to `depth` words, the longest only where the filter has its parts."""

    def __init__(self, depth: int, size: int = SHARD_WORDS, least: int = 1, bits: np.ndarray | None = None):
        self.depth, self.size, self.least, self.bits = depth, size, least, bits
        self.waiting: dict[str, list[bytes]] = defaultdict(list)
        self.bytes: dict[str, int] = defaultdict(int)
        self._empty()

    def _empty(self) -> None:
        self.number: defaultdict[bytes, int] = defaultdict()
        self.number.default_factory = self.number.__len__
        self.number[_END] = 0
        self.ids: dict[str, list[np.ndarray]] = defaultdict(list)
        self.total = 0

    def add(self, lang: str, text: bytes) -> Iterator[pa.RecordBatch]:
        """Take a text; gives the counts of shards that are full."""
        at = 0
        while at < len(text):
            # A long text goes in blocks that end at a space.
            to = len(text) if len(text) - at <= BLOCK_BYTES else text.find(b" ", at + BLOCK_BYTES)
            block = text[at : to if to >= 0 else len(text)]
            at += len(block)
            self.waiting[lang] += [block] if at < len(text) else [block, _END]
            self.bytes[lang] += len(block)
            if self.bytes[lang] >= BLOCK_BYTES:
                self._read(lang)
                if self.total >= self.size:
                    yield from self.flush()

    def _read(self, lang: str) -> None:
        words = b"".join(self.waiting.pop(lang, [])).translate(_FOLD).replace(_END, b" \xff ").split(b" ")
        self.bytes.pop(lang, None)
        ids = np.fromiter(map(self.number.__getitem__, filter(None, words)), np.int64)
        if len(ids):
            self.ids[lang].append(ids)
            self.total += len(ids)

    def flush(self) -> Iterator[pa.RecordBatch]:
        for lang in list(self.waiting):
            self._read(lang)
        listed = [b"", *list(self.number)[1:]]
        words = pa.array(listed, pa.binary()).cast(pa.string())
        hashes = None if self.bits is None else np.array([xxhash.xxh64_intdigest(w) for w in listed], np.uint64)
        for lang, parts in self.ids.items():
            ids = np.concatenate(parts)
            for at in range(0, len(ids), self.size):
                yield from self._count(lang, words, hashes, ids[at : at + self.size + self.depth - 1])
        self._empty()

    def _count(self, lang: str, words: pa.Array, hashes: np.ndarray | None, ids: np.ndarray) -> Iterator[pa.RecordBatch]:
        frequent = None
        if hashes is not None:
            frequent = lambda g: in_filter(gram_keys(lang, hashes[g]), self.bits)
            ids = self._thinned(ids, frequent)
        # Words are numbered anew in this shard, so that the keys of the index are as small as they can be.
        used, own = np.unique(np.append(ids, 0), return_inverse=True)
        if self.least == 1:
            yield self._batch(lang, pa.array([""]), pa.array([int((ids[: self.size] > 0).sum())], pa.int64()))
        for grams, counts in FMIndex(own[:-1], self.depth).grams(self.size, self.least):
            grams = used[grams]
            if frequent is not None:
                kept = frequent(grams[:, :-1]) & frequent(grams[:, 1:])
                grams, counts = grams[kept], counts[kept]
            columns = [words.take(pa.array(grams[:, k])) for k in range(grams.shape[1])]
            whole = self._batch(lang, columns[0] if len(columns) == 1 else pc.binary_join_element_wise(*columns, " "), pa.array(counts, pa.int64()))
            yield from (whole.slice(i, BATCH_ROWS) for i in range(0, len(whole), BATCH_ROWS))

    def _thinned(self, ids: np.ndarray, frequent: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
        """The ids with gaps for the words that stand in no frequent stretch of depth - 1 words."""
        n = self.depth - 1
        at = np.arange(max(len(ids) - n + 1, 0))
        there = frequent(ids[at[:, None] + np.arange(n)])
        used = np.zeros(len(ids), bool)
        for k in range(n):
            used[k : k + len(there)] |= there
        return np.where(used, ids, 0)

    def _batch(self, lang: str, phrase: pa.Array, n: pa.Array) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.repeat(pa.scalar(lang, pa.string()), len(n)), phrase, n], names=["lang", "phrase", "n"])


def shard_counts(docs: DataFrame, depth: int, min_count: int, shard_words: int, least: int = 1, bits: np.ndarray | None = None) -> DataFrame:
    """(lang, phrase, f) of the phrases of `least` to `depth` words over all shards of (lang, text), from min_count occurrences on."""
    sent = None if bits is None else docs.sparkSession.sparkContext.broadcast(bits)

    def batch(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shards = Shards(depth, shard_words, least, None if sent is None else sent.value)
        for part in parts:
            for lang, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                if text:
                    yield from shards.add(lang, text)
        yield from shards.flush()

    # A shard sends a phrase once: to add up before the shuffle would fill memory and save nothing, so rows are dealt out first.
    counted = docs.mapInArrow(batch, "lang string, phrase string, n long").repartition("lang", "phrase").groupBy("lang", "phrase").agg(F.sum("n").alias("f"))
    return cut(counted.where((F.col("f") >= min_count) | (F.col("phrase") == "")))


def ngram_counts(docs: DataFrame, max_words: int = MAX_WORDS, min_count: int = MIN_COUNT, text_col: str = "text", lang_col: str = "lang", shard_words: int = SHARD_WORDS) -> DataFrame:
    """(lang, phrase, f) of all n-grams up to max_words that occur min_count times in their language; the phrase `` has the number of all words."""
    given = docs.select(F.coalesce(F.col(f"`{lang_col}`"), F.lit("und")).alias("lang"), F.col(f"`{text_col}`").cast("binary").alias("text"))
    last = found = shard_counts(given, min(2, max_words), min_count, shard_words)
    for depth in range(3, max_words + 1):
        parts = last.where(F.size(F.split("phrase", " ")) == depth - 1)
        bits = 1 << max(16, int(FILTER_RATE * parts.count()).bit_length())
        last = shard_counts(given, depth, min_count, shard_words, depth, phrase_filter(parts, min(bits, FILTER_BITS)))
        found = found.unionByName(last)
    return found


def best_of_each(df: DataFrame, by: str, order: list, n: int, rows: int, part_rows: int = PART_ROWS) -> DataFrame:
    """The first n rows of each `by` with their rank; `rows` is how many there are, or more.

    A tournament: rows are dealt into parts of about part_rows, each keeps its first n, until one part a group is left.
    """
    parts = -(-rows // part_rows)
    while parts > 1:
        salted = df.withColumn("__part", F.pmod(F.xxhash64(*df.columns), F.lit(parts)))
        df = salted.withColumn("__place", F.row_number().over(Window.partitionBy(by, "__part").orderBy(*order))).where(F.col("__place") <= n).drop("__part", "__place")
        parts = 1 if parts * n <= part_rows else -(-parts * n // part_rows)
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(by).orderBy(*order)).cast("long")).where(F.col("rank") <= n)


def collocations(docs: DataFrame, max_words: int = MAX_WORDS, min_count: int = MIN_COUNT, top: int = TOP, inside: int = INSIDE, **options) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the phrases of 2 to max_words words that score best in their language."""
    f = ngram_counts(docs, max_words, min_count, **options)
    totals = f.where("phrase = ''").select("lang", F.col("f").alias("n"))
    f = f.where("phrase <> ''")
    candidates = f.withColumn("w", F.split("phrase", " ")).where(F.size("w") > 1).withColumnRenamed("f", "a")
    cuts = F.transform(F.sequence(F.lit(1), F.size("w") - 1), lambda k: F.struct(k.alias("k"), F.array_join(F.slice("w", F.lit(1), k), " ").alias("head"), F.array_join(F.slice("w", k + 1, F.size("w") - k), " ").alias("tail")))
    halves = candidates.select("lang", "phrase", "a", F.explode(cuts).alias("x")).select("lang", "phrase", "a", "x.*")
    for part, count in (("head", "l"), ("tail", "r")):
        halves = halves.join(f.select("lang", F.col("phrase").alias(part), F.col("f").alias(count)), ["lang", part])
    exact = lambda c: F.col(c).cast("decimal(19,0)")
    halves = halves.withColumn("up", (exact("a") * exact("a") * F.lit(1000000).cast("decimal(7,0)")).cast("decimal(38,0)")).withColumn("down", (exact("l") * exact("r")).cast("decimal(38,0)"))
    scored = halves.withColumn("score", F.expr("up div down")).groupBy("lang", "phrase").agg(F.first("a").alias("a"), F.min(F.struct("score", "k", "l", "r")).alias("best"))
    # Every stretch of a longer candidate, with the largest count of those that hold it.
    spans = F.flatten(F.transform(F.sequence(F.lit(2), F.size("w") - 1), lambda m: F.transform(F.sequence(F.lit(1), F.size("w") - m + 1), lambda i: F.array_join(F.slice("w", i, m), " "))))
    held = candidates.where(F.size("w") > 2).select("lang", "a", F.explode(F.array_distinct(spans)).alias("phrase")).groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    left = scored.join(held, ["lang", "phrase"], "left").where(~F.coalesce(100 * F.col("longer") >= inside * F.col("a"), F.lit(False)))
    rows = cut(left.select("lang", "phrase", "a", F.col("best.l").alias("l"), F.col("best.r").alias("r"), F.col("best.score").alias("score")))
    ranked = best_of_each(rows, "lang", [F.desc("score"), F.desc("a"), F.asc("phrase")], top, rows.count())
    return ranked.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"))


SQL = r"""
WITH piece AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS p FROM documents
), worded AS (
  SELECT lang, regexp_extract_all(p, '[^\x20\x09]+') AS w FROM piece
), gram AS (
  SELECT lang, len(w[i:i+k-1]) AS k, array_to_string(w[i:i+k-1], ' ') AS phrase
  FROM (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM worded, (VALUES (1), (2), (3)) v(k))
), f AS (
  SELECT lang, k, phrase, string_split(phrase, ' ') AS w, count(*) AS f FROM gram GROUP BY lang, k, phrase HAVING count(*) >= 10
), total AS (
  SELECT lang, sum(len(w))::BIGINT AS n FROM worded GROUP BY lang
), cuts AS (
  SELECT lang, phrase, f AS a, unnest(range(1, k)) AS c, w, k FROM f WHERE k > 1
), scored AS (
  SELECT u.lang, u.phrase, u.a, u.c, l.f AS l, r.f AS r, (1000000::HUGEINT * u.a * u.a) // (l.f::HUGEINT * r.f) AS score
  FROM cuts u JOIN f l ON l.lang = u.lang AND l.phrase = array_to_string(u.w[1:u.c], ' ') JOIN f r ON r.lang = u.lang AND r.phrase = array_to_string(u.w[u.c + 1:u.k], ' ')
), best AS (
  SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, c) AS place FROM scored
), held AS (
  SELECT lang, phrase, max(f) AS longer FROM (SELECT lang, f, array_to_string(w[i:i + 1], ' ') AS phrase FROM f, (VALUES (1), (2)) v(i) WHERE k = 3) GROUP BY lang, phrase
), ranked AS (
  SELECT b.lang, row_number() OVER (PARTITION BY b.lang ORDER BY score DESC, a DESC, b.phrase) AS rank, b.phrase, a, l, r, score::BIGINT AS score
  FROM best b LEFT JOIN held h ON h.lang = b.lang AND h.phrase = b.phrase WHERE place = 1 AND NOT coalesce(100 * longer >= 50 * a, false)
)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN total USING (lang) WHERE rank <= 2000
"""
