"""A Bloom filter of a large side's keys, kept with it as a table of 64-bit words; what it lets through goes to the exact join, so results stay exact.

A key sets BITS bits of one word, so a filter is one aggregate with `bit_or`, two filters are merged by another, and a test is a look-up of one word. Filters
have at most MAX_WORDS words (32 MB; the proven bound of what is broadcast). With 16 bits a key about one key in a hundred passes wrongly; a fuller filter
lets more through, which costs rows and never results.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BITS = 5
MAX_WORDS = 1 << 21


def words_for(keys: int, bits_per_key: int = 16) -> int:
    """Words for that many keys: a power of two, at most MAX_WORDS."""
    return min(MAX_WORDS, 1 << max(0, (keys * bits_per_key // 64 - 1).bit_length()))


def _spot(keys: list[str], words: int) -> dict[str, Column]:
    """The word of a key, and its bits in there: five six-bit numbers of a second hash."""
    h = F.xxhash64(F.lit(11), *keys)
    bits = [F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftrightunsigned(h, 6 * i).bitwiseAND(63).cast("int")) for i in range(BITS)]
    return {"__word": F.pmod(F.xxhash64(F.lit(7), *keys), F.lit(words)), "__mask": reduce(lambda a, b: a.bitwiseOR(b), bits)}


def _known(keys: list[str]) -> Column:
    return reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in keys])


def key_filter(df: DataFrame, keys: list[str], words: int) -> DataFrame:
    """(word, mask) of all keys without nulls; at most `words` rows leave a task."""
    spots = df.where(_known(keys)).select(*[v.alias(k) for k, v in _spot(keys, words).items()])
    return spots.groupBy(F.col("__word").alias("word")).agg(F.bit_or("__mask").alias("mask"))


def merge_filters(a: DataFrame, b: DataFrame) -> DataFrame:
    """The filter of the keys of both; they must have the same number of words."""
    return a.unionByName(b).groupBy("word").agg(F.bit_or("mask").alias("mask"))


def _tested(df: DataFrame, words: DataFrame, keys: list[str], n_words: int, how: str) -> DataFrame:
    if n_words > MAX_WORDS:
        raise ValueError(f"a filter has at most {MAX_WORDS} words")
    spots = df.where(_known(keys)).withColumns(_spot(keys, n_words))
    hit = (F.col("__word") == F.col("word")) & (F.col("__mask").bitwiseAND(F.col("mask")) == F.col("__mask"))
    return spots.join(F.broadcast(words), hit, how).drop("__word", "__mask")


def may_contain(df: DataFrame, words: DataFrame, keys: list[str], n_words: int) -> DataFrame:
    """Rows whose key may be in the filter; all whose key is in it. Rows with a null key drop out."""
    return _tested(df, words, keys, n_words, "left_semi")


def certainly_new(df: DataFrame, words: DataFrame, keys: list[str], n_words: int) -> DataFrame:
    """Rows whose key is not in the filter. Rows with a null key drop out."""
    return _tested(df, words, keys, n_words, "left_anti")


def known_names(current: DataFrame, master: DataFrame, keys: list[str], words: DataFrame, n_words: int) -> DataFrame:
    """Distinct keys of current that the master has; only those that pass the filter of its keys are shuffled."""
    return may_contain(current.select(*keys), words, keys, n_words).distinct().join(master.select(*keys), keys, "left_semi")


def new_names(current: DataFrame, master: DataFrame, keys: list[str], words: DataFrame, n_words: int) -> DataFrame:
    """Distinct keys of current that the master lacks: what fails the filter is new at once, the rest is looked up. Rows with a null key drop out."""
    names = current.select(*keys)
    doubtful = may_contain(names, words, keys, n_words).distinct().join(master.select(*keys), keys, "left_anti")
    return certainly_new(names, words, keys, n_words).distinct().unionByName(doubtful)


def filter_quality(current: DataFrame, master: DataFrame, keys: list[str], words: DataFrame, n_words: int) -> DataFrame:
    """One row: distinct keys of current, those that pass, those that the master has, and the share of its strangers that pass wrongly."""
    names = current.select(*keys).where(_known(keys)).distinct()
    spots = names.withColumns(_spot(keys, n_words)).join(F.broadcast(words), F.col("__word") == F.col("word"), "left")
    flagged = spots.withColumn("__passes", F.coalesce(F.col("__mask").bitwiseAND(F.col("mask")) == F.col("__mask"), F.lit(False))).select(*keys, "__passes")
    found = flagged.join(master.select(*keys).distinct().withColumn("__known", F.lit(True)), keys, "left")
    known = F.count("__known")
    counted = found.agg(F.count("*").alias("names"), F.count_if("__passes").alias("passed"), known.alias("known"))
    return counted.withColumn("false_share", (F.col("passed") - F.col("known")) / F.nullif(F.col("names") - F.col("known"), F.lit(0)))
