"""Mixing sources to target weights: Efraimidis-Spirakis order, complete epochs first, then a prefix of the order.

Every document gets the key -ln(u) / quality with u a keyed hash of its id and text: in ascending order of keys this is
a weighted sample without replacement. Targets share a total by source weights, capped at `max_epochs` times a source's size; the excess
goes to the other sources by weight (water-filling, solved in closed form on the table of sources). A source first repeats
all its documents floor(target / size) times; the rest of its target is a budget that documents take in key order, the
one at the boundary with the words that are left. Prefix sums go in two steps: over slices of the key range of a source, cut at
quantiles of its keys so that they are even for every quality, then in the slices, so no task sees a whole source.

Cases: null text has size 0 and quality of its own like an empty text; null source is a source, the last; rows of one id
(null too) have keys of their own by their texts; repeated rows are separate documents with one key; an empty table, and a total of 0, take
nothing; other columns are ignored, and kept by `repeat_documents`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from shelfwise.llm.common import ROW_KEY, WORD, constant, cut, row_key, table

#: Rows a slice of a source is planned for, and the least and largest number of slices of a source that has several.
SLICE_ROWS, MIN_SLICES, MAX_SLICES = 4096, 64, 4096
MAX_EPOCHS = 3


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def quality_weight(text: Column) -> Column:
    """A weight from 0.05 to 1: the share of characters that are not markup signs, to the fourth power."""
    n = F.char_length(text)
    clean = F.char_length(F.translate(text, "#$%&*!|<>{}[]\\~^_=", ""))
    return F.when(n > 0, F.greatest(F.lit(0.05), F.pow(clean / n, F.lit(4.0)))).otherwise(0.05)


def order_key(id_col: Column, weight: Column, seed: int, text: Column | None = None) -> Column:
    """-ln(u) / weight; u comes from the first 13 hexadecimal digits of an MD5 of id, seed and text, so SQL engines agree on it."""
    named = F.concat_ws(":", F.coalesce(id_col.cast("string"), F.lit("null")), F.lit(str(seed)), F.lit("") if text is None else text)
    u = (F.conv(F.substring(F.md5(named.cast("binary")), 1, 13), 16, 10).cast("double") + 0.5) / F.lit(float(1 << 52))
    return -F.log(u) / weight


def source_targets(sizes: DataFrame, total: Column | None = None, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """(source, source_size, weight, target) from (source, source_size): one row a source, so one task holds them."""
    w = Window.partitionBy(F.lit(0))
    ranked = sizes.withColumn("place", F.row_number().over(w.orderBy(F.col("source").asc_nulls_last())))
    ranked = ranked.withColumn("weight", ((F.col("place") - 1) % 3 + 1).cast("long")).withColumn("cap", F.lit(max_epochs) * F.col("source_size"))
    ranked = ranked.withColumn("total", (total if total is not None else F.sum("source_size").over(w)).cast("long"))
    level = w.orderBy((F.col("cap") / F.col("weight")).asc(), "place").rowsBetween(Window.unboundedPreceding, -1)
    ranked = ranked.withColumn("full", F.coalesce(F.sum("cap").over(level), F.lit(0))).withColumn("left", F.sum("weight").over(w) - F.coalesce(F.sum("weight").over(level), F.lit(0)))
    # The water level if exactly the sources before this one are full; it is right at the first source that it doesn't fill.
    ranked = ranked.withColumn("try", (F.col("total") - F.col("full")) / F.col("left"))
    fits = F.when(F.col("try") * F.col("weight") <= F.col("cap"), F.struct(F.col("cap") / F.col("weight"), F.col("place"), F.col("try").alias("level")))
    ranked = ranked.withColumn("level", F.min(fits).over(w)["level"])
    target = F.least(F.col("cap").cast("double"), F.coalesce(F.col("level") * F.col("weight"), F.col("cap").cast("double")))
    return ranked.select("source", "source_size", "weight", target.alias("target"))


def with_slices(rows: DataFrame, sizes: DataFrame) -> DataFrame:
    """`rows` with their slice: how many of the quantiles of their source's order keys they are past, found by halving steps.

    A source of at most SLICE_ROWS rows is one slice; one of up to MIN_SLICES times as many has MIN_SLICES, a larger one as many as the largest source needs, at
    most MAX_SLICES. Quantiles are so a small part of the rows, but grow with them: they are joined by source, and Spark sends them to all tasks only
    below its own limit of size.
    """
    most = sizes.agg(F.max("n")).first()[0] or 0
    large = min(MAX_SLICES, max(MIN_SLICES, -(-most // SLICE_ROWS)))
    big = sizes.where(F.col("n") > SLICE_ROWS).select(F.col("source").alias("_source"), (F.col("n") > MIN_SLICES * SLICE_ROWS).alias("_large"))
    shares = lambda n: constant([i / n for i in range(1, n)], "array<double>")
    keyed = rows.select("source", "order_key").join(big, F.col("source").eqNullSafe(F.col("_source")))
    cuts = keyed.groupBy("_source").agg(
        F.percentile_approx(F.when(~F.col("_large"), F.col("order_key")), shares(MIN_SLICES), 10 * MIN_SLICES).alias("few"),
        F.percentile_approx(F.when(F.col("_large"), F.col("order_key")), shares(large), max(10_000, 10 * large)).alias("many"),
    )
    cuts = cuts.select("_source", F.array_distinct(F.coalesce("few", "many")).alias("_cuts"))
    steps = F.array(*[F.lit(1 << b) for b in reversed(range(MAX_SLICES.bit_length()))])
    past = lambda at, step: (at + step <= F.size("_cuts")) & (F.get("_cuts", at + step - 1) < F.col("order_key"))
    place = F.aggregate(steps, F.lit(0), lambda at, step: F.when(past(at, step), at + step).otherwise(at))
    return rows.join(cuts, F.col("source").eqNullSafe(F.col("_source")), "left").withColumn("slice", place).drop("_source", "_cuts")


def mix(docs: DataFrame, seed: int = 42, max_epochs: int = MAX_EPOCHS, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", quality: Column | None = None, extra: tuple[str, ...] = ()) -> DataFrame:
    """(id, source, size, source_size, target, epochs, order_key, taken, and the columns `extra`) for every row; taken counts repeats."""
    text = F.col(text_col)
    weight = quality if quality is not None else quality_weight(F.coalesce(text, F.lit("")))
    rows = docs.select(
        F.col(id_col).alias("id"),
        F.col(source_col).alias("source"),
        n_words(text).alias("size"),
        F.coalesce(order_key(F.col(id_col), weight, seed, F.coalesce(text, F.lit(""))), F.lit(0.0)).alias("order_key"),
        F.xxhash64(text).alias("tie"),
        *extra,
    )
    rows = cut(rows)
    sizes = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n"))
    targets = source_targets(sizes.select("source", "source_size"), max_epochs=max_epochs)
    rows = with_slices(rows, sizes)
    by_slice = rows.groupBy("source", "slice").agg(F.sum("size").alias("slice_size"))
    before = Window.partitionBy("source").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    by_slice = by_slice.withColumn("slice_start", F.coalesce(F.sum("slice_size").over(before), F.lit(0)))
    by_slice = by_slice.alias("s").join(targets.alias("t"), F.col("s.source").eqNullSafe(F.col("t.source"))).select("s.source", "s.slice", "slice_start", "source_size", "target")
    joined = rows.alias("r").join(by_slice.alias("s"), F.col("r.source").eqNullSafe(F.col("s.source")) & (F.col("r.slice") == F.col("s.slice")))
    joined = joined.select("id", "r.source", "r.slice", "size", "order_key", "tie", "slice_start", "source_size", "target", *extra)
    inside = Window.partitionBy("source", "slice").orderBy("order_key", "id", "tie").rowsBetween(Window.unboundedPreceding, -1)
    start = F.col("slice_start") + F.coalesce(F.sum("size").over(inside), F.lit(0))
    epochs = F.when(F.col("source_size") > 0, F.least(F.lit(max_epochs), F.floor(F.col("target") / F.col("source_size")))).otherwise(0).cast("long")
    out = joined.withColumn("start", start).withColumn("epochs", epochs)
    budget = F.round(F.col("target")).cast("long") - F.col("epochs") * F.col("source_size")
    part = F.least(F.col("size"), F.greatest(F.lit(0), budget - F.col("start")))
    return out.select("id", "source", "size", "source_size", "target", "epochs", "order_key", (F.col("epochs") * F.col("size") + part).alias("taken"), *extra)


def repeat_documents(docs: DataFrame, **options) -> DataFrame:
    """The mix as documents: each whole row of `docs` as often as it is taken, the boundary document rounded.

    The mix itself works on ids and row keys; a second read of `docs` fetches the rows taken, so a text is shuffled once. Rows equal in
    every column are combined before that shuffle and come as often as all of them together are taken.
    """
    keyed = docs.withColumns(row_key(*docs.columns))
    mixed = mix(keyed, extra=tuple(ROW_KEY), **options)
    copies = F.when(F.col("size") > 0, F.floor(F.col("taken") / F.col("size") + 0.5)).otherwise(F.greatest(F.col("epochs"), F.lit(1))).cast("int")
    counts = mixed.groupBy(*ROW_KEY).agg(F.sum(copies).cast("int").alias("__mix_copies")).where("__mix_copies > 0")
    joined = keyed.dropDuplicates(ROW_KEY).join(counts, ROW_KEY)
    return joined.withColumn("__mix_copy", F.explode(F.sequence(F.lit(1), F.col("__mix_copies")))).select(*docs.columns)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mix(table(spark, sf_dir, "documents"))
    return out.select(F.col("id").alias("doc_id"), "size", "source_size", "target", "taken")


SQL = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         coalesce(text, '') AS t
  FROM documents
), k AS (
  SELECT doc_id, source, size,
         -ln((('0x' || substr(md5(coalesce(doc_id::VARCHAR, 'null') || ':42:' || t), 1, 13))::BIGINT::DOUBLE + 0.5) / 4503599627370496.0)
         / CASE WHEN length(t) > 0 THEN greatest(0.05, pow(length(translate(t, '#$%&*!|<>{}[]\~^_=', '')) / length(t)::DOUBLE, 4.0)) ELSE 0.05 END AS key
  FROM d
), s AS (
  SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS place FROM d GROUP BY source
), r AS (
  SELECT *, (place - 1) % 3 + 1 AS weight, 3 * source_size AS cap, sum(source_size) OVER () AS total FROM s
), f AS (
  SELECT *, coalesce(sum(cap) OVER (ORDER BY cap / weight::DOUBLE, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS filled,
         sum(weight) OVER () - coalesce(sum(weight) OVER (ORDER BY cap / weight::DOUBLE, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS remaining
  FROM r
), l AS (
  SELECT *, (total - filled)::DOUBLE / remaining::DOUBLE AS attempt FROM f
), v AS (
  SELECT arg_min(attempt, (cap / weight::DOUBLE, place)) AS level FROM l WHERE attempt * weight <= cap
), t AS (
  SELECT source, source_size, least(cap::DOUBLE, coalesce(level * weight, cap::DOUBLE)) AS target FROM l LEFT JOIN v ON true
), o AS (
  SELECT k.doc_id, k.size, t.source_size, t.target,
         CASE WHEN t.source_size > 0 THEN least(3, floor(t.target / t.source_size))::BIGINT ELSE 0 END AS epochs,
         coalesce(sum(k.size) OVER (PARTITION BY k.source ORDER BY k.key, k.doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start
  FROM k JOIN t ON k.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size, source_size, target,
       (epochs * size + least(size, greatest(0, round(target)::BIGINT - epochs * source_size - start)))::BIGINT AS taken
FROM o
"""
