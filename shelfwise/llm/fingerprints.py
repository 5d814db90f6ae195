r"""Document fingerprints: invertible Bloom lookup sketches of paragraph digests. DataFrame functions only.

A paragraph is a line, and a line longer than 400 characters counts as several. A document is the set of the XXH64
digests of its paragraphs. The sketch has cells in three rows; a digest falls into one cell of each row, which keeps a
count, the XOR of its digests and the XOR of their check hashes. Sketches subtract cell by cell; what is left belongs to
paragraphs that only one version has. Peeling takes the cells that hold exactly one digest, notes these, removes them
from their other cells, and goes on until all cells are empty. Where it gets stuck, the squared counts of the cells estimate the number of
differing paragraphs, and the sketches are rebuilt for that number, with other hash keys, as small sub-tables; a sub-table that
gets stuck is rebuilt four times as wide. The digests are sorted by sub-table once, so work grows in
proportion to the paragraphs (times a logarithm). After the last try, which fails about once in a hundred thousand pairs, the two digest sets
are compared directly. The first size is the stored fingerprint.

Cases: null text counts as empty and has the sketch of the empty set; two empty texts are alike (1.0), an empty and
another text are not (0.0); repeated paragraphs count once; repeated rows and ids each get a row, ordered by text hash;
null ids come first; an id that many rows share (null too) is cut at text hashes, only rows of one id and one text stay together; an empty
table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import itertools
from collections import Counter

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from shelfwise.llm.common import constant, table

PARAGRAPH = r"[^\n]{1,400}"
#: Cells in each of the three rows: of the stored sketch, of the sub-tables of a retry, and of those that got stuck.
STORED_WIDTH, RETRY_WIDTH, WIDE = 8, 16, 64
#: Differing digests that a sub-table is planned for, growth of their estimate at each retry, and rounds of peeling.
PLANNED, GROWTH, ROUNDS = 6, (1.5, 4.0), 12
_LEAST = -(1 << 63)


def digests(text: Column) -> Column:
    """The distinct paragraph digests of a text."""
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(PARAGRAPH), F.lit(0)), lambda p: F.xxhash64(p)))


# The functions from here to `retry` write SQL expressions: arguments and results are texts. A variable gets a name of its own, so that nested
# functions never hide one another's.
_numbers = itertools.count()


def over(function: str, *args: str, of: int = 1):
    """function(args, (x, y) -> body(x, y)) with `of` variables, for a body given as the next call."""

    def with_body(*bodies) -> str:
        lambdas = []
        for body in bodies:
            names = [f"x{next(_numbers)}" for _ in range(of if body is bodies[0] else 1)]
            variables = names[0] if len(names) == 1 else f"({', '.join(names)})"
            lambdas.append(f"{variables} -> {body(*names)}")
        return f"{function}({', '.join([*args, *lambdas])})"

    return with_body


def let(value: str, body) -> str:
    """body(value), with value computed once."""
    return f"element_at({over('transform', f'array({value})')(body)}, 1)"


def placed_digests(keys: str, seed: int) -> str:
    """Each digest with the hash that holds its places and its check."""
    return over("transform", keys)(lambda d: f"named_struct('k', {d}, 'g', xxhash64({d}, {seed}))")


def sketch(keys: str, seed: int, width: int) -> str:
    """Cells array<struct<n, k, h>> of a digest array: each takes the digests whose hash points to it."""
    bits = width.bit_length() - 1
    add = lambda a, x: f"named_struct('n', {a}.n + 1, 'k', {a}.k ^ {x}.k, 'h', {a}.h ^ shiftrightunsigned({x}.g, 32))"

    def row(placed: str, r: int) -> str:
        own = lambda c: over("filter", placed)(lambda x: f"(shiftright({x}.g, {bits * r}) & {width - 1}) = {c}")
        return over("transform", f"sequence(0, {width - 1})")(lambda c: over("aggregate", own(c), "named_struct('n', 0, 'k', 0L, 'h', 0L)", of=2)(add))

    return let(placed_digests(keys, seed), lambda placed: f"concat({', '.join(row(placed, r) for r in range(3))})")


def subtract(a: str, b: str) -> str:
    return over("zip_with", a, b, of=2)(lambda x, y: f"named_struct('n', {x}.n - {y}.n, 'k', {x}.k ^ {y}.k, 'h', {x}.h ^ {y}.h)")


def peel(cells: str, seed: int, width: int) -> str:
    """struct<ok, found>: the digests that the difference of two sketches holds, and whether these are all."""
    bits = width.bit_length() - 1

    def pure(now: str) -> str:
        alone = over("filter", now)(lambda c: f"abs({c}.n) = 1 AND shiftrightunsigned(xxhash64({c}.k, {seed}), 32) = {c}.h")
        placed = over("transform", alone)(lambda c: f"named_struct('n', {c}.n, 'k', {c}.k, 'g', xxhash64({c}.k, {seed}))")
        return f"array_distinct({placed})"

    def without(now: str, taken: str) -> str:
        take = lambda a, x: f"named_struct('n', {a}.n - {x}.n, 'k', {a}.k ^ {x}.k, 'h', {a}.h ^ shiftrightunsigned({x}.g, 32))"
        own = lambda j: over("filter", taken)(lambda x: f"(shiftright({x}.g, cast({j} div {width} AS int) * {bits}) & {width - 1}) = {j} % {width}")
        return over("transform", now, of=2)(lambda c, j: over("aggregate", own(j), c, of=2)(take))

    def step(state: str, _: str) -> str:
        found = lambda taken: f"concat({state}.found, {over('transform', taken)(lambda x: f'{x}.k')})"
        ended = f"named_struct('cells', {state}.cells, 'found', {state}.found, 'ended', true)"
        go_on = lambda taken: f"if(size({taken}) = 0, {ended}, named_struct('cells', {without(f'{state}.cells', taken)}, 'found', {found(taken)}, 'ended', false))"
        return f"if({state}.ended, {state}, {let(pure(f'{state}.cells'), go_on)})"

    start = f"named_struct('cells', {cells}, 'found', cast(array() AS array<bigint>), 'ended', false)"
    empty = lambda s: over("forall", f"{s}.cells")(lambda c: f"{c}.n = 0 AND {c}.k = 0 AND {c}.h = 0")
    return over("aggregate", f"sequence(1, {ROUNDS})", start, of=2)(lambda state, i: step(state, i), lambda s: f"named_struct('ok', {empty(s)}, 'found', {s}.found)")


def estimated_difference(cells: str, width: int) -> str:
    """The number of differing digests, from the counts of a subtracted sketch: a row's squares sum to d + (s * s - d) / width on average, s being the sum of its counts."""
    squares = over("aggregate", cells, "0L", of=2)(lambda s, c: f"{s} + cast({c}.n AS bigint) * {c}.n")
    total = over("aggregate", cells, "0L", of=2)(lambda s, c: f"{s} + {c}.n")
    return f"greatest(0.0D, ({squares} / 3 * {width} - power({total} / 3, 2)) / {width - 1})"


def dealt(keys: str, seed: int, parts: str) -> str:
    """The digests of each of the sub-tables, as an array of arrays: sorted by sub-table once, then cut where a binary search finds the next."""
    placed = over("transform", keys)(lambda k: f"named_struct('p', pmod(xxhash64({k}, {seed + 50}), {parts}), 'k', {k})")

    def cuts(xs: str) -> str:
        length = f"cast(ceil(log2(size({xs}) + 1.0D)) AS int)"
        steps = over("transform", f"sequence(0, {length})")(lambda i: f"shiftright({1 << 30}, 30 - {length} + {i})")
        past = lambda at, step, p: f"{at} + {step} <= size({xs}) AND get({xs}, {at} + {step} - 1).p < {p}"
        first = lambda st, p: over("aggregate", st, "0", of=2)(lambda at, step: f"if({past(at, step, p)}, {at} + {step}, {at})")
        starts = lambda st: over("transform", f"sequence(0, {parts})")(lambda p: first(st, p))
        own = lambda at, p: over("transform", f"slice({xs}, get({at}, {p}) + 1, get({at}, {p} + 1) - get({at}, {p}))")(lambda y: f"{y}.k")
        return let(steps, lambda st: let(starts(st), lambda at: over("transform", f"sequence(0, {parts} - 1)")(lambda p: own(at, p))))

    return let(f"array_sort({placed})", cuts)


def retry(a: str, b: str, planned: str, attempt: int) -> str:
    """Rebuild both sketches as sub-tables for `planned` differing digests, subtract and peel each; stuck ones are rebuilt wide."""
    seed = 100 * attempt
    parts = f"greatest(1, cast(ceil(least({planned}, cast(size({a}) + size({b}) AS double)) / {PLANNED}) AS int))"
    once = lambda x, at, width: peel(subtract(sketch(f"{x}.a", at, width), sketch(f"{x}.b", at, width)), at, width)
    sub = lambda x: let(once(x, seed, RETRY_WIDTH), lambda r: f"if({r}.ok, {r}, {once(x, seed + 1, WIDE)})")
    both = lambda n: over("zip_with", dealt(a, seed, n), dealt(b, seed, n), of=2)(lambda x, y: f"named_struct('a', {x}, 'b', {y})")
    done = let(parts, lambda n: over("transform", both(n))(sub))
    ok = lambda rs: over("forall", rs)(lambda r: f"{r}.ok")
    return let(done, lambda rs: f"named_struct('ok', {ok(rs)}, 'found', flatten({over('transform', rs)(lambda r: f'{r}.found')}))")


def differing(df: DataFrame, a: str, b: str, sketch_a: str, sketch_b: str, out: str) -> DataFrame:
    """Adds column `out`: the digests in one of the arrays a, b and not in the other, recovered from their sketches."""
    first = let(subtract(f"`{sketch_a}`", f"`{sketch_b}`"), lambda c: f"named_struct('peeled', {peel(c, 1, STORED_WIDTH)}, 'd', {estimated_difference(c, STORED_WIDTH)})")
    df = df.withColumn(out, F.expr(first))
    df = df.withColumn("__d", F.col(out)["d"]).withColumn(out, F.col(out)["peeled"])
    for attempt, growth in enumerate(GROWTH, 1):
        df = df.withColumn(out, F.expr(f"if(`{out}`.ok, `{out}`, {retry(f'`{a}`', f'`{b}`', f'__d * {growth}D', attempt)})"))
    direct = F.concat(F.array_except(a, b), F.array_except(b, a))
    return df.withColumn(out, F.when(F.col(out)["ok"], F.col(out)["found"]).otherwise(direct)).drop("__d")


def likeness(a: Column, b: Column, diff: Column) -> Column:
    """Jaccard likeness of two digest sets, from their sizes and the number of differing digests."""
    both, d = F.size(a) + F.size(b), F.size(diff)
    return F.when(both == 0, 1.0).otherwise((both - d).cast("double") / (both + d))


def serialized(cells: Column) -> Column:
    """A sketch as text."""
    one = lambda c: F.concat(F.hex(c["n"].bitwiseAND(F.lit(0xFFFF)).cast("long")), F.lit("."), F.hex(c["k"]), F.lit("."), F.hex(c["h"]))
    return F.lower(F.array_join(F.transform(cells, one), ","))


#: Rows of a bucket of `with_next` at least.
BUCKET_ROWS = 16


def with_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", buckets: int | None = None) -> DataFrame:
    """(id, text, next_text): the next text in ascending order of id; after the last comes the first.

    Rows are dealt by quantile splitters of the id, one constant array of four for each shuffle partition; the first row of each bucket is copied into the bucket before it, so one
    shuffle does. An id that holds several quantiles (null, say) is cut at text hashes, so no bucket holds more than its share of rows
    that differ.
    """
    ids = F.coalesce(F.col(id_col).cast("long"), F.lit(_LEAST))
    rows = docs.select(F.col(id_col).alias("id"), ids.alias("ord"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).withColumn("tie", F.xxhash64("text"))
    n = max(2, buckets or min(4 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), docs.count() // BUCKET_ROWS))
    found = rows.agg(F.min("ord").alias("least"), F.percentile_approx("ord", constant([i / n for i in range(1, n)], "array<double>"), 10 * n).alias("q")).first()
    times = Counter([] if found["least"] is None else [found["least"], *found["q"]])
    first = sorted((v, _LEAST) for v in times)
    if hot := {v: m for v, m in times.items() if m > 2}:
        # Text hashes are even over their range; the least of each stretch is a row's own. At most n rows reach the driver.
        stretches = F.element_at(F.map_from_entries(constant([{"key": v, "value": m} for v, m in hot.items()], "array<struct<key:bigint,value:bigint>>")), F.col("ord"))
        stretch = F.floor((F.shiftrightunsigned("tie", 11).cast("double") / F.lit(float(1 << 53)) + F.when(F.col("tie") < 0, -0.5).otherwise(0.5)) * stretches)
        least = rows.where(stretches.isNotNull()).groupBy("ord", stretch.alias("stretch")).agg(F.min("tie").alias("tie")).collect()
        first = sorted({*first, *[(r["ord"], r["tie"]) for r in least if r["stretch"] > 0]})
    side = max(1, int(len(first) ** 0.5))
    array = lambda xs: constant([{"ord": v, "tie": tie} for v, tie in xs], "array<struct<ord:bigint,tie:bigint>>")
    fine, coarse, here = array(first), array(first[::side]), F.struct("ord", "tie")
    below = F.size(F.filter(coarse, lambda s: s <= here))
    bucket = (below - 1) * side + F.size(F.filter(F.slice(fine, (below - 1) * side + 1, F.lit(side)), lambda s: s <= here))
    rows = rows.withColumn("bucket", bucket.cast("int"))
    last = len(first)
    as_copy = lambda b, kind: F.struct(b.cast("int").alias("bucket"), F.lit(kind).alias("copy"))
    opening = F.element_at(fine, F.col("bucket"))
    opens = (opening["ord"] == F.col("ord")) & opening["tie"].isin(F.lit(_LEAST), F.col("tie")) if first else F.lit(False)
    sent = F.array(as_copy(F.col("bucket"), 0), F.when(F.col("bucket") == 1, as_copy(F.lit(last), 2)).otherwise(as_copy(F.col("bucket") - 1, 1)))
    rows = rows.withColumn("to", F.explode(F.when(opens, sent).otherwise(F.array(as_copy(F.col("bucket"), 0)))))
    w = Window.partitionBy("b").orderBy((F.col("copy") == 2).asc(), "ord", "tie")
    rows = rows.select("id", "ord", "text", F.col("to.bucket").alias("b"), F.col("to.copy").alias("copy"), "tie")
    return rows.withColumn("next_text", F.lead("text").over(w)).where("copy = 0").select("id", "text", "next_text")


def edited_text(text: Column, next_text: Column) -> Column:
    """The last half of the code points replaced by as many (or all) of the next text."""
    n = F.char_length(text)
    half = F.floor(n / 2).cast("int")
    return F.concat(F.substring(text, F.lit(1), n - half), F.substring(next_text, F.lit(1), half))


def fingerprint(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_paragraphs, fingerprint, digests) of every document."""
    keyed = docs.select(F.col(id_col).alias("id"), digests(F.coalesce(F.col(text_col), F.lit(""))).alias("digests"))
    return keyed.select("id", F.size("digests").alias("n_paragraphs"), serialized(F.expr(sketch("digests", 1, STORED_WIDTH))).alias("fingerprint"), "digests")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = with_next(table(spark, sf_dir, "documents")).withColumn("edited", edited_text(F.col("text"), F.col("next_text")))
    rows = rows.select(
        F.col("id").alias("doc_id"),
        F.char_length("text").cast("long").alias("n_chars"),
        F.sha2("edited", 256).alias("edited_sha256"),
        digests(F.col("text")).alias("own"),
        digests(F.col("edited")).alias("changed"),
        digests(F.col("next_text")).alias("following"),
    )
    for name in ("own", "changed", "following"):
        rows = rows.withColumn(f"{name}_cells", F.expr(sketch(name, 1, STORED_WIDTH)))
    rows = differing(rows, "own", "changed", "own_cells", "changed_cells", "edits")
    rows = differing(rows, "own", "following", "own_cells", "following_cells", "steps")
    return rows.select(
        "doc_id", "n_chars", "edited_sha256",
        serialized(F.col("own_cells")).alias("fingerprint"),
        serialized(F.col("changed_cells")).alias("edited_fingerprint"),
        likeness(F.col("own"), F.col("changed"), F.col("edits")).alias("near_edited"),
        likeness(F.col("own"), F.col("following"), F.col("steps")).alias("near_next"),
        F.size("edits").alias("n_edits"),
    )
