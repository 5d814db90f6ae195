"""Embedding near-dedup by an inverted multi-index.

Unit vectors are cut in two halves, each with its own codebook (k-means on a bounded sample); a vector's cell in the
product grid is its nearest centroid on either half. Exact copies become one vector. In a cell, vectors within half the
link angle of one of a few leaders form balls: all members of a ball link with each other, whatever their number,
so the search runs over balls. A ball visits cells in the order of a lower bound on the distance to them (a multi-sequence traversal of
the two sorted lists of centroids) up to a bound that is calibrated to a target recall on partners placed at exactly the
threshold. Visits meet the balls of the cell in numpy blocks of bounded size. By the triangle inequality a pair of balls links as a
whole, not at all, or is verified member by member, in double precision.

Cases: vectors that are null, empty, zero or hold null or non-finite components, and those with a null label, link with
nothing; vectors of different lengths never link; equal vectors link; null ids make no component smaller (a vector with only
a null id keeps null); an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfwise.llm.common import connected_components, cut, table

#: Vectors that codebooks and the visit bound are fitted on; vectors a cell is planned for; centroids on a half at most.
SAMPLE, PER_CELL, MAX_CENTROIDS = 16384, 256, 1024
#: Leaders tried in each cell; rows on either side of a block; share of partners at the threshold whose cell is visited.
LEADERS, BLOCK, RECALL = 16, 1024, 0.998
_TINY = 1e-9


class MultiIndex:
    """Two codebooks and the bound of the traversal."""

    def __init__(self, sample: np.ndarray, centroids: int, cosine: float, recall: float, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.cut_at = (sample.shape[1] + 1) // 2
        self.books = [self._kmeans(h, centroids, rng) for h in self.halves(sample)]
        self.bound = math.sqrt(2 - 2 * cosine)
        some = sample[rng.permutation(len(sample))[:4096]]
        noise = rng.standard_normal(some.shape)
        noise -= (noise * some).sum(1, keepdims=True) * some
        noise /= np.maximum(np.linalg.norm(noise, axis=1, keepdims=True), 1e-12)
        there = self.cells(cosine * some + math.sqrt(1 - cosine**2) * noise)
        low = self.lower_bounds(some)
        rows, k = np.arange(len(some)), len(self.books[1])
        reach = np.sqrt(low[0][rows, there // k] ** 2 + low[1][rows, there % k] ** 2)
        if len(reach):
            self.bound = min(self.bound, float(np.quantile(reach, recall)) + 1e-6)

    def halves(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return x[:, : self.cut_at], x[:, self.cut_at :]

    @staticmethod
    def _squared(x: np.ndarray, book: np.ndarray) -> np.ndarray:
        return np.maximum((x**2).sum(1)[:, None] - 2 * x @ book.T + (book**2).sum(1), 0)

    def _kmeans(self, x: np.ndarray, k: int, rng) -> np.ndarray:
        book = x[rng.permutation(len(x))[: max(1, min(k, len(x)))]].copy()
        for _ in range(12):
            near = self._squared(x, book).argmin(1)
            for c in range(len(book)):
                if (own := near == c).any():
                    book[c] = x[own].mean(0)
        return np.unique(book, axis=0)

    def cells(self, x: np.ndarray) -> np.ndarray:
        a, b = (self._squared(h, book).argmin(1) for h, book in zip(self.halves(x), self.books))
        return a * len(self.books[1]) + b

    def lower_bounds(self, x: np.ndarray) -> list[np.ndarray]:
        """On each half, the distance from x to the bisector between its own and every other centroid."""
        out = []
        for h, book in zip(self.halves(x), self.books):
            d = self._squared(h, book)
            near = d.argmin(1)
            gap = np.sqrt(self._squared(book, book))[near]
            out.append(np.where(gap > 0, (d - d[np.arange(len(d)), near][:, None]) / np.maximum(2 * gap, 1e-12), 0.0))
        return out

    def visits(self, x: np.ndarray, slack: np.ndarray) -> list[np.ndarray]:
        """Cells of each row of x, nearest rows of the grid first, up to the bound plus the row's slack."""
        low, k, out = self.lower_bounds(x), len(self.books[1]), []
        first, second = (np.argsort(v, axis=1, kind="stable") for v in low)
        for i in range(len(x)):
            a, b = low[0][i, first[i]] ** 2, low[1][i, second[i]] ** 2
            ends = np.searchsorted(b, (self.bound + slack[i]) ** 2 - a, side="right")
            out.append(np.concatenate([first[i, j] * k + second[i, :e] for j, e in enumerate(ends) if e] or [np.zeros(0, np.int64)]))
        return out


def _matrix(vectors: pd.Series) -> np.ndarray:
    return np.stack(vectors.to_numpy()).astype(np.float64) if len(vectors) else np.zeros((0, 1))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def angle(a: Column, b: Column) -> Column:
    return F.acos(F.least(F.lit(1.0), F.greatest(F.lit(-1.0), dot(a, b))))


def _unit(vector) -> np.ndarray | None:
    """The vector at length one in double precision, None if it can't link."""
    if vector is None or not len(vector):
        return None
    v = np.array([np.nan if x is None else x for x in vector] if vector.dtype == object else vector, np.float64)
    top = np.abs(v).max()
    if not np.isfinite(top) or top == 0:
        return None
    v = v / top
    return v / np.sqrt((v * v).sum()) + 0.0


def _unit_batch(vectors: pd.Series) -> pd.Series:
    return pd.Series([_unit(v) for v in vectors], dtype=object)


def unit_vectors(df: DataFrame, id_col: str, vec_col: str, label_col: str) -> DataFrame:
    """(id, label, dim, unit): unit is null where the vector cannot link."""
    unit = F.pandas_udf(_unit_batch, "array<double>")(F.col(vec_col).cast("array<double>"))
    rows = df.select(F.col(id_col).alias("id"), F.col(label_col).alias("label"), unit.alias("unit"))
    return rows.select("id", "label", F.size("unit").alias("dim"), F.when(F.col("label").isNotNull(), F.col("unit")).alias("unit"))


def _blocks(members: DataFrame, visits: DataFrame, keys: list[str], block: int) -> DataFrame:
    """Members and visits of each cell dealt to groups of about `block` rows of each kind at most; every pair meets once."""
    n = lambda df, name: df.groupBy(*keys).agg(F.ceil(F.count("*") / block).cast("int").alias(name))
    counts = n(members, "m_blocks").join(n(visits, "v_blocks"), keys)
    columns = [*keys, "ball", "center", "radius", "kind", "mb", "vb"]
    own = lambda name: F.pmod(F.xxhash64("ball", F.lit(name)), F.col(name)).cast("int")
    every = lambda name: F.explode(F.sequence(F.lit(0), F.col(name) - 1))
    m = members.join(counts, keys).withColumn("mb", own("m_blocks")).withColumn("vb", every("v_blocks")).withColumn("kind", F.lit(0))
    v = visits.join(counts, keys).withColumn("vb", own("v_blocks")).withColumn("mb", every("m_blocks")).withColumn("kind", F.lit(1))
    return m.select(columns).unionByName(v.select(columns))


def _ball_pairs(cosine: float):
    alpha = math.acos(cosine)

    def pairs(group: pd.DataFrame) -> pd.DataFrame:
        m, v = group[group.kind == 0], group[group.kind == 1]
        if not len(m) or not len(v):
            return pd.DataFrame({"a": np.zeros(0, np.int64), "b": np.zeros(0, np.int64), "whole": np.zeros(0, bool)})
        dots = _matrix(v.center) @ _matrix(m.center).T
        vr, mr = v.radius.to_numpy()[:, None], m.radius.to_numpy()[None, :]
        theta = np.arccos(np.clip(dots, -1, 1))
        single = (vr + mr) == 0
        whole = np.where(single, dots >= cosine, theta + vr + mr <= alpha - _TINY)
        near = np.where(single, whole, theta - vr - mr <= alpha + _TINY)
        a, b = v.ball.to_numpy(), m.ball.to_numpy()
        i, j = np.nonzero(near & (a[:, None] != b[None, :]))
        return pd.DataFrame({"a": np.minimum(a[i], b[j]), "b": np.maximum(a[i], b[j]), "whole": whole[i, j]})

    return pairs


def _verified(sides: DataFrame, members: DataFrame, balls: DataFrame, cosine: float, block: int = BLOCK) -> DataFrame:
    """(a, b, vec, n): links that each vector of ball a (rows of `sides`) or b has to members of the other.

    A pair of balls is cut into blocks of `block` rows of either side, and blocks are dealt to groups of a few blocks' rows, so neither a large pair
    nor many small ones cost more than their comparisons; only sums for each vector leave a block.
    """
    n_blocks = lambda n: F.ceil(n / block).cast("int")
    sizes = sides.groupBy("a", "b").agg(F.count("*").alias("nx")).join(balls.select(F.col("ball").alias("b"), F.col("n").alias("ny")), "b")
    sizes = cut(sizes.select("a", "b", "nx", "ny", n_blocks(F.col("nx")).alias("xs"), n_blocks(F.col("ny")).alias("ys")))
    rows = sizes.agg(F.sum(F.col("nx") * F.col("ys") + F.col("ny") * F.col("xs"))).first()[0] or 0
    own = lambda vec, name: F.pmod(F.xxhash64(vec, F.lit(name)), F.col(name)).cast("int")
    every = lambda name: F.explode(F.sequence(F.lit(0), F.col(name) - 1))
    inner = members.select(F.col("ball").alias("b"), F.col("vec").alias("x"), F.col("unit").alias("u"), F.col("copies").alias("n"))
    columns = ["a", "b", "x", "u", "n", "kind", "xb", "yb"]
    left = sides.join(sizes, ["a", "b"]).withColumns({"kind": F.lit(0), "xb": own("x", "xs")}).withColumn("yb", every("ys"))
    right = sizes.join(inner, "b").withColumns({"kind": F.lit(1), "yb": own("x", "ys")}).withColumn("xb", every("xs"))
    both = left.select(columns).unionByName(right.select(columns))
    dealt = both.withColumn("group", F.pmod(F.xxhash64("a", "b", "xb", "yb"), F.lit(max(1, rows // (4 * block)))))

    def links(group: pd.DataFrame) -> pd.DataFrame:
        unit, at = _matrix(group.u), group.drop(columns="u").reset_index(drop=True)
        out = []
        for (a, b), part in [((k[0], k[1]), v) for k, v in at.groupby(["a", "b", "xb", "yb"])]:
            x, y = part[part.kind == 0], part[part.kind == 1]
            linked = unit[x.index] @ unit[y.index].T >= cosine
            for side, n in ((x, linked @ y.n.to_numpy()), (y, linked.T @ x.n.to_numpy())):
                out.append(pd.DataFrame({"a": a, "b": b, "vec": side.x[n > 0], "n": n[n > 0]}))
        return pd.concat(out)

    found = dealt.groupBy("group").applyInPandas(links, "a long, b long, vec long, n long")
    return found.groupBy("a", "b", "vec").agg(F.sum("n").alias("n"))


def near_duplicates(df: DataFrame, cosine: float = 0.93, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label", recall: float = RECALL) -> DataFrame:
    """(id, n_links, component_id) for every row."""
    spark = df.sparkSession
    rows = cut(unit_vectors(df, id_col, vec_col, label_col))
    fit = rows.where("unit is not null")
    same = ["label", "dim", "unit"]
    vectors = cut(fit.groupBy(*same).agg(F.min("id").alias("least_id"), F.count("*").alias("copies")).withColumn("vec", F.xxhash64(F.coalesce("least_id", F.lit(-1)), *same)))
    about = vectors.groupBy("label", "dim").agg(F.count("*").alias("n")).agg(F.max("n"), F.max("dim")).first()
    if about[0] is None:
        return rows.select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    most, wide = about
    padded = lambda u: F.concat(u, F.array_repeat(F.lit(0.0), F.lit(wide) - F.size(u)))
    drawn = vectors.orderBy("vec").limit(SAMPLE).select(padded(F.col("unit")).alias("u")).toPandas()
    index = MultiIndex(_matrix(drawn.u), max(2, min(MAX_CENTROIDS, round(math.sqrt(most / PER_CELL)))), cosine, recall)
    shared = spark.sparkContext.broadcast(index)  # two codebooks: at most 2 x 1024 half vectors

    def cell_batch(u: pd.Series) -> pd.Series:
        return pd.Series(shared.value.cells(_matrix(u)) if len(u) else [], dtype="int64")

    def visit_batch(u: pd.Series, radius: pd.Series) -> pd.Series:
        return pd.Series(shared.value.visits(_matrix(u), radius.to_numpy()) if len(u) else [], dtype=object)

    cell_of, visits_of = F.pandas_udf(cell_batch, "long"), F.pandas_udf(visit_batch, "array<long>")
    celled = cut(vectors.select("label", "dim", "vec", "least_id", "copies", padded(F.col("unit")).alias("unit")).withColumn("cell", cell_of("unit")))
    keys = ["label", "dim", "cell"]
    # The least vector of each of LEADERS hash classes of a cell: minima combine before the shuffle, so a hot cell sends few rows.
    leaders = celled.groupBy(*keys, F.pmod(F.xxhash64("vec"), F.lit(LEADERS)).alias("place")).agg(F.min_by(F.struct("vec", "unit"), "vec").alias("first"))
    # Written, so that a hot cell of the join below is split at run time.
    leaders = cut(leaders.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("place", "first.vec", "first.unit"))).alias("leaders")))
    half = math.cos(math.acos(cosine) / 2 - 1e-6)
    led = celled.join(leaders, keys).withColumn("led", F.get(F.filter("leaders", lambda x: dot(x["unit"], F.col("unit")) >= half), F.lit(0)))
    led = led.withColumn("ball", F.coalesce("led.vec", "vec")).withColumn("center", F.coalesce("led.unit", "unit"))
    members = cut(led.withColumn("off", F.when(F.col("ball") == F.col("vec"), 0.0).otherwise(angle(F.col("center"), F.col("unit")))).drop("leaders", "led"))
    balls = cut(members.groupBy("ball").agg(*[F.first(k).alias(k) for k in (*keys, "center")], F.max("off").alias("radius"), F.sum("copies").alias("weight"), F.count("*").alias("n"), F.min("least_id").alias("least_id")))
    around = balls.withColumn("cell", F.explode(visits_of("center", "radius")))
    blocks = _blocks(balls, around, keys, BLOCK)
    found = blocks.groupBy(*keys, "mb", "vb").applyInPandas(_ball_pairs(cosine), "a long, b long, whole boolean")
    pairs = cut(found.groupBy("a", "b").agg(F.max("whole").alias("whole")))

    ends = lambda p: p.select("a", "b").unionByName(p.select(F.col("b").alias("a"), F.col("a").alias("b")))
    weights = balls.select(F.col("ball").alias("b"), "weight")
    by_ball = ends(pairs.where("whole")).join(weights, "b").groupBy(F.col("a").alias("ball")).agg(F.sum("weight").alias("n"))
    # Pairs of balls that only partly link: members of the one against the centre of the other, then against its members.
    partly = pairs.where("not whole").select("a", "b")
    other = balls.select(F.col("ball").alias("b"), F.col("center").alias("c"), F.col("radius").alias("r"), F.col("weight").alias("w"))
    mine = members.select(F.col("ball").alias("a"), F.col("vec").alias("x"), F.col("unit").alias("u"), F.col("copies").alias("n"))
    sides = partly.join(mine, "a").join(other, "b").withColumn("off", angle(F.col("u"), F.col("c")))
    alpha = math.acos(cosine)
    sides = cut(sides.where(F.col("off") - F.col("r") <= alpha + _TINY).select("a", "b", "x", "u", "n", "w", (F.col("off") + F.col("r") <= alpha - _TINY).alias("all")))
    checked = cut(_verified(sides.where("not all"), members, balls, cosine))
    whole = sides.where("all")
    by_vec = whole.select(F.col("x").alias("vec"), F.col("w").alias("n")).unionByName(checked.select("vec", "n"))
    by_vec = by_vec.groupBy("vec").agg(F.sum("n").alias("vec_n"))
    by_ball = by_ball.unionByName(whole.select(F.col("b").alias("ball"), "n")).groupBy("ball").agg(F.sum("n").alias("ball_n"))
    edges = pairs.where("whole").select("a", "b").unionByName(whole.select("a", "b")).unionByName(checked.select("a", "b").distinct())
    parts = connected_components(edges).withColumnRenamed("node", "ball")
    named = balls.select("ball", "weight", "least_id").join(parts, "ball", "left").join(by_ball, "ball", "left").withColumn("component", F.coalesce("component", "ball"))
    least = named.groupBy("component").agg(F.min("least_id").alias("component_id"))
    named = named.join(least, "component").select("ball", "weight", "component_id", F.coalesce("ball_n", F.lit(0)).alias("ball_n"))
    per_vec = members.select("vec", "ball").join(named, "ball").join(by_vec, "vec", "left")
    per_vec = per_vec.select("vec", "component_id", (F.col("weight") - 1 + F.col("ball_n") + F.coalesce("vec_n", F.lit(0))).alias("n_links"))
    by_unit = vectors.select(*same, "vec").join(per_vec, "vec").drop("vec")
    linked = fit.join(by_unit, same).select("id", "n_links", F.coalesce("component_id", "id").alias("component_id"))
    alone = rows.where("unit is null").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    return linked.unionByName(alone)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = near_duplicates(table(spark, sf_dir, "embeddings"))
    return out.select(F.col("id").alias("vec_id"), F.col("n_links").cast("long").alias("n_links"), "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))


SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, [x::DOUBLE FOR x IN embedding] AS e FROM embeddings
), ok AS (
  SELECT * FROM v WHERE label IS NOT NULL AND e IS NOT NULL AND len(e) > 0
    AND len([x FOR x IN e IF x IS NULL OR isnan(x) OR isinf(x)]) = 0 AND list_sum([x * x FOR x IN e]) > 0
), l AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM ok a JOIN ok b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_cosine_similarity(a.e, b.e) >= 0.93
), r(a, b) AS (
  SELECT vec_id, vec_id FROM v UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a
), c AS (
  SELECT a AS vec_id, min(b) AS component_id FROM r GROUP BY a
), n AS (
  SELECT a AS vec_id, count(*) AS n_links FROM l GROUP BY a
)
SELECT c.vec_id, coalesce(n.n_links, 0)::BIGINT AS n_links, c.component_id, c.vec_id = c.component_id AS kept
FROM c LEFT JOIN n ON c.vec_id = n.vec_id
"""
