"""Token counts as delta-maintained rollups.

A batch holds signed changes of documents: op 'insert' (tokens), 'delete' (old_tokens) and 'revise' (old_tokens -> tokens, perhaps of another tokenizer
version). Changes are reduced to additive deltas by source, language and tokenizer version before they are stored; totals are
sums of the deltas of all committed batches. A batch is one folder, written aside and then renamed to its id; the rename fails if the id is there,
so of two writers of one id one succeeds, committing an id again changes nothing, and a batch whose writer died is written anew.

Counts come from a merge-type piece model: version pieces-1 has its first merges only, pieces-2 all of them. Texts are read and counted once.

Cases: null source, language and version are groups of their own; null counts are 0; repeated rows are separate changes; an empty batch
commits and adds nothing; totals of groups whose documents are all gone are left out; other columns are ignored.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfwise.llm import pieces
from shelfwise.llm.common import cut, ensure_checkpoint_dir, table

KEYS = ["source", "lang", "tokenizer_version"]
#: Tokenizer versions of the query, and the merges that they know (None: all). Words whose counts a task remembers.
VERSIONS = {"pieces-1": 8000, "pieces-2": None}
REMEMBERED = 300_000
_SCHEMA = "source string, lang string, tokenizer_version string, docs long, tokens long"


class Sizes:
    """The number of pieces of words under each version, for a bounded number of words."""

    def __init__(self, path: str, merges: tuple[int | None, ...]):
        self.coders = [pieces.shared(path, 0.0, 0, m) for m in merges]
        self.number: dict[str, int] = {}
        self.counts = np.zeros((0, len(merges)), np.int64)

    def learn(self, words: set[str]) -> None:
        """Work out the words that are new, together."""
        if len(self.number) > REMEMBERED:
            self.number, self.counts = {}, self.counts[:0]
        new = list(words.difference(self.number))
        self.number.update(zip(new, range(len(self.number), len(self.number) + len(new))))
        self.counts = np.concatenate([self.counts, np.stack([c.word_sizes(new) for c in self.coders], 1)])

    def of(self, words: list[str]) -> np.ndarray:
        return self.counts[np.fromiter(map(self.number.__getitem__, words), np.int64, len(words))].sum(0)


def token_counts(text: Column, versions: dict[str, int | None] = VERSIONS, path: str = pieces.MODEL) -> Column:
    """struct of long: the number of pieces of a text under each version; a null text has none."""
    names, merges = list(versions), tuple(versions.values())

    def batch(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        sizes = Sizes(path, merges)
        units = sizes.coders[-1].units
        for part in parts:
            out = np.zeros((len(part), len(merges)), np.int64)
            for a, b in pieces.slices([len(t or "") for t in part]):
                words = [units.findall(" " + t) if t else [] for t in part[a:b]]
                sizes.learn(set(chain.from_iterable(words)))
                for i, own in enumerate(words, a):
                    out[i] = sizes.of(own)
            yield pd.DataFrame(out, columns=names)

    batch.__annotations__ = {"parts": Iterator[pd.Series], "return": Iterator[pd.DataFrame]}
    return F.pandas_udf(batch, ", ".join(f"`{n}` long" for n in names))(text)


def deltas(changes: DataFrame) -> DataFrame:
    """Changes (op, source, lang, old_version, old_tokens, tokenizer_version, tokens) as additive deltas."""
    entry = lambda version, tokens, sign: F.struct(version.alias("tokenizer_version"), F.lit(sign).cast("long").alias("docs"), (F.coalesce(tokens, F.lit(0)).cast("long") * sign).alias("tokens"))
    plus = entry(F.col("tokenizer_version"), F.col("tokens"), 1)
    minus = entry(F.col("old_version"), F.col("old_tokens"), -1)
    signed = F.when(F.col("op") == "insert", F.array(plus)).when(F.col("op") == "delete", F.array(minus)).when(F.col("op") == "revise", F.array(minus, plus))
    rows = changes.select("source", "lang", F.explode(signed).alias("d")).select("source", "lang", "d.*")
    return rows.groupBy(*KEYS).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens"))


class RollupTable:
    """Totals of folded batches and deltas of those committed since, below one folder that all executors share.

    A batch folder, and a base with the totals and ids of all batches folded into it, take their names by a rename that fails if the name is
    there. Readers add the last base and the batches that it doesn't hold; a folder whose id is in the base counts no more. `fold` makes the next
    base and deletes the batch folders that the base before already held, so readers that began before it still find theirs. The rename is atomic on
    HDFS; object stores that copy on rename need one writer, or a committer of their own.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        jvm = spark._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(path).getFileSystem(spark._jsc.hadoopConfiguration())

    def _names(self, prefix: str) -> list[str]:
        root = self._path(self.path)
        if not self._fs.exists(root):
            return []
        names = [s.getPath().getName() for s in self._fs.listStatus(root)]
        return sorted(n.removeprefix(prefix) for n in names if n.startswith(prefix))

    def batches(self) -> list[str]:
        """Ids of the batch folders."""
        return self._names("batch=")

    def base(self) -> str | None:
        """The folder of the last base."""
        found = self._names("base=")
        return f"{self.path}/base={found[-1]}" if found else None

    def _folded(self, ids: list[str], base: str | None) -> set[str]:
        """Those of ids that the base holds."""
        if base is None or not ids:
            return set()
        return {r[0] for r in self.spark.read.schema("id string").parquet(f"{base}/ids").where(F.col("id").isin(ids)).collect()}

    def committed(self, batch_id: str) -> bool:
        return self._fs.exists(self._path(f"{self.path}/batch={batch_id}")) or bool(self._folded([batch_id], self.base()))

    def _rename(self, staged: str, name: str) -> bool:
        """Give a staged folder its name; False if another writer has it."""
        hadoop, target = self.spark._jvm.org.apache.hadoop.fs, self._path(f"{self.path}/{name}")
        no_options = self.spark.sparkContext._gateway.new_array(hadoop.Options.Rename, 0)
        try:
            # Unlike FileSystem.rename, which moves into a folder that is there, this fails.
            hadoop.FileContext.getFileContext(target.toUri(), self.spark._jsc.hadoopConfiguration()).rename(self._path(staged), target, no_options)
        except Py4JJavaError:
            if not self._fs.exists(target):
                raise
            self._fs.delete(self._path(staged), True)
            return False
        return True

    def commit(self, batch_id: str, changes: DataFrame) -> bool:
        """Whether the batch was added: False if its id is committed already."""
        if self.committed(batch_id):
            return False
        staged = f"{self.path}/_staged-{uuid.uuid4().hex}"
        deltas(changes).write.parquet(staged)
        return self._rename(staged, f"batch={batch_id}")

    def fold(self) -> bool:
        """Fold all committed batches into a new base; False if there are none, or another writer made that base."""
        base, found = self.base(), self.batches()
        before = self._folded(found, base)
        new = [b for b in found if b not in before]
        if not new:
            return False
        staged = f"{self.path}/_staged-{uuid.uuid4().hex}"
        self._sum(base, new).write.parquet(f"{staged}/totals")
        ids = self.spark.createDataFrame([(b,) for b in new], "id string")
        if base:
            ids = ids.unionByName(self.spark.read.schema("id string").parquet(f"{base}/ids"))
        ids.coalesce(1).write.parquet(f"{staged}/ids")
        number = int(base.rpartition("=")[2]) + 1 if base else 0
        if not self._rename(staged, f"base={number:020d}"):
            return False
        for b in before:
            self._fs.delete(self._path(f"{self.path}/batch={b}"), True)
        return True

    def _sum(self, base: str | None, batches: list[str]) -> DataFrame:
        paths = [*([f"{base}/totals"] if base else []), *(f"{self.path}/batch={b}" for b in batches)]
        if not paths:
            return self.spark.createDataFrame([], _SCHEMA)
        rows = self.spark.read.schema(_SCHEMA).parquet(*paths)
        return rows.groupBy(*KEYS).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens")).where("docs <> 0 or tokens <> 0")

    def totals(self) -> DataFrame:
        """(source, lang, tokenizer_version, docs, tokens)."""
        base, found = self.base(), self.batches()
        folded = self._folded(found, base)
        return self._sum(base, [b for b in found if b not in folded])


def copies(docs: DataFrame, id_col: str = "doc_id", digest: str = "digest") -> DataFrame:
    """The rows of `docs` whose text stands under a lesser id too; works on digests of texts.

    A row without an id has no lesser one, nor have repeated rows of one id: neither is a copy of the other.
    """
    first = docs.groupBy(digest).agg(F.min(id_col).alias("__first_id"), F.count("*").alias("__n")).where("__n > 1")
    # Written, so that a digest that many rows share is split by the join at run time.
    return docs.join(cut(first.select(digest, "__first_id")), digest).where(F.col(id_col) > F.col("__first_id")).drop("__first_id")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Inserts all documents under one version, revises all to the next, folds these, deletes exact copies, and replays a folded batch."""
    old, new = VERSIONS
    docs = table(spark, sf_dir, "documents")
    digest = F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256)
    counted = cut(docs.select("doc_id", "source", "lang", digest.alias("digest"), token_counts(F.col("text")).alias("n")).select("doc_id", "source", "lang", "digest", F.col("n")[old].alias("n_old"), F.col("n")[new].alias("n_new")))
    none = F.lit(None).cast("string")
    insert = counted.select(F.lit("insert").alias("op"), "source", "lang", none.alias("old_version"), F.lit(0).alias("old_tokens"), F.lit(old).alias("tokenizer_version"), F.col("n_old").alias("tokens"))
    revise = counted.select(F.lit("revise").alias("op"), "source", "lang", F.lit(old).alias("old_version"), F.col("n_old").alias("old_tokens"), F.lit(new).alias("tokenizer_version"), F.col("n_new").alias("tokens"))
    gone = copies(counted)
    delete = gone.select(F.lit("delete").alias("op"), "source", "lang", F.lit(new).alias("old_version"), F.col("n_new").alias("old_tokens"), none.alias("tokenizer_version"), F.lit(0).alias("tokens"))
    rollup = RollupTable(spark, f"{ensure_checkpoint_dir(spark)}/rollup-{uuid.uuid4().hex}")
    for name, changes in (("0001", insert), ("0002", revise), ("0003", delete), ("0002", revise)):
        rollup.commit(name, changes)
        if name == "0002":
            rollup.fold()
    return rollup.totals()
