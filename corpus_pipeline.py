"""The corpus pipeline: quality, near-duplicates, personal data, mixing, pieces.

Every stage takes (spark, docs, sf_dir) and works on all rows that the stage before it kept; all but the last return the columns of
documents, other columns of their input are dropped. `run` applies them to documents. SQL can express neither the network nor the other
learned and hashed steps, so there is no ORACLE_SQL; tests hold each stage against a brute-force version on small tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfwise.llm import mixing, pieces, pii, quality, simhash
from shelfwise.llm.common import cut, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier doesn't reject.

    Null and empty texts get a score like any other; rows with equal texts (repeated rows, one id or none) share its decision; very long
    texts are read whole, in blocks; an empty table stays empty.
    """
    return quality.accepted(docs, table(spark, sf_dir, "labels")).select(*COLUMNS)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: the least by id (null last), fingerprint and row key.

    Null and empty texts are one group; rows with one id or none stay if their texts are apart; of rows equal in every column one stays; long
    texts are read whole; an empty table stays empty.
    """
    return simhash.keep_one(docs).select(*COLUMNS)


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data replaced by its kind; n_chars follows the text.

    Null texts stay null (n_chars null), empty ones empty; every row has one row, whatever its id; long texts are read whole; an empty
    table stays empty.
    """
    out = pii.redact(docs)
    return out.withColumn("n_chars", F.char_length("text").cast("long")).select(*COLUMNS)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, each whole row up to three times; the boundary document of a source is rounded.

    Null and empty texts have size 0 and come at least once; a null source is a source; rows count by their values, not by id; rows equal in
    every column come as often as all of them together; an empty table stays empty.
    """
    return mixing.repeat_documents(docs).select(*COLUMNS)


def pieces_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Piece ids of every document, and whether they decode to its text; repeats of a document have segmentations of their own.

    Equal rows are counted before the shuffle and numbered from 0. Null texts give null pieces, n_pieces null and lossless true; empty ones no
    pieces; rows with one id or none that differ in anything else are documents of their own; an empty table stays empty.
    """
    counted = docs.groupBy(*COLUMNS).agg(F.count("*").cast("int").alias("__copies"))
    numbered = counted.withColumn("__epoch", F.explode(F.sequence(F.lit(0), F.col("__copies") - 1)))
    coded = pieces.encode_documents(numbered, epoch_col="__epoch", proof="decoded_sha256")
    lossless = F.col("decoded_sha256").eqNullSafe(F.sha2(F.col("text").cast("binary"), 256))
    return coded.select("doc_id", "source", "lang", "pieces", F.when(F.col("pieces").isNotNull(), F.size("pieces")).cast("long").alias("n_pieces"), lossless.alias("lossless"))


STAGES = [("quality", quality_stage), ("near_dedup", near_dedup_stage), ("pii", pii_stage), ("mixing", mixing_stage), ("pieces", pieces_stage)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(*COLUMNS)
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = cut(docs)
    return docs
