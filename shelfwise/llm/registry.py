"""Queries of the training-data operators, and SQL for those that it can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

import corpus_pipeline
from shelfwise.llm import collocations, embeddings, fingerprints, licenses, line_rules, mixing, pieces, pii, quality, rollups, runs, sharding, simhash


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_document_fingerprints": fingerprints.query,
        "op2_simhash_near_dedup": simhash.query,
        "op3_mixing_sources": mixing.query,
        "op4_pieces": pieces.query,
        "op5_embedding_near_dedup": embeddings.query,
        "op6_sharding": sharding.query,
        "op7_license_scan": licenses.query,
        "op8_personal_data": pii.query,
        "op9_token_counts": rollups.query,
        "op10_quality_classifier": quality.query,
        "op11_collocations": collocations.query,
        "op12_periodic_runs": runs.query,
        "op13_quality_rules": line_rules.query,
        "pipeline": corpus_pipeline.run,
    }


def oracle_sql() -> dict[str, str]:
    found = {
        "op3_mixing_sources": mixing.SQL,
        "op5_embedding_near_dedup": embeddings.SQL,
        "op11_collocations": collocations.SQL,
        "op12_periodic_runs": runs.SQL,
        "op13_quality_rules": line_rules.SQL,
    }
    if corpus_pipeline.ORACLE_SQL:
        found["pipeline"] = corpus_pipeline.ORACLE_SQL
    return found
