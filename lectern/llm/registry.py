"""Queries of the training-data operators and their DuckDB twins."""

from __future__ import annotations

from . import (
    backoff_lm,
    bpe,
    language_id,
    licence_scan,
    media,
    mixing,
    periodic_runs,
    quality_ledger,
    resharding,
    secret_scan,
    simhash,
    token_counts,
    vector_codes,
)
from .common import documents, table


#: What names a row of a file.
FILE_ROW = ("_metadata.file_path", "_metadata.row_index")


def queries() -> dict:
    return {
        "op1_webp_media": lambda spark, sf_dir: media.op1(documents(spark, sf_dir)),
        "op2_resharding": lambda spark, sf_dir: resharding.op2(documents(spark, sf_dir).select("*", *FILE_ROW), ["file_path", "row_index"]),
        "op3_bpe": lambda spark, sf_dir: bpe.op3(documents(spark, sf_dir)),
        "op4_language_id": lambda spark, sf_dir: language_id.op4(documents(spark, sf_dir)),
        "op5_mixing": lambda spark, sf_dir: mixing.op5(documents(spark, sf_dir)),
        "op6_licence_scan": lambda spark, sf_dir: licence_scan.op6(documents(spark, sf_dir)),
        "op7_simhash": lambda spark, sf_dir: simhash.op7(documents(spark, sf_dir)),
        "op8_secret_scan": lambda spark, sf_dir: secret_scan.op8(documents(spark, sf_dir)),
        "op9_backoff_lm": lambda spark, sf_dir: backoff_lm.op9(documents(spark, sf_dir)),
        "op10_quality_ledger": lambda spark, sf_dir: quality_ledger.op10(documents(spark, sf_dir)),
        "op11_periodic_runs": lambda spark, sf_dir: periodic_runs.op11(documents(spark, sf_dir)),
        "op12_vector_codes": lambda spark, sf_dir: vector_codes.op12(table(spark, sf_dir, "embeddings")),
        "op13_token_counts": lambda spark, sf_dir: token_counts.op13(documents(spark, sf_dir)),
    }


def oracles() -> dict:
    return {
        "op5_mixing": mixing.ORACLE,
        "op6_licence_scan": licence_scan.oracle(),
        "op9_backoff_lm": backoff_lm.ORACLE,
        "op10_quality_ledger": quality_ledger.ORACLE,
        "op12_vector_codes": vector_codes.oracle(),
    }
