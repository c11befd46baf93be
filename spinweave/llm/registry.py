"""Queries and SQL of this subpackage, for the driver's entry module."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import decontam, licenses, linededup, neardup, packing, quality, secrets, sharding, tiff, tokenbin


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_tiff_pages": tiff.op1_tiff_pages,
        "op2_license_templates": licenses.op2_license_templates,
        "op3_extendible_shards": sharding.op3_extendible_shards,
        "op4_secret_ownership": secrets.op4_secret_ownership,
        "op5_cgk_benchmark_leaks": decontam.op5_cgk_benchmark_leaks,
        "op6_probminhash_classes": neardup.op6_probminhash_classes,
        "op7_zstd_token_files": tokenbin.op7_zstd_token_files,
        "op8_importance_resampling": quality.op8_importance_resampling,
        "op9_line_bitmaps": linededup.op9_line_bitmaps,
        "op10_harmonic_packing": packing.op10_harmonic_packing,
    }


def oracle_sql() -> dict[str, str]:
    return {"op3_extendible_shards": sharding.OP3_SQL, "op9_line_bitmaps": linededup.OP9_SQL}
