"""Registered queries of the training-data operators, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import bpe, decontaminate, exact_dedup, lexical_search, licenses, line_cleaning, near_dedup, pii, quality, secret_scan, spelling, substring_dedup, token_files

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_secret_scan": secret_scan.query,
    "op2_token_files": token_files.query,
    "op3_quality": quality.query,
    "op4_substring_dedup": substring_dedup.query,
    "op5_pii": pii.query,
    "op6_licenses": licenses.query,
    "op7_decontaminate": decontaminate.query,
    "op8_near_dedup": near_dedup.query,
    "op9_bpe": bpe.query,
    "op10_exact_dedup": exact_dedup.query,
    "op11_line_cleaning": line_cleaning.query,
    "op12_spelling": spelling.query,
    "op13_lexical_search": lexical_search.query,
}

ORACLES: dict[str, str] = {"op10_exact_dedup": exact_dedup.ORACLE, "op11_line_cleaning": line_cleaning.ORACLE, "op13_lexical_search": lexical_search.ORACLE}
