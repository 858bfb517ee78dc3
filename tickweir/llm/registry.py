"""Queries and SQL of the training-data operators, for the entry module."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tickweir.llm import bpe, decontam, linededup, mixing, quality, setsketch, sql, suffix, superkmer, toxicity, warc
from tickweir.llm._common import table

Query = Callable[[SparkSession, str], DataFrame]


def queries() -> dict[str, Query]:
    return {
        "op1_warc_index": lambda s, d: warc.pages_index(table(s, d, "pages")),
        "op2_suffix_spans": lambda s, d: suffix.repeated_spans(table(s, d, "documents")),
        "op3_token_counts": lambda s, d: bpe.token_counts(table(s, d, "documents")),
        "op4_mixture": lambda s, d: mixing.mixture(table(s, d, "documents")),
        "op5_contaminated": lambda s, d: decontam.contaminated(table(s, d, "documents"), table(s, d, "benchmark")),
        "op6_line_bitmaps": lambda s, d: linededup.line_bitmaps(table(s, d, "documents")),
        "op7_substring_windows": lambda s, d: superkmer.repeated_windows(table(s, d, "documents")),
        "op8_quality": lambda s, d: quality.quality(table(s, d, "documents"), table(s, d, "labels")),
        "op9_toxicity": lambda s, d: toxicity.scores(table(s, d, "documents"), table(s, d, "labels")),
        "op10_near_duplicates": lambda s, d: setsketch.near_duplicates(table(s, d, "documents")),
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op2_suffix_spans": sql.SUFFIX,
        "op4_mixture": sql.MIXTURE,
        "op5_contaminated": sql.DECONTAM,
        "op6_line_bitmaps": sql.LINES,
        "op7_substring_windows": sql.SUPERKMER,
    }
