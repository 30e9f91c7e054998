"""Queries of the training-data operators and their SQL, for ``__spark_entry__.py``."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .chat_format import OP5_SQL, op5_chat_format
from .decontaminate import OP7_SQL, op7_decontaminate
from .fingerprints import op8_fingerprints
from .jaccard_join import op6_ngram_jaccard_join
from .language_id import op10_language_id
from .packing import op2_packing
from .suffix_dedup import op9_suffix_dedup
from .token_counts import op1_token_counts
from .toxicity import op3_toxicity
from .url_filter import op4_url_filter

ALL = (
    op1_token_counts,
    op2_packing,
    op3_toxicity,
    op4_url_filter,
    op5_chat_format,
    op6_ngram_jaccard_join,
    op7_decontaminate,
    op8_fingerprints,
    op9_suffix_dedup,
    op10_language_id,
)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """opN_<name> for every operator."""
    return {f.__name__: f for f in ALL}


def oracle_sql() -> dict[str, str]:
    """SQL of those that DuckDB can express."""
    return {"op5_chat_format": OP5_SQL, "op7_decontaminate": OP7_SQL}
