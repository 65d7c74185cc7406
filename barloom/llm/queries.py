"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import sql
from .decontamination import op1_decontamination
from .fingerprint import op3_fingerprint
from .language import op4_language
from .mixing import op7_mixing
from .ngram_join import op8_ngram_join
from .sharding import op10_sharding
from .substring_dedup import op9_substring_dedup
from .token_counts import op6_token_counts
from .token_store import op2_token_store
from .toxicity import op5_toxicity


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_decontamination": op1_decontamination,
        "op2_token_store": op2_token_store,
        "op3_fingerprint": op3_fingerprint,
        "op4_language": op4_language,
        "op5_toxicity": op5_toxicity,
        "op6_token_counts": op6_token_counts,
        "op7_mixing": op7_mixing,
        "op8_ngram_join": op8_ngram_join,
        "op9_substring_dedup": op9_substring_dedup,
        "op10_sharding": op10_sharding,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op8_ngram_join": sql.OP8,
        "op9_substring_dedup": sql.OP9,
    }
