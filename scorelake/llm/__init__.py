"""Operators of a training-data pipeline. Nothing else in the library imports this package."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .alignment import op13_token_alignment
from .exact_dedup import OP1_SQL, op1_exact_dedup
from .language import op9_language_id
from .lm import op6_lm_score
from .mixing import op4_mixing
from .preference import OP7_SQL, op7_preference
from .sentencepiece import op3_sentencepiece
from .simhash import op2_simhash
from .token_counts import op12_token_counts
from .topk import OP10_SQL, op10_topk
from .toxicity import op5_toxicity
from .url_filter import OP8_SQL, op8_url_filter
from .vector_codes import OP11_SQL, op11_vector_codes

_QUERIES = [
    (op1_exact_dedup, OP1_SQL),
    (op2_simhash, None),
    (op3_sentencepiece, None),
    (op4_mixing, None),
    (op5_toxicity, None),
    (op6_lm_score, None),
    (op7_preference, OP7_SQL),
    (op8_url_filter, OP8_SQL),
    (op9_language_id, None),
    (op10_topk, OP10_SQL),
    (op11_vector_codes, OP11_SQL),
    (op12_token_counts, None),
    (op13_token_alignment, None),
]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f, _ in _QUERIES}


def oracle_sql() -> dict[str, str]:
    return {f.__name__: sql for f, sql in _QUERIES if sql is not None}
