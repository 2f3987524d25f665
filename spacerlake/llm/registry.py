"""Queries and oracle SQL of the operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .chat_format import OP3_SQL, op3_chat_format
from .decontamination import OP7_SQL, op7_decontamination
from .embedding_dedup import OP6_SQL, op6_embedding_dedup
from .fill_middle import OP12_SQL, op12_fill_middle
from .language_id import op2_language_id
from .line_dedup import OP10_SQL, op10_line_dedup
from .mixing import OP1_SQL, op1_mixing
from .ngram_join import op8_ngram_join
from .quality_rules import OP13_SQL, op13_quality_rules
from .suffix_dedup import op4_suffix_dedup
from .token_store import op5_token_store
from .toxicity import op9_toxicity
from .whitening import op11_whitening

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_mixing": op1_mixing,
    "op2_language_id": op2_language_id,
    "op3_chat_format": op3_chat_format,
    "op4_suffix_dedup": op4_suffix_dedup,
    "op5_token_store": op5_token_store,
    "op6_embedding_dedup": op6_embedding_dedup,
    "op7_decontamination": op7_decontamination,
    "op8_ngram_join": op8_ngram_join,
    "op9_toxicity": op9_toxicity,
    "op10_line_dedup": op10_line_dedup,
    "op11_whitening": op11_whitening,
    "op12_fill_middle": op12_fill_middle,
    "op13_quality_rules": op13_quality_rules,
}
ORACLE_SQL: dict[str, str] = {"op1_mixing": OP1_SQL, "op3_chat_format": OP3_SQL, "op6_embedding_dedup": OP6_SQL, "op7_decontamination": OP7_SQL, "op10_line_dedup": OP10_SQL, "op12_fill_middle": OP12_SQL, "op13_quality_rules": OP13_SQL}
