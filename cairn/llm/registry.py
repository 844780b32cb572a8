"""Queries opN_<name> of the training-data operators, and their DuckDB SQL where it can express them."""

from __future__ import annotations

from . import chat_format, decontaminate, line_dedup, near_dedup, substring_dedup, suffix_dedup
from .chat_format import op4_chat_format
from .decontaminate import op1_benchmark_decontamination
from .language_id import op3_language_id
from .line_dedup import op6_line_dedup
from .mixing import op2_mix_sources
from .near_dedup import op7_minhash_near_dedup
from .pii import op8_pii_surrogates
from .quality_rules import op5_quality_rules
from .substring_dedup import op10_substring_dedup
from .suffix_dedup import op9_suffix_dedup

QUERIES = {
    f.__name__: f
    for f in (
        op1_benchmark_decontamination,
        op2_mix_sources,
        op3_language_id,
        op4_chat_format,
        op5_quality_rules,
        op6_line_dedup,
        op7_minhash_near_dedup,
        op8_pii_surrogates,
        op9_suffix_dedup,
        op10_substring_dedup,
    )
}

ORACLE: dict[str, str] = {
    "op1_benchmark_decontamination": decontaminate.ORACLE,
    "op4_chat_format": chat_format.ORACLE,
    "op6_line_dedup": line_dedup.ORACLE,
    "op7_minhash_near_dedup": near_dedup.ORACLE,
    "op9_suffix_dedup": suffix_dedup.ORACLE,
    "op10_substring_dedup": substring_dedup.ORACLE,
}
