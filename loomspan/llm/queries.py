"""The registered queries of this subpackage, and the SQL that some of them are held against."""

from __future__ import annotations

import importlib
import importlib.util

_MODULES = {
    "op1_vector_graph": ("vector_graph", "op1_vector_graph"),
    "op2_compression_quality": ("compression_quality", "op2_compression_quality"),
    "op3_best_fit_packing": ("packing", "op3_best_fit_packing"),
    "op4_toxicity": ("toxicity", "op4_toxicity"),
    "op5_pii_sanitise": ("pii", "op5_pii_sanitise"),
    "op6_jaccard_join": ("jaccard", "op6_jaccard_join"),
    "op7_warc": ("warc", "op7_warc"),
    "op8_telephony": ("telephony", "op8_telephony"),
    "op9_byte_bpe": ("bpe", "op9_byte_bpe"),
    "op10_repeated_spans": ("repeats", "op10_repeated_spans"),
}


def queries() -> dict:
    return {name: getattr(importlib.import_module(f"loomspan.llm.{module}"), function) for name, (module, function) in _MODULES.items() if importlib.util.find_spec(f"loomspan.llm.{module}")}


def oracle_sql() -> dict[str, str]:
    from loomspan.llm import oracle

    return oracle.ORACLE
