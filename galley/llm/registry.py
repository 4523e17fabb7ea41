"""The training-data queries and their SQL, by name."""

from __future__ import annotations

from importlib import import_module

#: Modules that each hold the query of their name, and SQL where DuckDB can express it.
MODULES = (
    "op1_substring_dedup", "op2_exact_topk", "op3_chat_formatting", "op4_logistic_mixing", "op5_hyperminhash",
    "op6_crf_language_id", "op7_token_counts", "op8_url_filters", "op9_string_tiling", "op10_byte_bpe",
    "op11_hard_negatives", "op12_suffix_dedup", "op13_filter_audit",
)


def _modules() -> dict:
    return {name: import_module(f"galley.llm.{name}") for name in MODULES}


def queries() -> dict:
    return {name: getattr(m, name) for name, m in _modules().items()}


def oracle_sql() -> dict[str, str]:
    return {name: m.SQL for name, m in _modules().items() if hasattr(m, "SQL")}
