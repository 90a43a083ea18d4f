"""Queries of the training-data operators over the given tables, and their SQL."""

from __future__ import annotations

from importlib import import_module

#: Query name -> module of this package that defines the function of that name.
_HOME = {
    "op1_html_text": "html_text",
    "op2_best_fit_packing": "packing",
    "op3_chat_format": "chat_format",
    "op4_simhash": "simhash",
    "op5_token_counts": "token_counts",
    "op6_mixing": "mixing",
    "op7_exact_dedup": "exact_dedup",
    "op8_toxicity": "toxicity",
    "op9_curve_neighbours": "curve_neighbours",
    "op10_line_dedup": "line_dedup",
    "op11_sharding": "sharding",
    "op12_prefix_trie": "prefix_trie",
    "op13_merkle": "merkle",
}
#: Queries that SQL can express -> module whose ``ORACLE_SQL`` holds the text.
_SQL: tuple[str, ...] = ("op3_chat_format", "op6_mixing", "op7_exact_dedup", "op12_prefix_trie", "op13_merkle")


def queries() -> dict:
    return {name: getattr(import_module(f"{__package__}.{home}"), name) for name, home in _HOME.items()}


def oracle_sql() -> dict[str, str]:
    return {name: import_module(f"{__package__}.{_HOME[name]}").ORACLE_SQL for name in _SQL}
