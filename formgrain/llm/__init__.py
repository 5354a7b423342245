"""Training-data operators: deduplication, scoring, scanning, archives and packing of whole corpora."""

from __future__ import annotations

import importlib

#: Query name -> module that holds it (and, where SQL can express it, its SQL in ``ORACLE``).
MODULES = {
    "op1_chain_dedup": "chain_dedup",
    "op2_minhash_dedup": "minhash_dedup",
    "op3_quality_classifier": "quality_classifier",
    "op4_ppm": "ppm",
    "op5_secret_crf": "secret_crf",
    "op6_exact_dedup": "exact_dedup",
    "op7_suffix_dedup": "suffix_dedup",
    "op8_decontaminate": "decontaminate",
    "op9_warc": "warc",
    "op10_best_fit_packing": "best_fit_packing",
}


def queries() -> dict:
    found: dict = {}
    for name, module in MODULES.items():
        held = importlib.import_module(f"formgrain.llm.{module}")
        found |= {name: getattr(held, name)} | getattr(held, "MORE", {})
    return found


def oracle_sql() -> dict[str, str]:
    found: dict[str, str] = {}
    for module in MODULES.values():
        found |= importlib.import_module(f"formgrain.llm.{module}").ORACLE
    return found
