"""The registered queries of this subpackage and their SQL, by name."""

from __future__ import annotations

from importlib import import_module

MODULES = ["op1_chat", "op2_packing", "op3_secrets", "op4_suffix", "op5_itq", "op6_tokens", "op7_quality", "op8_decontaminate", "op9_jaccard", "op10_toxicity"]


def queries() -> dict:
    found = {}
    for name in MODULES:
        module = import_module(f"veldmark.llm.{name}")
        found.update((k, getattr(module, k)) for k in vars(module) if k.startswith("op") and k[2].isdigit())
    return found


def oracle_sql() -> dict[str, str]:
    found = {}
    for name in MODULES:
        found.update(getattr(import_module(f"veldmark.llm.{name}"), "ORACLE", {}))
    return found
