"""The subpackage's registered queries, and SQL where SQL can express them."""

from __future__ import annotations

from importlib import import_module

# query name -> module of this subpackage
_MODULES = {
    "op1_url_filters": "url_filter",
    "op2_benchmark_decontamination": "decontaminate",
    "op3_minhash_near_dedup": "near_dedup",
    "op4_license_scans": "license_scan",
    "op5_exact_top_k": "mtree",
    "op6_chat_formatting": "chat",
    "op7_suffix_array_dedup": "suffix_dedup",
    "op8_quality_classifier": "quality",
    "op9_language_id": "langid",
    "op10_sentencepiece": "pieces",
    "op11_packing": "packing",
    "op12_ranked_search": "ranked_search",
    "op13_vector_codes": "vector_codes",
}


def queries() -> dict:
    return {name: getattr(import_module(f"{__package__}.{module}"), name) for name, module in _MODULES.items()}


def oracle_sql() -> dict[str, str]:
    out = {}
    for name, module in _MODULES.items():
        sql = getattr(import_module(f"{__package__}.{module}"), "oracle", None)
        if sql is not None:
            out[name] = sql()
    return out
