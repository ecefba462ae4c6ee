"""The registered queries of this package and their SQL."""

from __future__ import annotations

from importlib import import_module

#: query -> module of this package
_QUERIES = {
    "op1_tokens": "tokens", "op2_toxicity": "toxicity", "op3_decontam": "decontam", "op4_pii": "pii", "op5_packing": "packing",
    "op6_quality": "quality", "op7_langid": "langid", "op8_jaccard": "jaccard", "op9_sharding": "sharding", "op10_lmscore": "lmscore",
    "op11_fingerprints": "fingerprints", "op12_interactions": "interactions", "op13_dialogue": "dialogue",
}


def queries() -> dict:
    import corpus_pipeline

    return {name: getattr(import_module(f"ridgeline.llm.{module}"), name) for name, module in _QUERIES.items()} | {"pipeline": corpus_pipeline.run}


def oracle_sql() -> dict[str, str]:
    found = {name: getattr(import_module(f"ridgeline.llm.{module}"), "ORACLE_SQL", None) for name, module in _QUERIES.items()}
    return {name: sql for name, sql in found.items() if sql}
