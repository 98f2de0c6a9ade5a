"""The queries op1_ to op13_ over the synthetic tables, with production parameters and whole tables."""

from __future__ import annotations

from importlib import import_module

#: Query name -> module of this package that has `query(spark, sf_dir)` and, where SQL can express it, `ORACLE_SQL`.
MODULES = {
    "op1_byte_bpe": "bpe_query",
    "op2_quality_classifier": "quality_query",
    "op3_warc": "warc_query",
    "op4_class_lm": "classlm_query",
    "op5_simhash": "simhash_query",
    "op6_decontamination": "decontaminate_query",
    "op7_suffix_dedup": "suffix_query",
    "op8_toxicity": "toxicity_query",
    "op9_quality_rules": "divergence_query",
    "op10_url_filter": "urlfilter_query",
    "op11_token_counts": "resync_query",
    "op12_filter_audit": "filteraudit_query",
    "op13_source_audit": "sourceaudit_query",
}


def _loaded():
    return {name: import_module(f".{module}", __package__) for name, module in MODULES.items()}


def queries() -> dict:
    return {name: module.query for name, module in _loaded().items()}


def oracle_sql() -> dict[str, str]:
    return {name: module.ORACLE_SQL for name, module in _loaded().items() if getattr(module, "ORACLE_SQL", None)}
