"""The queries of this package and their DuckDB SQL."""

from __future__ import annotations

from runledger.llm import (
    chat,
    decontaminate,
    html_text,
    lattice,
    licenses,
    order_minhash,
    packing,
    pii,
    quality_rules,
    resampling,
    source_audit,
    suffix_dedup,
    url_rules,
)

Q = {
    "op1_pii_bootstrapping": pii.op1_pii_bootstrapping,
    "op2_html_extraction": html_text.op2_html_extraction,
    "op3_quality_classifier": quality_rules.op3_quality_classifier,
    "op4_lattice_near_dedup": lattice.op4_lattice_near_dedup,
    "op5_chat_formatting": chat.op5_chat_formatting,
    "op6_best_fit_packing": packing.op6_best_fit_packing,
    "op7_suffix_dedup": suffix_dedup.op7_suffix_dedup,
    "op8_benchmark_decontamination": decontaminate.op8_benchmark_decontamination,
    "op9_order_minhash": order_minhash.op9_order_minhash,
    "op10_license_scan": licenses.op10_license_scan,
    "op11_importance_resampling": resampling.op11_importance_resampling,
    "op12_source_audit": source_audit.op12_source_audit,
    "op13_url_filters": url_rules.op13_url_filters,
}
SQL = {
    "op5_chat_formatting": chat.ORACLE,
    "op8_benchmark_decontamination": decontaminate.ORACLE,
    "op11_importance_resampling": resampling.ORACLE,
    "op12_source_audit": source_audit.ORACLE,
}
