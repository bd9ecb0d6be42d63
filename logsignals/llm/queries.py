"""The queries of this subpackage by name, and SQL for those that SQL can express."""

from __future__ import annotations

from logsignals.llm import op1_secret_scans, op2_lm_scoring, op3_toxicity, op4_license_scans, op5_decontamination, op6_jaccard_join, op7_token_counts, op8_packing, op9_quality_rules, op10_url_filters, op11_fill_in_middle, op12_token_files, op13_hard_negatives, stages

QUERIES = {
    "op1_secret_scans": op1_secret_scans.op1,
    "op2_lm_scoring": op2_lm_scoring.op2,
    "op3_toxicity": op3_toxicity.op3,
    "op4_license_scans": op4_license_scans.op4,
    "op5_decontamination": op5_decontamination.op5,
    "op6_jaccard_join": op6_jaccard_join.op6,
    "op7_token_counts": op7_token_counts.op7,
    "op8_best_fit_packing": op8_packing.op8,
    "op9_quality_rules": op9_quality_rules.op9,
    "op10_url_filters": op10_url_filters.op10,
    "op11_fill_in_middle": op11_fill_in_middle.op11,
    "op12_token_files": op12_token_files.op12,
    "op13_hard_negatives": op13_hard_negatives.op13,
    "pipeline": stages.run,
}
ORACLE = {
    "op1_secret_scans": op1_secret_scans.SQL,
    "op5_decontamination": op5_decontamination.SQL,
    "op9_quality_rules": op9_quality_rules.SQL,
    "op10_url_filters": op10_url_filters.SQL,
    "op11_fill_in_middle": op11_fill_in_middle.SQL,
    "op13_hard_negatives": op13_hard_negatives.SQL,
}
