"""The queries of the training-data operators and their SQL."""

from __future__ import annotations

from . import decontam, fair_queue, infill, jaccard_join, lang_mixture, lm_diff, phrases, rule_ensemble, secret_scan, template_lines, token_rollup, url_tree, winnow

QUERIES = {
    "op1_secret_ownership": secret_scan.query,
    "op2_mixture_em": lang_mixture.query,
    "op3_fair_queue": fair_queue.query,
    "op4_winnowing": winnow.query,
    "op5_url_template_tree": url_tree.query,
    "op6_delta_rollups": token_rollup.query,
    "op7_cross_entropy_difference": lm_diff.query,
    "op8_positional_index": decontam.query,
    "op9_divide_skip": jaccard_join.query,
    "op10_log_templates": template_lines.query,
    "op11_pcy_collocations": phrases.query,
    "op12_rule_ensemble": rule_ensemble.query,
    "op13_fill_in_middle": infill.query,
}

ORACLES = {
    "op1_secret_ownership": secret_scan.ORACLE,
    "op3_fair_queue": fair_queue.ORACLE,
    "op8_positional_index": decontam.ORACLE,
    "op9_divide_skip": jaccard_join.ORACLE,
    "op11_pcy_collocations": phrases.ORACLE,
    "op13_fill_in_middle": infill.ORACLE,
}
