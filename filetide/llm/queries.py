"""Queries of the corpus operators, one for each, and the SQL of those that SQL can express."""

from __future__ import annotations

from . import adsampling, brown, decontaminate, hypershuffle, novelty, pieces, rans, ruleset, runs, superminhash, templates, toxicity, whitening

QUERIES = {
    "op1_rans_token_blocks": rans.query,
    "op2_line_templates": templates.query,
    "op3_benchmark_containment": decontaminate.query,
    "op4_brown_classes": brown.query,
    "op5_piece_scan": pieces.query,
    "op6_hypergeometric_shards": hypershuffle.query,
    "op7_superminhash_groups": superminhash.query,
    "op8_adaptive_scan": adsampling.query,
    "op9_zstd_novelty": novelty.query,
    "op10_toxicity_lexicon": toxicity.query,
    "op11_suffix_tree_runs": runs.query,
    "op12_cholesky_whitening": whitening.query,
    "op13_rule_ensemble": ruleset.query,
}
ORACLE_SQL = {
    "op2_line_templates": templates.ORACLE,
    "op3_benchmark_containment": decontaminate.ORACLE,
}
