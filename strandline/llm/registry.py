"""The numbered queries and, where SQL can express them, their SQL."""

from __future__ import annotations

from . import divergence_audit, embedding_dedup, line_dedup, masked_lm, packing, periodic_runs, piece_transducer, quality_model, quality_rules, secrets, simhash, toxicity, url_filter

QUERIES = {
    "op1_embedding_dedup": embedding_dedup.query,
    "op2_masked_lm": masked_lm.query,
    "op3_piece_transducer": piece_transducer.query,
    "op4_secrets": secrets.query,
    "op5_url_filter": url_filter.query,
    "op6_line_dedup": line_dedup.query,
    "op7_quality_model": quality_model.query,
    "op8_quality_rules": quality_rules.query,
    "op9_packing": packing.query,
    "op10_simhash": simhash.query,
    "op11_toxicity": toxicity.query,
    "op12_periodic_runs": periodic_runs.query,
    "op13_divergence_audit": divergence_audit.query,
}
ORACLE_SQL = {
    "op4_secrets": secrets.ORACLE_SQL,
    "op5_url_filter": url_filter.ORACLE_SQL,
    "op6_line_dedup": line_dedup.ORACLE_SQL,
    "op8_quality_rules": quality_rules.ORACLE_SQL,
    "op13_divergence_audit": divergence_audit.ORACLE_SQL,
}
