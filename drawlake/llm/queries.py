"""Registered queries of the text operators and the SQL of those that SQL can express."""

from __future__ import annotations

from drawlake.llm import byte_cnn, exact_topk, jaccard_join, language_id, license_scan, line_dedup, line_quality, mixing, packing, periodic_runs, secret_scan, token_alignment, warc_bundles

QUERIES = {
    "op1_secret_ownership": secret_scan.op1_secret_ownership,
    "op2_byte_cnn": byte_cnn.op2_byte_cnn,
    "op3_patience_license": license_scan.op3_patience_license,
    "op4_line_first": line_quality.op4_line_first,
    "op5_entropy_mix": mixing.op5_entropy_mix,
    "op6_divide_skip": jaccard_join.op6_divide_skip,
    "op7_language_spans": language_id.op7_language_spans,
    "op8_line_dedup": line_dedup.op8_line_dedup,
    "op9_best_two_fit": packing.op9_best_two_fit,
    "op10_exact_topk": exact_topk.op10_exact_topk,
    "op11_periodic_runs": periodic_runs.op11_periodic_runs,
    "op12_warc_bundles": warc_bundles.op12_warc_bundles,
    "op13_token_alignment": token_alignment.op13_token_alignment,
}
ORACLES = {
    "op1_secret_ownership": secret_scan.ORACLE,
    "op4_line_first": line_quality.ORACLE,
    "op6_divide_skip": jaccard_join.ORACLE,
    "op8_line_dedup": line_dedup.ORACLE,
    "op10_exact_topk": exact_topk.ORACLE,
    "op12_warc_bundles": warc_bundles.ORACLE,
}
