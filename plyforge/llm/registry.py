"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from plyforge.llm import decontaminate, langid, linededup, mixing, pii, quality, sharding, simhash, tokenscan, urls

QUERIES = {
    "op1_crf_quality": quality.op1_crf_quality,
    "op2_byte_prefix_shards": sharding.op2_byte_prefix_shards,
    "op3_simhash_neardup": simhash.op3_simhash_neardup,
    "op4_pfair_mix": mixing.op4_pfair_mix,
    "op5_path_template_filter": urls.op5_path_template_filter,
    "op6_skip_chain_pii": pii.op6_skip_chain_pii,
    "op7_segment_edit_lines": linededup.op7_segment_edit_lines,
    "op8_separator_scan_tokens": tokenscan.op8_separator_scan_tokens,
    "op9_benchmark_decontamination": decontaminate.op9_benchmark_decontamination,
    "op10_byte_cnn_language": langid.op10_byte_cnn_language,
}
ORACLE_SQL: dict[str, str] = {
    "op9_benchmark_decontamination": decontaminate.ORACLE,
}
