"""The queries of this subpackage by name, and the SQL for those that SQL can express."""

from __future__ import annotations

from . import alignment, bpe, conversation_repair, decontaminate, gif, id_files, license_scan, line_dedup, quality, simhash, substring_dedup, suffix_dedup, warc

QUERIES = {
    "op1_gif_media": gif.op1_gif_media,
    "op2_line_dedup": line_dedup.op2_line_dedup,
    "op3_license_scan": license_scan.op3_license_scan,
    "op4_substring_dedup": substring_dedup.op4_substring_dedup,
    "op5_simhash_near_dedup": simhash.op5_simhash_near_dedup,
    "op6_bpe_round_trip": bpe.op6_bpe_round_trip,
    "op7_warc_bundles": warc.op7_warc_bundles,
    "op8_quality_classifier": quality.op8_quality_classifier,
    "op9_suffix_array_dedup": suffix_dedup.op9_suffix_array_dedup,
    "op10_benchmark_decontamination": decontaminate.op10_benchmark_decontamination,
    "op11_id_files": id_files.op11_id_files,
    "op12_token_alignment": alignment.op12_token_alignment,
    "op13_conversation_repair": conversation_repair.op13_conversation_repair,
}

ORACLES: dict[str, str] = {
    "op2_line_dedup": line_dedup.OP2_SQL,
    "op4_substring_dedup": substring_dedup.OP4_SQL,
    "op7_warc_bundles": warc.OP7_SQL,
    "op9_suffix_array_dedup": suffix_dedup.OP9_SQL,
}
