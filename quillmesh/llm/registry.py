"""The queries of this subpackage and their SQL, for __spark_entry__.py."""

from __future__ import annotations

from quillmesh.llm import exact_dedup, licences, line_dedup, media, mixing, packing, quality, ranking, simhash, spellings, token_files, toxicity, warc

QUERIES = {
    "op1_warc_boundary_chains": warc.op1_warc_boundary_chains,
    "op2_fuse_exact_dedup": exact_dedup.op2_fuse_exact_dedup,
    "op3_hash_threshold_mix": mixing.op3_hash_threshold_mix,
    "op4_repair_token_files": token_files.op4_repair_token_files,
    "op5_cnn_toxicity": toxicity.op5_cnn_toxicity,
    "op6_signature_media": media.op6_signature_media,
    "op7_simhash_components": simhash.op7_simhash_components,
    "op8_bradley_terry_quality": quality.op8_bradley_terry_quality,
    "op9_cost_balanced_packing": packing.op9_cost_balanced_packing,
    "op10_licence_digests": licences.op10_licence_digests,
    "op11_bloom_line_dedup": line_dedup.op11_bloom_line_dedup,
    "op12_tiled_spellings": spellings.op12_tiled_spellings,
    "op13_blocked_ranking": ranking.op13_blocked_ranking,
}

ORACLES: dict[str, str] = {
    "op1_warc_boundary_chains": warc.OP1_SQL,
    "op2_fuse_exact_dedup": exact_dedup.OP2_SQL,
    "op3_hash_threshold_mix": mixing.OP3_SQL,
    "op10_licence_digests": licences.OP10_SQL,
    "op11_bloom_line_dedup": line_dedup.OP11_SQL,
    "op12_tiled_spellings": spellings.OP12_SQL,
    "op13_blocked_ranking": ranking.OP13_SQL,
}
