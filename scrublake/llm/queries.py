"""Queries of this subpackage, one for each operator, one for the unigram way of op4 and one for the pixels of op1's images, with SQL where SQL can express them on whole tables."""

from __future__ import annotations

from . import infill, language_id, media, mixing, near_dedup, pieces, prefix_trie, reputation, sharding, simhash, substring_dedup, token_files, topk

QUERIES = {
    "op1_webp_media": media.op1,
    "op2_host_reputation": reputation.op2,
    "op3_cover_tree_top_k": topk.op3,
    "op4_sentencepiece_viterbi": pieces.op4,
    "op5_sainte_lague_mix": mixing.op5,
    "op6_feistel_shards": sharding.op6,
    "op7_zstd_token_files": token_files.op7,
    "op8_minhash_near_dedup": near_dedup.op8,
    "op9_language_id": language_id.op9,
    "op10_substring_dedup": substring_dedup.op10,
    "op11_conversation_prefix_trie": prefix_trie.op11,
    "op12_simhash_pigeonring": simhash.op12,
    "op13_fill_in_middle": infill.op13,
    "unigram_pieces": pieces.unigram_pieces,
    "webp_pixels": media.webp_pixels,
}

ORACLE_SQL = {
    "op2_host_reputation": reputation.OP2_SQL,
    "op3_cover_tree_top_k": topk.OP3_SQL,
    "op5_sainte_lague_mix": mixing.OP5_SQL,
    "op6_feistel_shards": sharding.OP6_SQL,
    "op8_minhash_near_dedup": near_dedup.OP8_SQL,
    "op10_substring_dedup": substring_dedup.OP10_SQL,
    "op11_conversation_prefix_trie": prefix_trie.OP11_SQL,
    "op13_fill_in_middle": infill.OP13_SQL,
    "webp_pixels": media.WEBP_PIXELS_SQL,
}
