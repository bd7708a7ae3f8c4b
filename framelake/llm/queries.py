"""Registered queries of the training-data operators, with SQL twins where SQL can express them."""

from __future__ import annotations

from framelake.llm import op01_imatch, op02_interleave, op03_trie_join, op04_stream_dedup, op05_context_tree, op06_super_kmers, op07_language, op08_html, op09_pieces, op10_packing, op11_nra, op12_mih, op13_peel

QUERIES = {
    "op1_imatch": op01_imatch.op1_imatch,
    "op2_interleave": op02_interleave.op2_interleave,
    "op3_trie_join": op03_trie_join.op3_trie_join,
    "op4_stream_dedup": op04_stream_dedup.op4_stream_dedup,
    "op5_context_tree": op05_context_tree.op5_context_tree,
    "op6_super_kmers": op06_super_kmers.op6_super_kmers,
    "op7_language": op07_language.op7_language,
    "op8_html": op08_html.op8_html,
    "op9_pieces": op09_pieces.op9_pieces,
    "op10_packing": op10_packing.op10_packing,
    "op11_nra": op11_nra.op11_nra,
    "op12_mih": op12_mih.op12_mih,
    "op13_peel": op13_peel.op13_peel,
}

ORACLES = {
    "op2_interleave": op02_interleave.ORACLE,
    "op3_trie_join": op03_trie_join.ORACLE,
    "op4_stream_dedup": op04_stream_dedup.ORACLE,
    "op6_super_kmers": op06_super_kmers.ORACLE,
    "op11_nra": op11_nra.ORACLE,
    "op13_peel": op13_peel.ORACLE,
}
