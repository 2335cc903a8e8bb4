"""The queries of this subpackage, by name, and their DuckDB SQL."""

from __future__ import annotations

from . import alignment, conversation_trie, decontaminate, exact_dedup, line_dedup, lm_scoring, minhash_dedup, packing, pii, quality, token_counts, url_filter, warc

QUERIES = {
    "op1_minhash_dedup": minhash_dedup.op1_minhash_dedup,
    "op2_pii": pii.op2_pii,
    "op3_url_filter": url_filter.op3_url_filter,
    "op4_line_dedup": line_dedup.op4_line_dedup,
    "op5_packing": packing.op5_packing,
    "op6_warc": warc.op6_warc,
    "op7_decontaminate": decontaminate.op7_decontaminate,
    "op8_quality": quality.op8_quality,
    "op9_lm_scoring": lm_scoring.op9_lm_scoring,
    "op10_exact_dedup": exact_dedup.op10_exact_dedup,
    "op11_token_counts": token_counts.op11_token_counts,
    "op12_alignment": alignment.op12_alignment,
    "op13_conversation_trie": conversation_trie.op13_conversation_trie,
}
SQL = {k: v for module in (alignment, conversation_trie, decontaminate, exact_dedup, line_dedup, lm_scoring, minhash_dedup, packing, pii, quality, token_counts, url_filter, warc) for k, v in module.SQL.items()}
