"""The queries of this subpackage and their SQL, for the registry at the repository's top."""

from __future__ import annotations

import corpus_pipeline

from . import audit, flac, gru, jaccard, langid, minhash, mix, pieces, quality, tokens, topk, trie, warc

QUERIES = {
    "op1_token_output": tokens.query,
    "op2_sentencepiece": pieces.query,
    "op3_exact_topk": topk.query,
    "op4_lm_scoring": gru.query,
    "op5_jaccard_join": jaccard.query,
    "op6_quality": quality.query,
    "op7_source_mix": mix.query,
    "op8_warc": warc.query,
    "op9_flac": flac.query,
    "op10_language_id": langid.query,
    "op11_prefix_trie": trie.query,
    "op12_filter_audit": audit.query,
    "op13_minhash": minhash.query,
    "pipeline": corpus_pipeline.run,
}
SQL = {"op3_exact_topk": topk.SQL, "op7_source_mix": mix.SQL, "op8_warc": warc.SQL, "op11_prefix_trie": trie.SQL, "op12_filter_audit": audit.SQL} | ({"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {})
