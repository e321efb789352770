"""Registered queries of the training-data operators, and their SQL where SQL can express them."""

from stemma.llm import bpe, clustering, fingerprints, mixing, near_dedup, ngram_join, pii, prefix_trie, quality_classifier, quality_rules, substring_dedup, token_files, url_filter

QUERIES = {
    "op1_quality_rules": quality_rules.op1_quality_rules,
    "op2_quality_classifier": quality_classifier.op2_quality_classifier,
    "op3_token_files": token_files.op3_token_files,
    "op4_substring_dedup": substring_dedup.op4_substring_dedup,
    "op5_pii": pii.op5_pii,
    "op6_bpe": bpe.op6_bpe,
    "op7_mixing": mixing.op7_mixing,
    "op8_fingerprints": fingerprints.op8_fingerprints,
    "op9_near_dedup": near_dedup.op9_near_dedup,
    "op10_url_filter": url_filter.op10_url_filter,
    "op11_ngram_join": ngram_join.op11_ngram_join,
    "op12_clustering": clustering.op12_clustering,
    "op13_prefix_trie": prefix_trie.op13_prefix_trie,
}

ORACLE_SQL = {
    "op9_near_dedup": near_dedup.OP9_SQL,
    "op10_url_filter": url_filter.OP10_SQL,
    "op11_ngram_join": ngram_join.OP11_SQL,
    "op12_clustering": clustering.OP12_SQL,
    "op13_prefix_trie": prefix_trie.OP13_SQL,
}
