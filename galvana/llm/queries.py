"""The queries of this subpackage, and SQL where it can express one."""

from galvana.llm import bpe, chat_format, conversation_repair, hard_negatives, hmm, license_scan, lsh_dedup, mixing, ngram_join, quality_knn, secret_scan, token_files, topk_search

QUERIES = {
    "op1_mixing": mixing.op1_mixing,
    "op2_chat_format": chat_format.op2_chat_format,
    "op3_token_files": token_files.op3_token_files,
    "op4_hmm": hmm.op4_hmm,
    "op5_bpe": bpe.op5_bpe,
    "op6_quality_knn": quality_knn.op6_quality_knn,
    "op7_lsh_dedup": lsh_dedup.op7_lsh_dedup,
    "op8_license_scan": license_scan.op8_license_scan,
    "op9_topk_search": topk_search.op9_topk_search,
    "op10_ngram_join": ngram_join.op10_ngram_join,
    "op11_conversation_repair": conversation_repair.op11_conversation_repair,
    "op12_secret_scan": secret_scan.op12_secret_scan,
    "op13_hard_negatives": hard_negatives.op13_hard_negatives,
}

ORACLES: dict[str, str] = {
    "op2_chat_format": chat_format.OP2_SQL,
    "op7_lsh_dedup": lsh_dedup.OP7_SQL,
    "op9_topk_search": topk_search.OP9_SQL,
    "op10_ngram_join": ngram_join.OP10_SQL,
    "op11_conversation_repair": conversation_repair.OP11_SQL,
    "op13_hard_negatives": hard_negatives.OP13_SQL,
}
