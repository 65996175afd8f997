"""Queries of this subpackage, and the SQL of those that SQL can express."""

from . import chat, flac, huffman, licenses, minhash, mixing, suffix_dedup, suffix_search, toxicity, url_rules

QUERIES = {
    "op1_substring_dedup": suffix_dedup.op1,
    "op2_url_filters": url_rules.op2,
    "op3_toxicity": toxicity.op3,
    "op4_license_scans": licenses.op4,
    "op5_source_mixing": mixing.op5,
    "op6_token_huffman": huffman.op6,
    "op7_flac_media": flac.op7,
    "op8_decontamination": suffix_search.op8,
    "op9_chat_format": chat.op9,
    "op10_minhash_dedup": minhash.op10,
}

ORACLE_SQL = {
    "op1_substring_dedup": suffix_dedup.OP1_SQL,
    "op2_url_filters": url_rules.OP2_SQL,
    "op5_source_mixing": mixing.OP5_SQL,
    "op8_decontamination": suffix_search.OP8_SQL,
    "op9_chat_format": chat.OP9_SQL,
}
