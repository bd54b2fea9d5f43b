"""The queries of this subpackage and the SQL that gives the same rows, where SQL can."""

from . import chat, collocations, decontaminate, embeddings, lines, mixing, negatives, quality, search, simhash, spans, substrings, toxicity

QUERIES = {
    "op1_toxicity": toxicity.op1_toxicity,
    "op2_source_mixing": mixing.op2_source_mixing,
    "op3_chat_formatting": chat.op3_chat_formatting,
    "op4_simhash_near_dedup": simhash.op4_simhash_near_dedup,
    "op5_substring_dedup": substrings.op5_substring_dedup,
    "op6_quality_classifier": quality.op6_quality_classifier,
    "op7_line_dedup": lines.op7_line_dedup,
    "op8_embedding_near_dedup": embeddings.op8_embedding_near_dedup,
    "op9_suffix_array_dedup": spans.op9_suffix_array_dedup,
    "op10_benchmark_decontamination": decontaminate.op10_benchmark_decontamination,
    "op11_phrase_collocations": collocations.op11_phrase_collocations,
    "op12_exact_top_k": search.op12_exact_top_k,
    "op13_hard_negatives": negatives.op13_hard_negatives,
}
ORACLES = {
    "op2_source_mixing": mixing.ORACLE,
    "op3_chat_formatting": chat.ORACLE,
    "op5_substring_dedup": substrings.ORACLE,
    "op7_line_dedup": lines.ORACLE,
    "op8_embedding_near_dedup": embeddings.ORACLE,
    "op9_suffix_array_dedup": spans.ORACLE,
    "op10_benchmark_decontamination": decontaminate.ORACLE,
    "op11_phrase_collocations": collocations.ORACLE,
    "op12_exact_top_k": search.ORACLE,
    "op13_hard_negatives": negatives.ORACLE,
}
