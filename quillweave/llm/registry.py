"""Queries of the corpus operators, and SQL for those that SQL can express."""

from __future__ import annotations

from quillweave.llm import bpe_automaton, chosen_path, hash_ring, line_crf, line_rules, mixing, multi_index, pivot_negatives, sentence_spans, signature_repair, token_files, url_cascade, warc

QUERIES = {
    "op1_multi_index": multi_index.op1_multi_index,
    "op2_sentence_spans": sentence_spans.op2_sentence_spans,
    "op3_line_crf": line_crf.op3_line_crf,
    "op4_token_files": token_files.op4_token_files,
    "op5_bpe_automaton": bpe_automaton.op5_bpe_automaton,
    "op6_url_cascade": url_cascade.op6_url_cascade,
    "op7_warc": warc.op7_warc,
    "op8_line_rules": line_rules.op8_line_rules,
    "op9_chosen_path": chosen_path.op9_chosen_path,
    "op10_mixing": mixing.op10_mixing,
    "op11_hash_ring": hash_ring.op11_hash_ring,
    "op12_signature_repair": signature_repair.op12_signature_repair,
    "op13_pivot_negatives": pivot_negatives.op13_pivot_negatives,
}

ORACLE_SQL: dict[str, str] = {
    "op1_multi_index": multi_index.ORACLE,
    "op6_url_cascade": url_cascade.ORACLE,
    "op7_warc": warc.ORACLE,
    "op8_line_rules": line_rules.ORACLE,
    "op9_chosen_path": chosen_path.ORACLE,
    "op13_pivot_negatives": pivot_negatives.ORACLE,
}
