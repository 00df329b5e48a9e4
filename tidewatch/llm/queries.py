"""The corpus queries by name, and the SQL for those that SQL can express."""

from __future__ import annotations

from tidewatch.llm import bpe, decontaminate, html_text, line_dedup, merkle, near_dup, packing, quality, topk, toxicity, url_graph, vec_codes, vec_dedup

QUERIES = {
    "op1_html_text": html_text.query,
    "op2_line_dedup": line_dedup.query,
    "op3_minhash": near_dup.query,
    "op4_quality": quality.query,
    "op5_toxicity": toxicity.query,
    "op6_vec_dedup": vec_dedup.query,
    "op7_url_graph": url_graph.query,
    "op8_packing": packing.query,
    "op9_topk": topk.query,
    "op10_bpe": bpe.query,
    "op11_decontaminate": decontaminate.query,
    "op12_vec_codes": vec_codes.query,
    "op13_merkle": merkle.query,
}

ORACLES = {
    "op2_line_dedup": line_dedup.SQL,
    "op9_topk": topk.SQL,
    "op11_decontaminate": decontaminate.SQL,
    "op12_vec_codes": vec_codes.SQL,
    "op13_merkle": merkle.SQL,
}
