"""The queries of the training-data operators, and their SQL where SQL can say the same."""

from __future__ import annotations

from . import chat, decontaminate, embeddings, fill_middle, html_text, merkle, packing, pii, quality, simhash, token_files, url_graph, warc

QUERIES = {
    "op1_chat": chat.op1_chat,
    "op2_embeddings": embeddings.op2_embeddings,
    "op3_token_files": token_files.op3_token_files,
    "op4_decontamination": decontaminate.op4_decontamination,
    "op5_simhash": simhash.op5_simhash,
    "op6_html": html_text.op6_html,
    "op7_pii": pii.op7_pii,
    "op8_quality": quality.op8_quality,
    "op9_packing": packing.op9_packing,
    "op10_urls": url_graph.op10_urls,
    "op11_warc": warc.op11_warc,
    "op12_merkle": merkle.op12_merkle,
    "op13_fill_middle": fill_middle.op13_fill_middle,
}
ORACLE_SQL = {"op1_chat": chat.ORACLE, "op11_warc": warc.ORACLE, "op12_merkle": merkle.ORACLE, "op13_fill_middle": fill_middle.ORACLE}
