"""The queries of this package, with SQL twins where SQL can say them."""

from __future__ import annotations

import corpus_pipeline

from tidemark.llm import bpe, chat, decontaminate, edits, html, infill, licenses, neighbours, pii, simhash, toxicity, trie, urls
from tidemark.llm.common import Registered

QUERIES: dict[str, Registered] = {
    "op1_decontamination": Registered(decontaminate.op1_decontamination, None),
    "op3_simhash": Registered(simhash.op3_simhash, None),
    "op2_html": Registered(html.op2_html, None),
    "op4_toxicity": Registered(toxicity.op4_toxicity, None),
    "op5_urls": Registered(urls.op5_urls, urls.SQL),
    "op6_bpe": Registered(bpe.op6_bpe, None),
    "op7_pii": Registered(pii.op7_pii, None),
    "op8_token_counts": Registered(edits.op8_token_counts, None),
    "op9_licenses": Registered(licenses.op9_licenses, licenses.SQL),
    "op10_neighbours": Registered(neighbours.op10_neighbours, None),
    "op11_infill": Registered(infill.op11_infill, infill.SQL),
    "op12_prefix_trie": Registered(trie.op12_prefix_trie, trie.SQL),
    "op13_chat": Registered(chat.op13_chat, chat.SQL),
    "pipeline": Registered(corpus_pipeline.run, corpus_pipeline.ORACLE_SQL),
}
