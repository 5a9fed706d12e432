"""The queries of this subpackage, and the SQL of those that SQL can express."""

from __future__ import annotations

from graphloom.llm import bpe, crossent, decontam, jaccard, langid, simple8b, topk, toxicity, urls, warc

QUERIES = {
    "op1_toxicity": toxicity.query,
    "op2_language_id": langid.query,
    "op3_url_filters": urls.query,
    "op4_exact_top_k": topk.query,
    "op5_decontamination": decontam.query,
    "op6_simple8b": simple8b.query,
    "op7_ngram_jaccard_join": jaccard.query,
    "op8_byte_bpe": bpe.query,
    "op9_warc": warc.query,
    "op10_cross_entropy_difference": crossent.query,
}

ORACLE: dict[str, str] = {"op3_url_filters": urls.ORACLE, "op4_exact_top_k": topk.ORACLE, "op7_ngram_jaccard_join": jaccard.ORACLE, "op9_warc": warc.ORACLE}
