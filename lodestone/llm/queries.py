"""The training-data queries by name, and the SQL that checks those that SQL can express."""

from __future__ import annotations

from lodestone.llm import decontaminate, host_rules, html_text, jaccard, merkle, mixing, passages, pii, quality, ranked, secrets, vectors, warc

QUERIES = {
    "op1_secret_scan": secrets.query,
    "op2_embedding_near_dedup": vectors.query,
    "op3_pii": pii.query,
    "op4_html_text": html_text.query,
    "op5_quality_classifier": quality.query,
    "op6_ngram_jaccard_join": jaccard.query,
    "op7_warc": warc.query,
    "op8_substring_dedup": passages.query,
    "op9_source_mixing": mixing.query,
    "op10_benchmark_decontamination": decontaminate.query,
    "op11_merkle_manifest": merkle.query,
    "op12_host_rules": host_rules.query,
    "op13_ranked_search": ranked.query,
}
ORACLE_SQL = {
    "op1_secret_scan": secrets.SECRETS_SQL,
    "op2_embedding_near_dedup": vectors.VECTORS_SQL,
    "op6_ngram_jaccard_join": jaccard.JACCARD_SQL,
    "op7_warc": warc.WARC_SQL,
    "op8_substring_dedup": passages.PASSAGES_SQL,
    "op9_source_mixing": "with " + mixing.MIX_SQL.format(docs="documents"),
    "op11_merkle_manifest": merkle.MERKLE_SQL,
    "op12_host_rules": host_rules.HOST_SQL,
    "op13_ranked_search": ranked.RANKED_SQL,
}
