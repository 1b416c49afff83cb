"""The corpus queries, each over its whole table, and the SQL of those that SQL can express."""

from __future__ import annotations

from plumbline.llm import bpe, divergence, fingerprints, language, licenses, minhash, mixing, neighbours, passages, pii, quality, secrets, whitening

QUERIES = {
    "op1_minhash_near_dedup": minhash.query,
    "op2_bpe_roundtrip": bpe.query,
    "op3_license_scan": licenses.query,
    "op4_pii_disclosure": pii.query,
    "op5_passage_dedup": passages.query,
    "op6_language_id": language.query,
    "op7_secret_scan": secrets.query,
    "op8_multiprobe_neighbours": neighbours.query,
    "op9_line_quality": quality.query,
    "op10_pareto_mixing": mixing.query,
    "op11_weighted_fingerprints": fingerprints.query,
    "op12_source_divergence": divergence.query,
    "op13_embedding_whitening": whitening.query,
}

ORACLE_SQL: dict[str, str] = {
    "op1_minhash_near_dedup": minhash.ORACLE_SQL,
    "op4_pii_disclosure": pii.ORACLE_SQL,
    "op5_passage_dedup": passages.ORACLE_SQL,
    "op7_secret_scan": secrets.ORACLE_SQL,
    "op9_line_quality": quality.ORACLE_SQL,
    "op10_pareto_mixing": mixing.ORACLE_SQL,
    "op11_weighted_fingerprints": fingerprints.ORACLE_SQL,
    "op12_source_divergence": divergence.ORACLE_SQL,
}
