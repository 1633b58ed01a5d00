"""Queries of the operators and their SQL checks."""

from __future__ import annotations

from pagetide.llm import (
    archives, contamination, jaccard, manifest, mixing, neighbours, oracles, quality, secret_scan, sharding, suffixes, token_counts, toxicity,
    vector_codes,
)

QUERIES = {
    "op1_neighbours": neighbours.op1_neighbours,
    "op2_contamination": contamination.op2_contamination,
    "op3_quality": quality.op3_quality,
    "op4_repeats": suffixes.op4_repeats,
    "op5_mixing": mixing.op5_mixing,
    "op6_toxicity": toxicity.op6_toxicity,
    "op7_jaccard": jaccard.op7_jaccard,
    "op8_warc": archives.op8_warc,
    "op9_sharding": sharding.op9_sharding,
    "op10_secrets": secret_scan.op10_secrets,
    "op11_vector_codes": vector_codes.op11_vector_codes,
    "op12_manifest": manifest.op12_manifest,
    "op13_token_counts": token_counts.op13_token_counts,
}
ORACLES = {
    "op5_mixing": oracles.MIXING,
    "op8_warc": oracles.ARCHIVES,
    "op10_secrets": oracles.SECRETS,
    "op11_vector_codes": oracles.VECTOR_CODES,
    "op12_manifest": oracles.MANIFEST,
}
