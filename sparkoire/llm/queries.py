"""Registered queries of this subpackage and their DuckDB statements."""

from __future__ import annotations

from . import decontam, linededup, merkle, neardup, packing, quality, secrets, sharding, substring, suffix
from .oracles import ORACLES  # noqa: F401  part of the registration

QUERIES = {
    "op1_minhash_components": neardup.op1_minhash_components,
    "op2_substring_repeats": substring.op2_substring_repeats,
    "op3_quality_qda": quality.op3_quality_qda,
    "op4_feistel_shards": sharding.op4_feistel_shards,
    "op5_cgk_decontamination": decontam.op5_cgk_decontamination,
    "op6_merkle_fingerprints": merkle.op6_merkle_fingerprints,
    "op7_vector_packing": packing.op7_vector_packing,
    "op8_suffix_repeats": suffix.op8_suffix_repeats,
    "op9_secret_ownership": secrets.op9_secret_ownership,
    "op10_line_dedup": linededup.op10_line_dedup,
}
