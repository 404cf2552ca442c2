"""Registry of this package's queries and of their SQL, where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import decontamination, fingerprints, html_text, merkle, minhash, packing, quality, sharding, spelling, substrings, token_files, toxicity, url_reputation

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_text_density": html_text.op1,
    "op2_compact_windows": substrings.op2,
    "op3_factorization_toxicity": toxicity.op3,
    "op4_url_reputation": url_reputation.op4,
    "op5_spaced_seeds": decontamination.op5,
    "op6_minhash_near_dedup": minhash.op6,
    "op7_feistel_sharding": sharding.op7,
    "op8_pattern_packing": packing.op8,
    "op9_elias_fano": token_files.op9,
    "op10_ngram_quality": quality.op10,
    "op11_merkle_manifest": merkle.op11,
    "op12_bloom_spelling": spelling.op12,
    "op13_consistent_parsing": fingerprints.op13,
}
ORACLES: dict[str, str] = {
    "op4_url_reputation": url_reputation.OP4_SQL,
    "op7_feistel_sharding": sharding.OP7_SQL,
    "op11_merkle_manifest": merkle.OP11_SQL,
    "op12_bloom_spelling": spelling.OP12_SQL,
}
