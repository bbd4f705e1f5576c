"""The queries of this folder and their SQL, by name, for the driver's entry file."""

from __future__ import annotations

from quire.llm import exact_dedup, fingerprints, language_id, licenses, mixing, packing, secrets, sharding, simhash_dedup, substring_dedup
from quire.llm._common import documents

QUERIES = {
    "op1_substring_dedup": substring_dedup.op1,
    "op2_fingerprints": fingerprints.op2,
    "op3_language_id": language_id.op3,
    "op4_secrets": secrets.op4,
    "op5_mixing": lambda spark, sf_dir: mixing.mix(documents(spark, sf_dir)).drop("source"),
    "op6_packing": packing.op6,
    "op7_licenses": licenses.op7,
    "op8_simhash_dedup": simhash_dedup.op8,
    "op9_exact_dedup": lambda spark, sf_dir: exact_dedup.exact_dedup(documents(spark, sf_dir)),
    "op10_sharding": sharding.op10,
}

ORACLE_SQL = {
    "op1_substring_dedup": substring_dedup.ORACLE,
    "op9_exact_dedup": exact_dedup.ORACLE,
}
