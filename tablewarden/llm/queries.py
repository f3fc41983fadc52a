"""The queries of this subpackage by name, and the SQL they must agree with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tablewarden.llm import (
    chat, decontaminate, jaccard_join, licenses, merkle, mixing, quality, secrets, sharding, simhash, substring, token_files, turn_trie,
)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_token_files": token_files.query,
    "op2_repeated_passages": substring.query,
    "op3_benchmark_decontamination": decontaminate.query,
    "op4_simhash_near_duplicates": simhash.query,
    "op5_chat_formatting": chat.query,
    "op6_quality_rules": quality.query,
    "op7_jump_shards": sharding.query,
    "op8_curriculum_mix": mixing.query,
    "op9_secret_ledger": secrets.query,
    "op10_license_sentences": licenses.query,
    "op11_jaccard_join": jaccard_join.query,
    "op12_merkle_manifest": merkle.query,
    "op13_burst_trie": turn_trie.query,
}

#: Where SQL can say it; the other queries are held against brute force in the tests.
SQL: dict[str, str] = {
    "op5_chat_formatting": chat.SQL,
    "op10_license_sentences": licenses.SQL,
    "op11_jaccard_join": jaccard_join.SQL,
    "op13_burst_trie": turn_trie.SQL,
}
