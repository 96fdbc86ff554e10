"""Registry of this subpackage: query name to function of (spark, sf_dir), and DuckDB SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import bpe, decontaminate, langid, neighbours, quality, secrets, simhash, substrings, tokenids, warc

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_language_bitmasks": langid.query,
    "op2_token_id_files": tokenids.query,
    "op3_bpe_trie": bpe.query,
    "op4_secret_ownership": secrets.query,
    "op5_ivf_pq_neighbours": neighbours.query,
    "op6_winnowed_contamination": decontaminate.query,
    "op7_warc_members": warc.query,
    "op8_compression_quality": quality.query,
    "op9_substring_doubling": substrings.query,
    "op10_simhash_components": simhash.query,
}

ORACLE_SQL: dict[str, str] = {
    "op4_secret_ownership": secrets.ORACLE,
    "op6_winnowed_contamination": decontaminate.ORACLE,
    "op7_warc_members": warc.ORACLE,
    "op9_substring_doubling": substrings.ORACLE,
}
