"""The numbered queries and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from hexrisk.llm import dedup, edit_fingerprint, jaccard, mixing, neighbours, packing, periodic, records, secret_scan, toxicity, urls, vector_codes, warc

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_pack_sequences": packing.op1,
    "op2_mix_sources": mixing.op2,
    "op3_url_filter": urls.op3,
    "op4_toxicity": toxicity.op4,
    "op5_exact_dedup": dedup.op5,
    "op6_jaccard_join": jaccard.op6,
    "op7_warc_index": warc.op7,
    "op8_binary_records": records.op8,
    "op9_posting_lists": neighbours.op9,
    "op10_secret_scan": secret_scan.op10,
    "op11_word_runs": periodic.op11,
    "op12_vector_codes": vector_codes.op12,
    "op13_edit_fingerprint": edit_fingerprint.op13,
}

ORACLES: dict[str, str] = {
    "op5_exact_dedup": dedup.ORACLE,
    "op6_jaccard_join": jaccard.ORACLE,
    "op7_warc_index": warc.ORACLE,
    "op11_word_runs": periodic.ORACLE,
    "op12_vector_codes": vector_codes.ORACLE,
}
