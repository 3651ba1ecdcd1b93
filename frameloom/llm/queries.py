"""Queries of the training-data operators and, where SQL can express them, their oracles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import exact_dedup, fingerprints, html_text, language, minhash, mixing, packing, runs, sharding, suffix_dedup, time_layout, toxicity, wavelet

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_toxicity": toxicity.op1_toxicity,
    "op2_exact_dedup": exact_dedup.op2_exact_dedup,
    "op3_packing": packing.op3_packing,
    "op4_suffix_dedup": suffix_dedup.op4_suffix_dedup,
    "op5_fingerprints": fingerprints.op5_fingerprints,
    "op6_html_text": html_text.op6_html_text,
    "op7_sharding": sharding.op7_sharding,
    "op8_mixing": mixing.op8_mixing,
    "op9_language": language.op9_language,
    "op10_minhash": minhash.op10_minhash,
    "op11_wavelet": wavelet.op11_wavelet,
    "op12_runs": runs.op12_runs,
    "op13_time_layout": time_layout.op13_time_layout,
}
ORACLES: dict[str, str] = {
    "op2_exact_dedup": exact_dedup.SQL,
    "op8_mixing": mixing.SQL,
}
