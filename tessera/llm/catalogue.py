"""The queries of this subpackage and their SQL, where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

import corpus_pipeline

from .decontamination import OP2_SQL, op2_benchmark_decontamination
from .html_text import op8_site_style_tree
from .language_model import op6_kneser_ney_quality
from .near_dedup import op3_dart_minhash
from .packing import op4_hilbert_packing
from .paragraph_dedup import op1_paragraph_minhash
from .quality_rules import OP9_SQL, op9_quality_cascade
from .substring_tree import op10_prefix_interval_tree
from .toxicity import op5_compression_toxicity
from .sharding import OP7_SQL, op7_rendezvous_sharding

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_paragraph_minhash": op1_paragraph_minhash,
    "op2_benchmark_decontamination": op2_benchmark_decontamination,
    "op3_dart_minhash": op3_dart_minhash,
    "op4_hilbert_packing": op4_hilbert_packing,
    "op5_compression_toxicity": op5_compression_toxicity,
    "op6_kneser_ney_quality": op6_kneser_ney_quality,
    "op7_rendezvous_sharding": op7_rendezvous_sharding,
    "op8_site_style_tree": op8_site_style_tree,
    "op9_quality_cascade": op9_quality_cascade,
    "op10_prefix_interval_tree": op10_prefix_interval_tree,
    "pipeline": corpus_pipeline.run,
}

ORACLE_SQL: dict[str, str] = {
    "op2_benchmark_decontamination": OP2_SQL,
    "op7_rendezvous_sharding": OP7_SQL,
    "op9_quality_cascade": OP9_SQL,
}
