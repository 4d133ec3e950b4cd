"""Queries of this subpackage and their SQL, where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm.alignment import op13_token_alignment
from tidemark.llm.ann import op4_nearest_neighbours
from tidemark.llm.filter_audit import OP11_SQL, op11_filter_audit
from tidemark.llm.license_scan import op2_license_scan
from tidemark.llm.minhash import op1_minhash_near_dedup
from tidemark.llm.packing import op6_packing
from tidemark.llm.pieces import op8_sentencepiece
from tidemark.llm.quality import op5_quality_rules
from tidemark.llm.sharding import OP10_SQL, op10_sharding
from tidemark.llm.token_count import op3_token_counts
from tidemark.llm.token_files import op7_token_files
from tidemark.llm.top_products import OP12_SQL, op12_top_products
from tidemark.llm.toxicity import op9_toxicity

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_minhash_near_dedup": op1_minhash_near_dedup,
    "op2_license_scan": op2_license_scan,
    "op3_token_counts": op3_token_counts,
    "op4_nearest_neighbours": op4_nearest_neighbours,
    "op5_quality_rules": op5_quality_rules,
    "op6_packing": op6_packing,
    "op7_token_files": op7_token_files,
    "op8_sentencepiece": op8_sentencepiece,
    "op9_toxicity": op9_toxicity,
    "op10_sharding": op10_sharding,
    "op11_filter_audit": op11_filter_audit,
    "op12_top_products": op12_top_products,
    "op13_token_alignment": op13_token_alignment,
}

ORACLE_SQL = {"op10_sharding": OP10_SQL, "op11_filter_audit": OP11_SQL, "op12_top_products": OP12_SQL}
