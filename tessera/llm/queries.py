"""The registered queries of this subpackage and their oracles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .embedding_dedup import OP2_SQL, op2_embedding_dedup
from .exact_dedup import OP7_SQL, op7_exact_dedup
from .license_scan import op9_license_scan, op9_sql
from .lm_scoring import op12_lm_scoring
from .mixing import op5_entropy_mixing
from .near_dedup import OP8_SQL, op8_minhash_near_dedup
from .packing import op10_slack_packing
from .prefix_trie import OP11_SQL, op11_prefix_trie
from .spelling import OP13_SQL, op13_spelling_groups
from .substring_dedup import OP4_SQL, op4_substring_dedup
from .suffix_dedup import op1_suffix_dedup
from .toxicity import op3_toxicity
from .warc import op6_warc_segments


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    named = (
        op1_suffix_dedup, op2_embedding_dedup, op3_toxicity, op4_substring_dedup, op5_entropy_mixing,
        op6_warc_segments, op7_exact_dedup, op8_minhash_near_dedup, op9_license_scan, op10_slack_packing,
        op11_prefix_trie, op12_lm_scoring, op13_spelling_groups,
    )
    return {f.__name__: f for f in named}


def oracle_sql() -> dict[str, str]:
    return {
        "op2_embedding_dedup": OP2_SQL, "op4_substring_dedup": OP4_SQL, "op7_exact_dedup": OP7_SQL, "op8_minhash_near_dedup": OP8_SQL,
        "op9_license_scan": op9_sql(), "op11_prefix_trie": OP11_SQL, "op13_spelling_groups": OP13_SQL,
    }
