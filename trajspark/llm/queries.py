"""Queries and DuckDB SQL of the subpackage, for __spark_entry__.py."""

from __future__ import annotations

from .hard_negatives import OP12_SQL, op12_hard_negatives
from .jaccard_join import OP7_SQL, op7_jaccard_join
from .licences import op6_licence_scan
from .lm_scoring import op4_lm_scoring
from .merkle import OP13_SQL, op13_merkle_manifest
from .mixing import OP3_SQL, op3_mix_sources
from .packing import op1_best_fit_packing
from .quality import OP9_SQL, op9_quality_rules
from .search import OP5_SQL, op5_top_k_search
from .simhash import op11_simhash_near_dedup
from .token_counts import op10_token_counts
from .token_files import op2_token_files
from .toxicity import op8_toxicity

QUERIES = {
    "op1_best_fit_packing": op1_best_fit_packing,
    "op2_token_files": op2_token_files,
    "op3_mix_sources": op3_mix_sources,
    "op4_lm_scoring": op4_lm_scoring,
    "op5_top_k_search": op5_top_k_search,
    "op6_licence_scan": op6_licence_scan,
    "op7_jaccard_join": op7_jaccard_join,
    "op8_toxicity": op8_toxicity,
    "op9_quality_rules": op9_quality_rules,
    "op10_token_counts": op10_token_counts,
    "op11_simhash_near_dedup": op11_simhash_near_dedup,
    "op12_hard_negatives": op12_hard_negatives,
    "op13_merkle_manifest": op13_merkle_manifest,
}

ORACLES: dict[str, str] = {
    "op3_mix_sources": OP3_SQL,
    "op5_top_k_search": OP5_SQL,
    "op7_jaccard_join": OP7_SQL,
    "op9_quality_rules": OP9_SQL,
    "op12_hard_negatives": OP12_SQL,
    "op13_merkle_manifest": OP13_SQL,
}
