"""The queries of this package, and their SQL where SQL can express them."""

from __future__ import annotations

from .alignment import op13_alignment
from .decontamination import op8_decontamination
from .importance import OP12_SQL, op12_importance
from .line_dedup import op3_line_dedup
from .lm_scoring import op1_lm_scoring
from .mixing import op7_mixing
from .near_dedup import OP9_SQL, op9_near_dedup
from .quality import op5_quality
from .simhash import op11_simhash
from .suffix_dedup import OP10_SQL, op10_suffix_dedup
from .token_counts import op6_token_counts
from .topk_search import OP4_SQL, op4_topk_search
from .toxicity import op2_toxicity

QUERIES = {
    "op1_lm_scoring": op1_lm_scoring,
    "op2_toxicity": op2_toxicity,
    "op3_line_dedup": op3_line_dedup,
    "op4_topk_search": op4_topk_search,
    "op5_quality": op5_quality,
    "op6_token_counts": op6_token_counts,
    "op7_mixing": op7_mixing,
    "op8_decontamination": op8_decontamination,
    "op9_near_dedup": op9_near_dedup,
    "op10_suffix_dedup": op10_suffix_dedup,
    "op11_simhash": op11_simhash,
    "op12_importance": op12_importance,
    "op13_alignment": op13_alignment,
}
SQL = {"op4_topk_search": OP4_SQL, "op9_near_dedup": OP9_SQL, "op10_suffix_dedup": OP10_SQL, "op12_importance": OP12_SQL}
