"""Queries of the training-data operators, by name, and the SQL that states them where SQL can."""

from __future__ import annotations

from .ann import op9_permutation_index
from .bpe_codec import op7_bpe_codec
from .embed_dedup import op8_cross_polytope
from .filter_audit import op13_filter_audit
from .language import op6_language
from .line_dedup import op1_line_dedup
from .lm_score import op2_lm_score
from .minhash import op5_minhash
from .mixing import op4_mixing
from .oracles import OP5, OP8, OP12, OP13
from .shards import op10_sharding
from .token_counts import op3_token_counts
from .url_filters import op12_url_filters
from .whitening import op11_whitening

QUERIES = {
    "op1_line_dedup": op1_line_dedup,
    "op2_lm_score": op2_lm_score,
    "op3_token_counts": op3_token_counts,
    "op4_mixing": op4_mixing,
    "op5_minhash": op5_minhash,
    "op6_language": op6_language,
    "op7_bpe_codec": op7_bpe_codec,
    "op8_cross_polytope": op8_cross_polytope,
    "op9_permutation_index": op9_permutation_index,
    "op10_sharding": op10_sharding,
    "op11_whitening": op11_whitening,
    "op12_url_filters": op12_url_filters,
    "op13_filter_audit": op13_filter_audit,
}
ORACLE_SQL = {"op5_minhash": OP5, "op8_cross_polytope": OP8, "op12_url_filters": OP12, "op13_filter_audit": OP13}
