"""Queries of this subpackage and the SQL of those that SQL can express."""

from __future__ import annotations

from .fair_mix import OP8_SQL, op8_fair_mix
from .filter_audit import OP13_SQL, op13_filter_audit
from .importance_chunks import OP12_SQL, op12_importance_chunks
from .kk_sharding import op5_kk_sharding
from .line_frequency import OP7_SQL, op7_line_frequency
from .merkle_fixity import OP1_SQL, op1_merkle_fixity
from .nbsvm import op4_nbsvm
from .secret_scan import OP11_SQL, op11_secret_scan
from .simhash_bktree import op10_simhash_bktree
from .suffix_dedup import op2_suffix_dedup
from .text_density import op9_text_density
from .token_rollup import op3_token_rollup
from .winnowing import op6_winnowing

QUERIES = {
    "op1_merkle_fixity": op1_merkle_fixity,
    "op2_suffix_dedup": op2_suffix_dedup,
    "op3_token_rollup": op3_token_rollup,
    "op4_nbsvm": op4_nbsvm,
    "op5_kk_sharding": op5_kk_sharding,
    "op6_winnowing": op6_winnowing,
    "op7_line_frequency": op7_line_frequency,
    "op8_fair_mix": op8_fair_mix,
    "op9_text_density": op9_text_density,
    "op10_simhash_bktree": op10_simhash_bktree,
    "op11_secret_scan": op11_secret_scan,
    "op12_importance_chunks": op12_importance_chunks,
    "op13_filter_audit": op13_filter_audit,
}

ORACLE_SQL = {"op1_merkle_fixity": OP1_SQL, "op7_line_frequency": OP7_SQL, "op8_fair_mix": OP8_SQL, "op11_secret_scan": OP11_SQL, "op12_importance_chunks": OP12_SQL, "op13_filter_audit": OP13_SQL}
