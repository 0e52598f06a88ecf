"""The queries of this subpackage, by name, and the SQL of those that SQL can express."""

from __future__ import annotations

from .decontaminate import op10_decontamination
from .filter_audit import OP13_SQL, op13_filter_audit
from .language_id import op9_language_id
from .line_dedup import OP2_SQL, op2_line_dedup
from .lm_scoring import op8_lm_scoring
from .mixing import op4_mixing
from .order_minhash import op7_order_minhash
from .phrases import OP12_SQL, op12_phrases
from .secrets import OP11_SQL, op11_secrets
from .simhash import op5_simhash_near_dedup
from .suffix_dedup import op1_suffix_dedup
from .token_output import op6_token_output
from .toxicity import op3_toxicity

QUERIES = {
    "op1_suffix_dedup": op1_suffix_dedup,
    "op2_line_dedup": op2_line_dedup,
    "op3_toxicity": op3_toxicity,
    "op4_mixing": op4_mixing,
    "op5_simhash_near_dedup": op5_simhash_near_dedup,
    "op6_token_output": op6_token_output,
    "op7_order_minhash": op7_order_minhash,
    "op8_lm_scoring": op8_lm_scoring,
    "op9_language_id": op9_language_id,
    "op10_decontamination": op10_decontamination,
    "op11_secrets": op11_secrets,
    "op12_phrases": op12_phrases,
    "op13_filter_audit": op13_filter_audit,
}

ORACLES = {
    "op2_line_dedup": OP2_SQL,
    "op11_secrets": OP11_SQL,
    "op12_phrases": OP12_SQL,
    "op13_filter_audit": OP13_SQL,
}
