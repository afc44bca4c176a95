"""The registered queries of this subpackage and the DuckDB SQL of those that SQL can express."""

from __future__ import annotations

from .alignment import op11_tokenizer_alignment
from .cuckoo import ORACLE_OP7, op7_exact_dedup
from .importance import ORACLE_OP13, op13_importance_resampling
from .langid import op6_language_id
from .lmscore import op9_lm_scoring
from .mainhtml import op5_html_extraction
from .minhash import op3_document_fingerprints
from .packing import op8_best_fit_packing
from .pieces import op4_sentencepiece
from .simhash import op1_simhash_near_dedup
from .substrings import ORACLE_OP10, op10_substring_dedup
from .tokencounts import op2_token_counts
from .urls import op12_url_filters

QUERIES = {
    f.__name__: f
    for f in (
        op1_simhash_near_dedup,
        op2_token_counts,
        op3_document_fingerprints,
        op4_sentencepiece,
        op5_html_extraction,
        op6_language_id,
        op7_exact_dedup,
        op8_best_fit_packing,
        op9_lm_scoring,
        op10_substring_dedup,
        op11_tokenizer_alignment,
        op12_url_filters,
        op13_importance_resampling,
    )
}

ORACLE_SQL = {"op7_exact_dedup": ORACLE_OP7, "op10_substring_dedup": ORACLE_OP10, "op13_importance_resampling": ORACLE_OP13}
