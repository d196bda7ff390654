"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from .byte_bpe import op10_byte_bpe
from .context_tree import op8_lm_scoring
from .divergence import ORACLE as DIVERGENCE_ORACLE
from .divergence import op11_source_divergence
from .exact_dedup import ORACLE as EXACT_ORACLE
from .exact_dedup import op1_exact_dedup
from .line_dedup import ORACLE as LINE_ORACLE
from .line_dedup import op13_line_dedup
from .packing import op3_best_fit_packing
from .periodic_runs import op12_periodic_runs
from .quality import ORACLE as QUALITY_ORACLE
from .quality import op9_quality_rules
from .simhash import op7_simhash
from .suffix_dedup import op2_suffix_dedup
from .token_counts import op4_token_counts
from .token_files import op5_token_files
from .window_dedup import ORACLE as WINDOW_ORACLE
from .window_dedup import op6_window_dedup

QUERIES = {
    f.__name__: f
    for f in (
        op1_exact_dedup,
        op2_suffix_dedup,
        op3_best_fit_packing,
        op4_token_counts,
        op5_token_files,
        op6_window_dedup,
        op7_simhash,
        op8_lm_scoring,
        op9_quality_rules,
        op10_byte_bpe,
        op11_source_divergence,
        op12_periodic_runs,
        op13_line_dedup,
    )
}

ORACLES = {
    "op1_exact_dedup": EXACT_ORACLE,
    "op6_window_dedup": WINDOW_ORACLE,
    "op9_quality_rules": QUALITY_ORACLE,
    "op11_source_divergence": DIVERGENCE_ORACLE,
    "op13_line_dedup": LINE_ORACLE,
}
