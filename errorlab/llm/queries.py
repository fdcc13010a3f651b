"""The package's registered queries and their SQL."""

from __future__ import annotations

from .decontaminate import OP7_SQL, op7_decontaminate
from .exact_dedup import OP8_SQL, op8_exact_dedup
from .fill_middle import OP12_SQL, op12_fill_in_middle
from .lines import op9_line_dedup
from .manifest import OP11_SQL, op11_merkle_manifest
from .near_dedup import op5_near_dedup
from .packing import op4_best_fit_packing
from .pieces import op13_piece_codec
from .quality import op3_quality
from .repeats import op6_suffix_dedup
from .secrets import op1_secret_scan
from .token_output import op10_token_output
from .toxicity import op2_toxicity

QUERIES = {f.__name__: f for f in (
    op1_secret_scan, op2_toxicity, op3_quality, op4_best_fit_packing, op5_near_dedup, op6_suffix_dedup,
    op7_decontaminate, op8_exact_dedup, op9_line_dedup, op10_token_output, op11_merkle_manifest,
    op12_fill_in_middle, op13_piece_codec)}
ORACLE_SQL = {"op7_decontaminate": OP7_SQL, "op8_exact_dedup": OP8_SQL, "op11_merkle_manifest": OP11_SQL,
              "op12_fill_in_middle": OP12_SQL}
