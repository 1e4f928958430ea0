"""Queries of the training-data operators, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

from .exact import OP10_SQL, op10_exact_dedup
from .fingerprint import op7_fingerprint
from .html import op1_html_extract
from .langid import op9_langid
from .lm import op6_lattice_lm
from .minhash import op8_minhash
from .mixing import OP4_SQL, op4_mixing
from .negatives import OP13_SQL, op13_hard_negatives
from .packing import op2_packing
from .phrases import OP11_SQL, op11_collocations
from .secrets import op5_secrets
from .toxicity import op3_toxicity
from .urls import OP12_SQL, op12_url_filter

QUERIES = {f.__name__: f for f in (op1_html_extract, op2_packing, op3_toxicity, op4_mixing, op5_secrets, op6_lattice_lm, op7_fingerprint, op8_minhash, op9_langid, op10_exact_dedup, op11_collocations, op12_url_filter, op13_hard_negatives)}

ORACLE_SQL = {"op4_mixing": OP4_SQL, "op10_exact_dedup": OP10_SQL, "op11_collocations": OP11_SQL, "op12_url_filter": OP12_SQL, "op13_hard_negatives": OP13_SQL}
