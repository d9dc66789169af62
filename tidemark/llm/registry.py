"""Queries of the training-data operators, and DuckDB SQL where SQL can express one."""

from __future__ import annotations

from .chat import OP7_SQL, op7_chat_formatting
from .fingerprints import op6_fingerprints
from .line_dedup import OP10_SQL, op10_line_dedup
from .mixing import op2_mixing
from .near_dedup import OP5_SQL, op5_near_dedup
from .nearest import OP8_SQL, op8_nearest_neighbours
from .packing import op9_packing
from .token_counts import op3_token_counts
from .toxicity import op1_toxicity
from .url_filter import op4_url_filter

QUERIES = {
    "op1_toxicity": op1_toxicity,
    "op2_mixing": op2_mixing,
    "op3_token_counts": op3_token_counts,
    "op4_url_filter": op4_url_filter,
    "op5_near_dedup": op5_near_dedup,
    "op6_fingerprints": op6_fingerprints,
    "op7_chat_formatting": op7_chat_formatting,
    "op8_nearest_neighbours": op8_nearest_neighbours,
    "op9_packing": op9_packing,
    "op10_line_dedup": op10_line_dedup,
}

ORACLE_SQL = {
    "op5_near_dedup": OP5_SQL,
    "op7_chat_formatting": OP7_SQL,
    "op8_nearest_neighbours": OP8_SQL,
    "op10_line_dedup": OP10_SQL,
}
