"""The queries of this subpackage, and the SQL of those that SQL can express."""

from __future__ import annotations

from quadloom.llm import topk
from quadloom.llm.bpe import op4_bpe
from quadloom.llm.language import op8_language
from quadloom.llm.mixing import op10_mixing
from quadloom.llm.near import op6_near
from quadloom.llm.pii import op1_pii
from quadloom.llm.repetition import op2_repetition
from quadloom.llm.resampling import op7_resampling
from quadloom.llm.sharding import op3_sharding
from quadloom.llm.substrings import op5_substrings

QUERIES = {
    "op1_pii": op1_pii,
    "op2_repetition": op2_repetition,
    "op3_sharding": op3_sharding,
    "op4_bpe": op4_bpe,
    "op5_substrings": op5_substrings,
    "op6_near": op6_near,
    "op7_resampling": op7_resampling,
    "op8_language": op8_language,
    "op9_topk": topk.op9_topk,
    "op10_mixing": op10_mixing,
}
ORACLE_SQL: dict[str, str] = {
    "op9_topk": topk.SQL,
}
