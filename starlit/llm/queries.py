"""Registered queries of the training-data operators, and their SQL twins where SQL can state them.

Rows that SQL cannot state (pseudorandom mixing, tokenizers, trained scores, curve positions, 75 % similarity of
whole shingle sets at this size) are tested against brute-force versions in ``tests/llm``.
"""

from __future__ import annotations

from starlit.llm.decontaminate import OP2_SQL, op2_decontaminate
from starlit.llm.exact_dedup import OP1_SQL, op1_exact_dedup
from starlit.llm.hilbert import op7_hilbert_shards
from starlit.llm.merkle import OP13_SQL, op13_merkle_manifest
from starlit.llm.mixing import op3_mix_sources
from starlit.llm.near_dedup import op9_near_dedup
from starlit.llm.ngram_lm import op10_lm_score
from starlit.llm.private_data import op11_private_data
from starlit.llm.quality import op6_quality
from starlit.llm.resample import OP12_SQL, op12_importance_resample
from starlit.llm.token_files import op4_token_files
from starlit.llm.toxicity import op8_toxicity
from starlit.llm.url_filter import OP5_SQL, op5_url_filter

QUERIES = {f.__name__: f for f in (
    op1_exact_dedup, op2_decontaminate, op3_mix_sources, op4_token_files, op5_url_filter, op6_quality,
    op7_hilbert_shards, op8_toxicity, op9_near_dedup, op10_lm_score, op11_private_data, op12_importance_resample, op13_merkle_manifest)}

SQL: dict[str, str] = {
    "op1_exact_dedup": OP1_SQL,
    "op2_decontaminate": OP2_SQL,
    "op5_url_filter": OP5_SQL,
    "op12_importance_resample": OP12_SQL,
    "op13_merkle_manifest": OP13_SQL,
}
