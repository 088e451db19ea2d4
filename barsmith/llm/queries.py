"""The registered corpus queries and their SQL."""

from __future__ import annotations

from .chat import ORACLE_OP7, op7_snapshot_collapse
from .minhash import ORACLE_OP5, op5_minhash_inverted
from .mixing import ORACLE_OP6, op6_curriculum_mix
from .pieces import op10_merge_dropout
from .quality import op1_quality_llr
from .secrets import op8_secret_spans
from .suffixes import op2_suffix_dedup
from .urls import op9_url_vocabulary, oracle_op9
from .vectors import ORACLE_OP4, op4_int8_tiles
from .wavelet import op3_wavelet_shards

QUERIES = {
    f.__name__: f
    for f in (op1_quality_llr, op2_suffix_dedup, op3_wavelet_shards, op4_int8_tiles, op5_minhash_inverted, op6_curriculum_mix, op7_snapshot_collapse,
    op8_secret_spans, op9_url_vocabulary, op10_merge_dropout)
}
#: The others' hashes, byte positions, tokenizer or sorting are beyond SQL; tests hold them against brute force.
ORACLE_SQL = {"op4_int8_tiles": ORACLE_OP4, "op5_minhash_inverted": ORACLE_OP5, "op6_curriculum_mix": ORACLE_OP6, "op7_snapshot_collapse": ORACLE_OP7,
    "op9_url_vocabulary": oracle_op9()}
