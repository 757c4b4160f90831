"""The queries of this subpackage, as (spark, sf_dir) -> DataFrame."""

from __future__ import annotations

from .byte_bpe import op9_byte_bpe
from .embedding_dedup import op5_embedding_dedup
from .hamming import op7_hamming_topk
from .html_text import op10_html_text
from .jaccard_join import op3_jaccard_join
from .packing import op4_packing
from .pii import op6_pii
from .shards import op8_shards
from .token_counts import op1_token_counts
from .toxicity import op2_toxicity

QUERIES = {
    "op1_token_counts": op1_token_counts,
    "op2_toxicity": op2_toxicity,
    "op3_jaccard_join": op3_jaccard_join,
    "op4_packing": op4_packing,
    "op5_embedding_dedup": op5_embedding_dedup,
    "op6_pii": op6_pii,
    "op7_hamming_topk": op7_hamming_topk,
    "op8_shards": op8_shards,
    "op9_byte_bpe": op9_byte_bpe,
    "op10_html_text": op10_html_text,
}

#: DuckDB SQL where it can express a query.
ORACLE_SQL: dict[str, str] = {}
