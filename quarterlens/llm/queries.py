"""Registered queries of the training-data operators, and their SQL."""

from __future__ import annotations

from .bpe import op7_bpe
from .divergence import OP11_SQL, op11_divergence
from .exact_dedup import OP5_SQL, op5_exact_dedup
from .near_dedup import OP9_SQL, op9_near_dedup
from .neighbours import op3_neighbours
from .packing import op8_packing
from .pii import op1_pii
from .quality import op12_quality
from .repeats import OP6_SQL, op6_repeats
from .sharding import OP10_SQL, op10_sharding
from .tokens import op2_token_counts
from .toxicity import op4_toxicity
from .trie import OP13_SQL, op13_prefix_trie

QUERIES = {
    "op1_pii": op1_pii,
    "op2_token_counts": op2_token_counts,
    "op3_neighbours": op3_neighbours,
    "op4_toxicity": op4_toxicity,
    "op5_exact_dedup": op5_exact_dedup,
    "op6_repeats": op6_repeats,
    "op7_bpe": op7_bpe,
    "op8_packing": op8_packing,
    "op9_near_dedup": op9_near_dedup,
    "op10_sharding": op10_sharding,
    "op11_divergence": op11_divergence,
    "op12_quality": op12_quality,
    "op13_prefix_trie": op13_prefix_trie,
}

SQL = {
    "op5_exact_dedup": OP5_SQL,
    "op6_repeats": OP6_SQL,
    "op9_near_dedup": OP9_SQL,
    "op10_sharding": OP10_SQL,
    "op11_divergence": OP11_SQL,
    "op13_prefix_trie": OP13_SQL,
}
