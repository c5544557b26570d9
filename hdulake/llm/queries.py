"""The queries of this subpackage, by name, and their SQL where there is one."""

from __future__ import annotations

from hdulake.llm.counts import op4_counts
from hdulake.llm.fingerprints import op7_fingerprints
from hdulake.llm.language import op8_language
from hdulake.llm.minhash import op6_minhash
from hdulake.llm.mixing import op9_mixing
from hdulake.llm.neighbours import op3_neighbours
from hdulake.llm.packing import op2_packing
from hdulake.llm.sharding import op1_sharding
from hdulake.llm.suffixes import op10_suffixes
from hdulake.llm.toxicity import op5_toxicity

QUERIES = {f.__name__: f for f in (op1_sharding, op2_packing, op3_neighbours, op4_counts, op5_toxicity, op6_minhash, op7_fingerprints, op8_language, op9_mixing, op10_suffixes)}

#: None: their rows come from seeded shuffles, tokenizers, models and iterative algorithms. tests/llm has brute-force versions.
ORACLE_SQL: dict[str, str] = {}
