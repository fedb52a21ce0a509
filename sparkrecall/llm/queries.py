"""The operators' queries, each over its whole table, and the SQL of those that SQL can state."""

from __future__ import annotations

from . import fim, merkle, mixing
from .attribution import op1_offset_attribution
from .bpe import op12_segment_tree_bpe
from .fim import op11_chunked_fim
from .gam import op3_gam_quality
from .merkle import op13_merkle_manifest
from .minhash import op5_one_permutation_minhash
from .mixing import op10_hash_threshold_mix
from .audio import op8_telephony_audio
from .packing import op9_config_lp_packing
from .passages import op2_compact_windows
from .simhash import op6_simhash_groups
from .toxicity import op7_toxicity_chain
from .wavelet import op4_wavelet_tokens

QUERIES = {
    "op1_offset_attribution": op1_offset_attribution,
    "op2_compact_windows": op2_compact_windows,
    "op3_gam_quality": op3_gam_quality,
    "op4_wavelet_tokens": op4_wavelet_tokens,
    "op5_one_permutation_minhash": op5_one_permutation_minhash,
    "op6_simhash_groups": op6_simhash_groups,
    "op7_toxicity_chain": op7_toxicity_chain,
    "op8_telephony_audio": op8_telephony_audio,
    "op9_config_lp_packing": op9_config_lp_packing,
    "op10_hash_threshold_mix": op10_hash_threshold_mix,
    "op11_chunked_fim": op11_chunked_fim,
    "op12_segment_tree_bpe": op12_segment_tree_bpe,
    "op13_merkle_manifest": op13_merkle_manifest,
}

ORACLE_SQL: dict[str, str] = {"op10_hash_threshold_mix": mixing.SQL, "op11_chunked_fim": fim.SQL, "op13_merkle_manifest": merkle.SQL}
