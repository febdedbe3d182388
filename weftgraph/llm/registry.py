"""The queries of this subpackage by name, and the DuckDB SQL of those that SQL can express."""

from __future__ import annotations

from .hamming_search import OP2_SQL, op2_hamming_top_k
from .mixing import OP3_SQL, op3_temperature_mixing
from .multiset_hash import op1_multiset_fingerprints
from .near_dedup import OP7_SQL, op7_chosen_path_near_dedup
from .packing import op8_best_fit_packing
from .substring_dedup import OP10_SQL, op10_lpf_substring_dedup
from .token_counts import op6_token_counts
from .toxicity import op4_toxicity
from .weak_quality import op9_weak_label_quality
from .warc import OP5_SQL, op5_warc_index_first

QUERIES = {
    f.__name__: f
    for f in (op1_multiset_fingerprints, op2_hamming_top_k, op3_temperature_mixing, op4_toxicity, op5_warc_index_first, op6_token_counts, op7_chosen_path_near_dedup, op8_best_fit_packing, op9_weak_label_quality, op10_lpf_substring_dedup)
}
ORACLES = {"op2_hamming_top_k": OP2_SQL, "op3_temperature_mixing": OP3_SQL, "op5_warc_index_first": OP5_SQL, "op7_chosen_path_near_dedup": OP7_SQL, "op10_lpf_substring_dedup": OP10_SQL}
