"""Parameters and their tuned sets (fixed values)."""

from __future__ import annotations

DEFAULTS = {
    "n_neighbors": 5, "radius": 1.0, "fast": False, "number_of_hash_functions": 400, "max_bin_size": 50, "minimal_blocks_in_common": 1, "shingle_size": 4, "excess_factor": 5, "similarity": False, "prune_inverse_index": -1,
    "remove_hash_function_with_less_entries_as": -1, "block_size": 5, "shingle": 0, "store_value_with_least_sigificant_bit": 0, "absolute_numbers": False,
}
#: Accepted and without effect: what Spark decides itself.
INERT = ("number_of_cores", "chunk_size", "prune_inverse_index_after_instance", "maxFeatures", "gpu_hashing", "cpu_gpu_load_balancing")

_NAMES = ("number_of_hash_functions", "max_bin_size", "minimal_blocks_in_common", "shingle_size", "excess_factor", "prune_inverse_index", "remove_hash_function_with_less_entries_as", "block_size", "shingle", "store_value_with_least_sigificant_bit", "rangeK_wta")
PRESETS = {
    ("minhash", "speed"): dict(zip(_NAMES, (200, 54, 1, 4, 8, 0, 0, 4, 1, 1))),
    ("minhash", "accuracy"): dict(zip(_NAMES, (596, 49, 1, 1, 11, 11, 0, 1, 0, 3))),
    ("wta", "speed"): dict(zip(_NAMES, (186, 87, 1, 1, 11, 6, 0, 1, 0, 1, 17))),
    ("wta", "accuracy"): dict(zip(_NAMES, (739, 30, 1, 3, 14, 1, 0, 1, 0, 2, 23))),
}
