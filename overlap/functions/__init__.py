"""Column-level functions (all native Spark expressions, no Python UDFs)."""

from overlap.functions.keys import bucket_of, hash_key
from overlap.functions.metrics import percent_difference, relative_error, within_bound
from overlap.functions.sketches import (
    empty_hll, empty_hll_bytes, hll_estimate, hll_merge, theta_estimate, theta_intersect, theta_merge,
)

__all__ = [
    "bucket_of", "hash_key", "percent_difference", "relative_error", "within_bound",
    "theta_estimate", "theta_intersect", "theta_merge", "hll_estimate", "hll_merge", "empty_hll", "empty_hll_bytes",
]
