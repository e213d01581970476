"""overlap: distinct-key overlap counting between two dimensions on Spark.

Given ``(key, A)`` (scalar or array) and ``(key, B)`` inputs, count distinct keys per
``(a, b)``: exactly, approximately, join-free with theta sketches, or as mergeable HLL
sketches (built-in or register-table form), bucketed, rolled into trailing N-day uniques,
and compared for accuracy. DataFrames in, DataFrames out; native Spark expressions only.
"""

__version__ = "0.1.0"

from overlap.operators.accuracy import compare_counts, error_stats  # noqa: E402
from overlap.operators.buckets import bucket_by_pairs, bucketed_pairs, two_phase_pairs  # noqa: E402
from overlap.operators.daily import (daily_sketches, trailing_exact, trailing_registers,  # noqa: E402
                                     trailing_uniques)
from overlap.operators.hll import estimate_hll, hll_pairs, hll_sets, merge_hll  # noqa: E402
from overlap.operators.pairs import key_sets, pair_counts, pair_rows  # noqa: E402
from overlap.operators.registers import (estimate_registers, merge_registers,  # noqa: E402
                                          register_hll, register_pairs)
from overlap.operators.theta import merge_theta_sets, theta_pair_counts, theta_pairs, theta_sets  # noqa: E402

__all__ = [
    "pair_counts", "pair_rows", "key_sets", "theta_sets", "merge_theta_sets",
    "theta_pair_counts", "theta_pairs", "hll_sets", "hll_pairs", "merge_hll", "estimate_hll",
    "register_hll", "register_pairs", "merge_registers", "estimate_registers",
    "bucketed_pairs", "two_phase_pairs", "bucket_by_pairs", "daily_sketches",
    "trailing_uniques", "trailing_registers", "trailing_exact", "compare_counts", "error_stats",
]
