"""Error metrics between two counts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def percent_difference(a, b) -> Column:
    """Symmetric percentage difference ``|a-b| / ((a+b)/2) * 100``; 0 vs 0 gives 0.0."""
    a, b = _c(a).cast("double"), _c(b).cast("double")
    return F.coalesce(F.try_divide(F.abs(a - b), (a + b) / F.lit(2.0)) * F.lit(100.0),
                      F.when(F.abs(a - b) == F.lit(0.0), F.lit(0.0)))


def relative_error(estimate, exact) -> Column:
    """True relative error ``|estimate-exact| / exact * 100`` (null when exact is 0 and est > 0)."""
    e, x = _c(estimate).cast("double"), _c(exact).cast("double")
    return F.coalesce(F.try_divide(F.abs(e - x), x) * F.lit(100.0),
                      F.when(F.abs(e - x) == F.lit(0.0), F.lit(0.0)))


def within_bound(estimate, exact, fraction: float) -> Column:
    """``|estimate - exact| <= fraction * exact`` (exact 0 must be estimated as 0)."""
    e, x = _c(estimate).cast("double"), _c(exact).cast("double")
    return F.abs(e - x) <= F.lit(float(fraction)) * x
