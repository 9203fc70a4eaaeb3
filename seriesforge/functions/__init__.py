"""Column expressions used by the operators (native Spark functions only, no UDFs)."""

from .dates import (GRAINS, as_col, grain_key, month_start, quarter_label, quarter_of, year_months,
                    year_of)
from .stats import trend_aggregates, trend_intercept, trend_slope

__all__ = [
    "GRAINS", "as_col", "grain_key", "month_start", "quarter_label", "quarter_of", "year_months",
    "year_of", "trend_aggregates", "trend_intercept", "trend_slope",
]
