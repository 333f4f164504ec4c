"""Display rules as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: success-rate band thresholds (percent)
RATE_GOOD, RATE_WARN = 90, 70


def rate_band(rate: Column) -> Column:
    """>= 90 good, >= 70 warning, else poor."""
    return F.when(rate >= RATE_GOOD, "good").when(rate >= RATE_WARN, "warning").otherwise("poor")


def match_score(score: Column) -> Column:
    """Scores <= 1 are fractions (x100); rounded half up, clamped to 0..100; null stays null."""
    pct = F.when(score <= 1, score * 100).otherwise(score)
    return F.when(score.isNull() | F.isnan(score), F.lit(None)).otherwise(
        F.greatest(F.lit(0), F.least(F.lit(100), F.floor(pct + 0.5).cast("int"))))
