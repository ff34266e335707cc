"""Statistical column expressions with the reference semantics: undefined values are NULL."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Scales the median absolute deviation to a standard deviation under normality.
MAD_SCALE = 1.4826022185056018


def sem(x: Column) -> Column:
    """Standard error of the mean; NULL below two values."""
    return F.stddev_samp(x) / F.sqrt(F.count(x))


def cv_percent(x: Column) -> Column:
    """Coefficient of variation in percent; NULL unless n >= 2 and every value is positive."""
    return F.when((F.count(x) >= 2) & (F.min(x) > 0), 100 * F.stddev_samp(x) / F.avg(x))


def quantile(x: Column, p: float) -> Column:
    """Quantile of type 7 (linear interpolation)."""
    return F.percentile(x, F.lit(p))
