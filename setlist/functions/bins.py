"""Round bin edges for a histogram."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the chart library's binning rule: most bins, base, divisors tried in turn, slack.
MAX_BINS = 10
BASE = 10
DIVISORS = (5, 2)
SLACK = 1e-14


def bin_step(low: Column, high: Column, max_bins: int = MAX_BINS) -> Column:
    """Smallest round step that needs at most `max_bins` bins for the range."""
    span = F.coalesce(
        F.when(high > low, high - low), F.when(low != 0, F.abs(low)), F.lit(1.0)
    )
    levels = math.ceil(math.log(max_bins) / math.log(BASE))
    # the exponent is rounded half up, as JavaScript's Math.round does
    step = F.pow(F.lit(float(BASE)), F.floor(F.log(float(BASE), span) + 0.5) - levels)
    step = F.when(F.ceil(span / step) > max_bins, step * BASE).otherwise(step)
    for divisor in DIVISORS:
        finer = step / divisor
        step = F.when(span / finer <= max_bins, finer).otherwise(step)
    return step


def bin_start(low: Column, step: Column) -> Column:
    """Last multiple of the step that is not above the low end."""
    start = F.floor(low / step + SLACK) * step
    return F.when(low < start, start - step).otherwise(start)


def bin_stop(high: Column, step: Column) -> Column:
    return F.ceil(high / step) * step


def bin_number(value: Column, start: Column, stop: Column, step: Column) -> Column:
    """Zero-based bin; the upper end of the range belongs to the last bin."""
    inside = F.greatest(start, F.least(value, stop - step))
    return F.floor((inside - start) / step + SLACK).cast("int")
