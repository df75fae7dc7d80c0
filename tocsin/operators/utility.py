"""Utility of hourly predictions, after the published 2019 early-prediction challenge.

For an episode with a label in its record, S is the first label hour plus 6 and
d = t - S. A positive prediction earns (d + 12) / 6 up to d = -6 (never below -0.05),
then (3 - d) / 9 up to d = 3. A negative one costs 2 (d + 6) / 9 between d = -6 and
d = 3. In an episode without label a positive prediction costs 0.05.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tocsin.functions.exprs import INF
from tocsin.params import Params

# Fixed values of the published rule.
EARLY, OPTIMAL, LATE = -12, -6, 3
FALSE_ALARM, WORST_MISS = -0.05, -2.0


def _record_hours(p: Params) -> Column:
    return F.least(F.col("horizon"), F.lit(p.hmax)) if p.hmax is not None else F.col("horizon")


def _reference_hour(p: Params) -> Column:
    """S, or NULL when no label falls in the record."""
    first = F.when(F.col("event") & (F.col("onset") < F.lit(INF)),
                   F.greatest(F.lit(1), F.ceil(F.col("onset") - p.warning_hours).cast("int")))
    return F.when(first <= _record_hours(p), first - OPTIMAL)


def _positive(d: Column) -> Column:
    ramp_up = F.greatest((d - EARLY) / F.lit(float(OPTIMAL - EARLY)), F.lit(FALSE_ALARM))
    return F.when(d <= OPTIMAL, ramp_up).when(d <= LATE, (LATE - d) / F.lit(float(LATE - OPTIMAL))).otherwise(0.0)


def _negative(d: Column) -> Column:
    return F.when((d > OPTIMAL) & (d <= LATE), WORST_MISS * (d - OPTIMAL) / F.lit(float(LATE - OPTIMAL))).otherwise(0.0)


def utility_gain(p: Params) -> Column:
    """Utility of a positive prediction at hour t over a negative one."""
    s = _reference_hour(p)
    d = F.col("t") - s
    return F.when(s.isNull(), F.lit(FALSE_ALARM)).otherwise(_positive(d) - _negative(d))


def base_utilities(p: Params) -> tuple[Column, Column]:
    """Episode utility of silence, and of predicting exactly the rewarded hours.

    Both only involve the hours S-12..S+3, so a short sequence is enough.
    """
    s = _reference_hour(p)
    lo = F.greatest(F.lit(1), s + EARLY)
    hi = F.least(s + LATE, _record_hours(p))
    hours = F.when(s.isNotNull() & (lo <= hi), F.sequence(lo.cast("int"), hi.cast("int"))).otherwise(
        F.array().cast("array<int>"))
    total = lambda f: F.aggregate(hours, F.lit(0.0), lambda a, t: a + f(t - s))
    return total(_negative), total(_positive)
