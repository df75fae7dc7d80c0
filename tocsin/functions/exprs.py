"""Column expressions of the episode model.

NULL stands for a missing value; NaN is turned into NULL on the way in because
Spark orders NaN above every number. Infinite onsets and thresholds are values.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tocsin.params import Params

INF = float("inf")


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def finite(c: Column | str) -> Column:
    """The value when it is a finite number, otherwise NULL."""
    c = col(c).cast("double")
    return F.when(F.abs(c) < F.lit(INF), c)


def round_scaled(value: Column, digits: int) -> Column:
    """``value`` rounded to ``digits`` as binary doubles are in SQL engines: scaled, rounded half away
    from zero, scaled back. ``F.round`` rounds the shortest decimal text, which differs on its halves."""
    scale = F.lit(float(10**digits))
    return F.round(value * scale) / scale


def ratio(num: Column, den: Column) -> Column:
    """``num / den`` as double, NULL when the denominator is zero or NULL."""
    den = den.cast("double")
    return F.when(den != 0, num.cast("double") / den)


def clipped_logit(risk: Column | str, epsilon: float = 1e-6) -> Column:
    risk = col(risk)
    c = F.least(F.greatest(risk, F.lit(epsilon)), F.lit(1.0 - epsilon))
    return F.when(risk.isNotNull(), F.log(c) - F.log1p(-c))


def expit(latent: Column | str) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-col(latent)))


def last_eligible_hour(p: Params, horizon="horizon", onset="onset") -> Column:
    """Eligible hours are the run tmin..this hour: on the record, within hmax,
    strictly before the onset."""
    bounds = [col(horizon).cast("long")]
    if p.hmax is not None:
        bounds.append(F.lit(p.hmax).cast("long"))
    bounds.append(F.when(col(onset) < F.lit(INF), F.ceil(col(onset)) - 1).otherwise(col(horizon).cast("long")))
    return F.least(*bounds)


def eligible(p: Params, t="t", horizon="horizon", onset="onset") -> Column:
    cond = (col(t) >= p.tmin) & (col(t) <= col(horizon)) & (col(t) < col(onset))
    return cond & (col(t) <= p.hmax) if p.hmax is not None else cond


def eligible_hours(p: Params, horizon="horizon", onset="onset") -> Column:
    return F.greatest(F.lit(0).cast("long"), last_eligible_hour(p, horizon, onset) - p.tmin + 1)


def utility_grid(p: Params, t="t", horizon="horizon") -> Column:
    """Hours that count for the utility: not cut at the onset."""
    cond = (col(t) >= p.tmin) & (col(t) <= col(horizon))
    return cond & (col(t) <= p.hmax) if p.hmax is not None else cond


def fitting_hour(p: Params, t="t", onset="onset") -> Column:
    cond = (col(t) >= p.tmin) & (col(t) < col(onset))
    return cond & (col(t) <= p.hmax) if p.hmax is not None else cond


def first_score_hour(p: Params) -> int:
    """First hour whose score the smoother needs for hour tmin."""
    return max(1, p.tmin - p.smooth_length + 1)


def score_history_hour(p: Params, t="t", horizon="horizon", onset="onset") -> Column:
    cond = (col(t) >= first_score_hour(p)) & (col(t) <= col(horizon)) & (col(t) < col(onset))
    return cond & (col(t) <= p.hmax) if p.hmax is not None else cond


def lookahead_label(p: Params, t="t", onset="onset") -> Column:
    """Fitting label: the onset lies in the next warning_hours."""
    lead = col(onset) - col(t)
    return F.coalesce((lead > 0) & (lead <= p.warning_hours), F.lit(False))


def utility_label(p: Params, t="t", horizon="horizon", onset="onset", event="event") -> Column:
    return col(event) & (col(t) >= col(onset) - p.warning_hours) & (col(t) <= col(horizon))


def window_evaluable(p: Params, lead: int, horizon="horizon", onset="onset", event="event") -> Column:
    """True when an eligible hour lies in [onset - warning_hours, onset - lead]."""
    lo = F.greatest(F.lit(p.tmin).cast("long"), F.ceil(col(onset) - p.warning_hours))
    hi = F.least(last_eligible_hour(p, horizon, onset), F.floor(col(onset) - lead))
    return col(event) & F.when(col(onset) < F.lit(INF), lo <= hi).otherwise(False)


def bin_index(t: Column | str, boundaries: tuple[int, ...]) -> Column:
    """Zero-based bin of an hour: the first bin is closed, the others are (lo, hi];
    hours outside fall in the nearest bin."""
    t = col(t)
    out = F.lit(len(boundaries) - 2)
    for b in range(len(boundaries) - 3, -1, -1):
        out = F.when(t <= boundaries[b + 1], F.lit(b)).otherwise(out)
    return out


def marginal_index(m0: Column | str, alpha: Column | str) -> Column:
    """1-based rank ceil((m0 + 1)(1 - alpha)), in doubles."""
    return F.ceil((col(m0).cast("double") + 1) * (F.lit(1.0) - col(alpha).cast("double")))


def achieved_bound(m0: Column | str, k: Column | str) -> Column:
    n = col(m0).cast("double") + 1
    return (n - col(k)) / n


def minimum_m0(alpha: Column | str) -> Column:
    """Smallest calibration size with a finite marginal threshold."""
    return F.ceil(F.lit(1.0) / col(alpha).cast("double")) - 1


def hash_key(seed: int | str, stream: Column | str, *parts: Column) -> Column:
    """md5 text of ``seed|stream|parts``: a named, engine-independent random stream."""
    stream = F.lit(stream) if isinstance(stream, str) else stream
    return F.md5(F.concat_ws("|", F.lit(str(seed)), stream.cast("string"), *[x.cast("string") for x in parts]).cast("binary"))


def hash_long(key: Column) -> Column:
    """First 60 bits of an md5 text as a long."""
    return F.conv(F.substring(key, 1, 15), 16, 10).cast("long")


def age_group(age: Column | str) -> Column:
    a = finite(age)
    return (F.when(a.isNull(), "missing").when(a < 50, "<50").when(a < 65, "50-64")
            .when(a < 80, "65-79").otherwise(">=80"))


def unit_type(unit1: Column | str, unit2: Column | str) -> Column:
    one, two = F.coalesce(col(unit1) == 1, F.lit(False)), F.coalesce(col(unit2) == 1, F.lit(False))
    return (F.when(one & two, "both").when(one, "Unit1 only").when(two, "Unit2 only")
            .otherwise("neither/missing"))


def threshold_state(values: Column) -> list[Column]:
    """State columns of an array of thresholds: finite, neg_inf, pos_inf or mixed_inf."""
    neg = F.size(F.filter(values, lambda v: v == F.lit(-INF)))
    pos = F.size(F.filter(values, lambda v: v == F.lit(INF)))
    return [
        F.when((neg > 0) & (pos > 0), "mixed_inf").when(neg > 0, "neg_inf").when(pos > 0, "pos_inf")
        .otherwise("finite").alias("threshold_state"),
        (neg + pos).alias("nonfinite_count"),
        (neg > 0).alias("has_neg_inf"),
        (pos > 0).alias("has_pos_inf"),
    ]
