"""Column functions on scores (O-A1, A2, A5, A14–A16, M6, M7)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import HEALTH_WEIGHTS, LEVELS


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def alert_level(score, levels=LEVELS) -> Column:
    """O-A1: most severe level whose bound the score reaches (inclusive); else NORMAL."""
    s = _c(score)
    out = None
    for name, bound in levels:
        out = F.when(s <= bound, name) if out is None else out.when(s <= bound, name)
    return out.otherwise("NORMAL")


def risk_level(score, levels=LEVELS) -> Column:
    """O-A2: same thresholds, LOW when none applies."""
    s = _c(score)
    out = None
    for name, bound in levels:
        out = F.when(s <= bound, name) if out is None else out.when(s <= bound, name)
    return out.otherwise("LOW")


def fmt3(x) -> Column:
    """Score text with 3 decimals, rounded half away from zero.

    Rounding goes through ``round(x * 1000)``, which every engine computes the same way
    on the same double, so the text does not depend on the formatter's tie rule.
    """
    return F.format_string("%.3f", F.round(_c(x) * 1000) / 1000)


def mean6(x) -> Column:
    """Mean of scores of 6 places, rounded half away from zero to 6 places.

    The sum is one of whole millionths, so neither it nor a tie depends on the order of addition.
    """
    total = F.sum(F.round(_c(x) * 1_000_000).cast("bigint"))
    n = F.count(_c(x))
    half = F.abs(total) * 2 + n
    return F.signum(total.cast("double")) * (half - half % (n * 2)) / (n * 2) / F.lit(1_000_000.0) + F.lit(0.0)


def level_bound(score, levels=LEVELS) -> Column:
    """O-A2: the upper bound of the level that a score falls in (null when none applies)."""
    s = _c(score)
    out = None
    for _, bound in levels:
        out = F.when(s <= bound, F.lit(bound)) if out is None else out.when(s <= bound, F.lit(bound))
    return out


def clamp(x, lo=0.0, hi=100.0) -> Column:
    return F.greatest(F.lit(lo), F.least(F.lit(hi), x))


def health_score(score, error_rate, log_volume, trend, weights=HEALTH_WEIGHTS) -> Column:
    """O-A14: four parts clamped to 0–100, weighted, clamped, rounded to 1 place."""
    wa, we, wv, wt = weights
    parts = (
        wa * clamp((_c(score) + 1) * 50)
        + we * clamp((1 - _c(error_rate)) * 100)
        + wv * clamp(100 - _c(log_volume) / 10)
        + wt * clamp(50 + _c(trend) * 25)
    )
    return F.round(clamp(parts), 1)


def health_class(h) -> Column:
    """O-A15: >= 70 good, >= 50 warning, else critical."""
    h = _c(h)
    return F.when(h >= 70, "good").when(h >= 50, "warning").otherwise("critical")


def risk_class(r) -> Column:
    """O-A15: < 30 good, < 60 warning, else critical."""
    r = _c(r)
    return F.when(r < 30, "good").when(r < 60, "warning").otherwise("critical")


def diagnosis(prediction) -> Column:
    """O-A16: -1 → CRITICAL, else Healthy."""
    return F.when(_c(prediction) == -1, "CRITICAL").otherwise("Healthy")


def ensemble_score(if_score, ae_score=None, w_if=0.6, w_ae=0.4) -> Column:
    """O-M7: ``w_if·tanh(if) + w_ae·tanh(ae)``; without an autoencoder its weight is 0 (O-M6)."""
    s = F.lit(w_if) * F.tanh(_c(if_score))
    if ae_score is not None and w_ae:
        s = s + F.lit(w_ae) * F.tanh(_c(ae_score))
    return s


def prediction(score) -> Column:
    """-1 when the score is below 0, else 1."""
    return F.when(_c(score) < 0, F.lit(-1)).otherwise(F.lit(1))
