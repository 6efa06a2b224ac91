"""Loss column expressions (X21-X23): label smoothing, stable logit
cross-entropy and the focal weight. All are plain arithmetic columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def smooth_label(label, smoothing: float = 0.1) -> Column:
    """Y * (1 - s) + 0.5 * s."""
    return _col(label).cast("double") * F.lit(1.0 - smoothing) + F.lit(0.5 * smoothing)


def logit_bce(logit, target) -> Column:
    """max(x, 0) - x * y + log1p(exp(-|x|)) - cross-entropy on a logit."""
    x = _col(logit).cast("double")
    y = _col(target)
    return F.greatest(x, F.lit(0.0)) - x * y + F.log1p(F.exp(-F.abs(x)))


def focal(bce, alpha, gamma: float = 2.0) -> Column:
    """Alpha * (1 - exp(-bce)) ** gamma * bce."""
    b = _col(bce)
    a = alpha if isinstance(alpha, Column) else F.lit(float(alpha))
    return a * F.pow(F.lit(1.0) - F.exp(-b), F.lit(float(gamma))) * b


def smoothed_focal(logit, label, alpha, gamma: float = 2.0, smoothing: float = 0.1, positive_only: bool = False) -> Column:
    """M10 per row. ``alpha`` multiplies every row, as in the reference, or with
    ``positive_only`` the rows of the positive class alone (Q25)."""
    a = alpha if isinstance(alpha, Column) else F.lit(float(alpha))
    if positive_only:
        a = F.when(_col(label) == 1, a).otherwise(F.lit(1.0))
    return focal(logit_bce(logit, smooth_label(label, smoothing)), a, gamma)
