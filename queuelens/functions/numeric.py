"""Rounding, ratios and binning."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def round_to(col: Column, places: int = 0) -> Column:
    """Half-away-from-zero rounding of the binary value (1.005 to two places is 1.0)."""
    scale = float(10**places)
    return F.round(col.cast("double") * scale) / F.lit(scale)


def ratio(part: Column, whole: Column) -> Column:
    """``part / whole`` as double; NULL for an empty whole."""
    return F.try_divide(part.cast("double"), whole.cast("double"))


def pct(part: Column, whole: Column, places: int = 1) -> Column:
    """Rounded percentage; NULL for an empty whole."""
    return round_to(ratio(F.lit(100.0) * part, whole), places)


def bucketize(col: Column, bins: Sequence[tuple[float | None, str]]) -> Column:
    """Label of the first bin whose exclusive upper edge lies above ``col``.

    The last bin has no edge and also takes NULL, as an ``ELSE`` branch would.
    """
    *edged, (_, last_label) = bins
    out = None
    for edge, label in edged:
        hit = col < F.lit(edge)
        out = F.when(hit, F.lit(label)) if out is None else out.when(hit, F.lit(label))
    return F.lit(last_label) if out is None else out.otherwise(F.lit(last_label))


def safe_corr(x: Column, y: Column) -> Column:
    """Pearson correlation aggregate; NULL (never an error) when either side is constant."""
    both = x.isNotNull() & y.isNotNull()
    x, y = F.when(both, x.cast("double")), F.when(both, y.cast("double"))
    spread = F.sqrt(F.var_pop(x) * F.var_pop(y))
    return F.try_divide(F.covar_pop(x, y), spread)


def severity_rank(col: Column, order: Sequence[str]) -> Column:
    """Position in ``order`` (1 first); NULL for a value not listed."""
    out = None
    for position, value in enumerate(order, start=1):
        hit = col == F.lit(value)
        out = F.when(hit, F.lit(position)) if out is None else out.when(hit, F.lit(position))
    return F.lit(None).cast("int") if out is None else out
