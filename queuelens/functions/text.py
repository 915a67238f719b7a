"""Text normalisation."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

_DECIMAL_NUMBER = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"


def folded(col: Column) -> Column:
    """Trimmed (spaces only) and lower-cased."""
    return F.lower(F.trim(col))


def relabel(col: Column, labels: Mapping[str, str], fallback: Column) -> Column:
    """Replace folded values found in ``labels``; anything else becomes ``fallback``."""
    key = folded(col)
    by_label: dict[str, list[str]] = {}
    for variant, label in labels.items():
        by_label.setdefault(label, []).append(variant)
    out = None
    for label, variants in by_label.items():
        hit = key.isin(variants)
        out = F.when(hit, F.lit(label)) if out is None else out.when(hit, F.lit(label))
    return fallback if out is None else out.otherwise(fallback)


def blank_to_null(col: Column) -> Column:
    return F.nullif(F.trim(col), F.lit(""))


def lenient_int(col: Column) -> Column:
    """Integer from text; ``7.5`` rounds half away from zero, ``1e1`` is 10, junk is NULL.

    Plain integers take the first branch.  The pattern guards the second one,
    because a cast to double would also accept ``5d`` or ``Infinity``.
    """
    as_double = F.when(col.rlike(_DECIMAL_NUMBER), col.try_cast("double"))
    return F.coalesce(col.try_cast("int"), F.round(as_double).try_cast("int"))
