"""Salary expressions (P1-P5 and the three "salary present" definitions)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values that must equal the reference's behaviour.
# Experience levels and multipliers.
JUNIOR_LEVELS = ["entry", "junior", "trainee"]
SENIOR_LEVELS = ["senior", "lead", "manager"]
JUNIOR_MULTIPLIER = 0.9
SENIOR_MULTIPLIER = 1.12
# Cities and multipliers.
HIGH_COST_CITIES = ["munich", "frankfurt", "stuttgart", "hamburg"]
LOW_COST_CITIES = ["leipzig", "dresden", "bremen", "hannover"]
HIGH_COST_MULTIPLIER = 1.05
LOW_COST_MULTIPLIER = 0.95


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def midpoint(lo="salary_min", hi="salary_max") -> Column:
    """(min+max)/2, null unless both bounds are present."""
    lo, hi = col(lo).cast("double"), col(hi).cast("double")
    return F.when(lo.isNotNull() & hi.isNotNull(), (lo + hi) / 2)


def midpoint_nonzero(lo="salary_min", hi="salary_max") -> Column:
    """Midpoint only when both bounds are truthy (not null and not zero)."""
    lo, hi = col(lo).cast("double"), col(hi).cast("double")
    return F.when(lo.isNotNull() & hi.isNotNull() & (lo != 0) & (hi != 0), (lo + hi) / 2)


def midpoint_any(lo="salary_min", hi="salary_max") -> Column:
    """Mean of whichever bounds exist (null when neither)."""
    lo, hi = col(lo).cast("double"), col(hi).cast("double")
    return (
        F.when(lo.isNotNull() & hi.isNotNull(), (lo + hi) / 2)
        .when(lo.isNotNull(), lo)
        .when(hi.isNotNull(), hi)
    )


def is_listed(lo="salary_min", hi="salary_max", estimated="salary_is_estimated") -> Column:
    """Both bounds present and not flagged as estimated."""
    return col(lo).isNotNull() & col(hi).isNotNull() & ~F.coalesce(col(estimated).cast("boolean"), F.lit(False))


def experience_multiplier(level="experience_level") -> Column:
    """P3."""
    v = F.lower(F.coalesce(col(level).cast("string"), F.lit("")))
    return (
        F.when(v.isin(JUNIOR_LEVELS), F.lit(JUNIOR_MULTIPLIER))
        .when(v.isin(SENIOR_LEVELS), F.lit(SENIOR_MULTIPLIER))
        .otherwise(F.lit(1.0))
    )


def _contains_any(v: Column, needles: list[str]) -> Column:
    out = F.lit(False)
    for n in needles:
        out = out | v.contains(n)
    return out


def location_multiplier(location="location") -> Column:
    """By city substring of the lower-cased location."""
    v = F.lower(F.coalesce(col(location).cast("string"), F.lit("")))
    return (
        F.when(_contains_any(v, HIGH_COST_CITIES), F.lit(HIGH_COST_MULTIPLIER))
        .when(_contains_any(v, LOW_COST_CITIES), F.lit(LOW_COST_MULTIPLIER))
        .otherwise(F.lit(1.0))
    )


def thousands(c: Column) -> Column:
    """Integer (truncated toward zero) with ',' thousands separators, like ``f"{int(x):,}"``."""
    return F.format_number(c.cast("long"), 0)


def salary_label(lo: Column, hi: Column, estimated: Column, currency: str = "EUR") -> Column:
    """P5 label: ``[Estimated ]42,000-54,000 EUR`` or ``Salary not listed``."""
    prefix = F.when(estimated, F.lit("Estimated ")).otherwise(F.lit(""))
    return F.when(
        lo.isNotNull() & hi.isNotNull(),
        F.concat(prefix, thousands(lo), F.lit("-"), thousands(hi), F.lit(" " + currency)),
    ).otherwise(F.lit("Salary not listed"))
