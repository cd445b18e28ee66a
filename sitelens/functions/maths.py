"""Numeric functions as column expressions, and the same as SQL text for the check catalogue."""

from __future__ import annotations

import math
import os

from pyspark.sql import Column
from pyspark.sql import functions as F


def clamp01(x: Column) -> Column:
    """Between 0 and 1; not a number counts as 0."""
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(F.nanvl(x.cast("double"), F.lit(0.0)), F.lit(0.0))))


def ramp(value: Column, bad: float, good: float) -> Column:
    if bad == good:
        return F.when(value >= good, 1.0).otherwise(0.0)
    return clamp01((value - bad) / (good - bad))


def ratio(part: Column, whole: Column) -> Column:
    return F.coalesce(F.try_divide(part.cast("double"), whole.cast("double")), F.lit(0.0))


def half_up(x: Column) -> Column:
    return F.floor(x + 0.5)


def log_scaled(count: Column) -> Column:
    """10 is a third, 100 two thirds, 1,000 and more 1."""
    return F.least(F.lit(1.0), F.log10(F.greatest(count.cast("double"), F.lit(10.0))) / 3)


def fixed(x: Column, places: int) -> Column:
    return F.format_string(f"%.{places}f", x.cast("double"))


def env_text(name: str, default: str) -> str:
    """A setting of the environment; a blank one counts as not set."""
    return (os.environ.get(name) or "").strip() or default


def env_number(name: str, default: float) -> float:
    """A finite positive setting, or the default."""
    try:
        value = float(env_text(name, ""))
    except ValueError:
        return default
    return value if math.isfinite(value) and value > 0 else default


# The same for SQL text that Spark and the comparison database both run.


def sql_clamp(x: str) -> str:
    return f"greatest(0e0, least(1e0, {x}))"


def sql_ramp(x: str, bad: float, good: float) -> str:
    return sql_clamp(f"({x} - {float(bad)!r}e0) / ({float(good - bad)!r}e0)")


def sql_ratio(part: str, whole: str) -> str:
    return f"coalesce(CAST({part} AS DOUBLE) / nullif(CAST({whole} AS DOUBLE), 0e0), 0e0)"


def sql_grade(score: str, fail_below: float = 0.4, warn_below: float = 0.8, opportunity: bool = False) -> str:
    """Status of a score; with ``opportunity`` one that does not pass is an opportunity."""
    if opportunity:
        return f"CASE WHEN {score} < {warn_below!r}e0 THEN 'opportunity' ELSE 'pass' END"
    return f"CASE WHEN {score} < {fail_below!r}e0 THEN 'fail' WHEN {score} < {warn_below!r}e0 THEN 'warn' ELSE 'pass' END"
