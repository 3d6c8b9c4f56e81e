"""Sums, means and spreads that do not depend on the order in which rows are added up."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

PLACES = 6


def _units(value: Column, places: int) -> Column:
    """A number as a whole count of its last place; null where that does not fit."""
    return F.round(value * 10**places).try_cast("decimal(18,0)")


def exact_sum(value: Column, places: int = PLACES) -> Column:
    """Sum of values of up to ``places`` decimals, 0 over nothing; plain floating sum if a value is too large for that."""
    units = _units(value, places)
    fits = F.count(units) == F.count(value)
    return F.coalesce(F.when(fits, F.sum(units).cast("double") / 10**places).otherwise(F.sum(value)), F.lit(0.0))


def exact_mean(value: Column, places: int = PLACES) -> Column:
    """Mean of values of up to ``places`` decimals, null over nothing."""
    units = _units(value, places)
    fits = F.count(units) == F.count(value)
    return F.when(fits, F.sum(units).cast("double") / (F.count(value) * 10**places)).otherwise(F.avg(value))


def exact_std_pop(value: Column, places: int = PLACES) -> Column:
    """Population standard deviation from the exact sums of values and squares, null over nothing."""
    units = _units(value, places)
    n = F.count(value)
    total = F.sum(units)
    spread = F.try_subtract(F.try_multiply(n.cast("decimal(18,0)"), F.sum(units * units)), F.try_multiply(total, total))
    exact = F.sqrt(spread.cast("double")) / (n * 10**places)
    return F.when(F.count(units) == n, F.coalesce(exact, F.stddev_pop(value))).otherwise(F.stddev_pop(value))


def sql_mean(x: str, places: int = PLACES) -> str:
    """The same mean for the oracles."""
    return f"CAST(sum(CAST(round({x} * 1e{places}) AS DECIMAL(18,0))) AS DOUBLE) / (count({x}) * 1e{places})"


def sql_sum(x: str, places: int = PLACES) -> str:
    return f"coalesce(CAST(sum(CAST(round({x} * 1e{places}) AS DECIMAL(18,0))) AS DOUBLE) / 1e{places}, 0)"


def sql_std_pop(x: str, places: int = PLACES) -> str:
    units = f"CAST(round({x} * 1e{places}) AS DECIMAL(18,0))"
    whole = f"CAST({units} AS DECIMAL(38,0))"
    return f"sqrt(CAST(count({x}) * CAST(sum({whole} * {whole}) AS HUGEINT) - CAST(sum({units}) AS HUGEINT) * CAST(sum({units}) AS HUGEINT) AS DOUBLE)) / (count({x}) * 1e{places})"
