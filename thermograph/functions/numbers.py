"""Numeric column helpers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NUMERIC_TEXT = r"^\s*[+-]?(\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?\s*$"


def half_even(c: Column, digits: int) -> Column:
    return F.bround(c, digits)


def as_float(c: Column) -> Column:
    """Text to double; blank, malformed or type-suffixed text becomes null."""
    return F.when(c.rlike(NUMERIC_TEXT), F.trim(c).try_cast("double"))


def positive_float(c: Column) -> Column:
    """The value when it is above zero, else null."""
    v = c.cast("double")
    return F.when(v > 0, v)


def finite(c: Column) -> Column:
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))


def saturation_vapor_pressure(t: Column) -> Column:
    """kPa over water at ``t`` °C."""
    return 0.61078 * F.exp((17.2694 * t) / (t + 237.3))


def moist_air_enthalpy(t: Column, rh_percent: Column, pressure_kpa: Column) -> Column:
    """kJ per kg dry air."""
    vapor = rh_percent / 100.0 * saturation_vapor_pressure(t)
    ratio = 0.62198 * vapor / F.greatest(pressure_kpa - vapor, F.lit(0.001))
    return 1.006 * t + ratio * (2501.0 + 1.86 * t)


def wall_u_from_library(u: Column, r: Column) -> Column:
    """U when given, else the inverse of R, else null; zero counts as absent."""
    nz = lambda c: F.when(c != 0, c)
    return F.coalesce(nz(u), 1.0 / nz(r))


def insulation_resistance(r: Column, u: Column, lam: Column, thickness_mm: Column) -> Column:
    """R of an insulation layer from R, else U, else thickness over lambda."""
    nz = lambda c: F.when(c != 0, c)
    return F.coalesce(nz(r), 1.0 / nz(u), F.when(thickness_mm > 0, (thickness_mm / 1000.0) / nz(lam)))


def series_wall_u(u_base: Column, r_ins: Column, u_ins: Column) -> Column:
    """Base wall and insulation in series; either alone when one is absent."""
    base = F.when(u_base > 0, u_base)
    return F.coalesce(1.0 / (1.0 / base + r_ins), base, u_ins)
