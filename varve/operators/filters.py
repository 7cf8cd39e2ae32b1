"""Predicates on records, each decision with its reasons, and roles by resolution."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import FilterConfig, NestConfig


def one_of(c: Column, choices: Sequence[str]) -> Column:
    """Whether the text is among the choices, whatever the case; no choices let all pass."""
    return F.lit(True) if not choices else F.coalesce(F.lower(F.trim(c)).isin(*[x.strip().lower() for x in choices]), F.lit(False))


def in_longitudes(lon: Column, west: float, east: float) -> Column:
    """Longitudes in any convention; west beyond east crosses the date line. Bounds of 180 count as -180."""
    wrap = lambda x: (x + 180.0) % 360.0 - 180.0
    west, east = wrap(west), wrap(east)
    here = F.pmod(lon + 180.0, F.lit(360.0)) - 180.0
    inside = here.between(west, east) if west <= east else (here >= west) | (here <= east)
    return F.coalesce(inside, F.lit(False))


def filter_decisions(records: DataFrame, cfg: FilterConfig = FilterConfig()) -> DataFrame:
    """records (with end and resolution) with ``reasons`` (joined by |, in fixed order) and ``included``."""
    checks: list[tuple[str, Column]] = []
    if cfg.maximum_plausible_year is not None:
        checks.append(("implausible_end_year", F.col("end") > cfg.maximum_plausible_year))
    if cfg.maximum_resolution_years is not None:
        checks.append(("resolution", F.col("resolution").isNull() | (F.col("resolution") > cfg.maximum_resolution_years)))
    if cfg.latitude is not None:
        checks.append(("latitude", ~F.coalesce(F.col("lat").between(*cfg.latitude), F.lit(False))))
    if cfg.longitude is not None:
        checks.append(("longitude", ~in_longitudes(F.col("lon"), *cfg.longitude)))
    checks.append(("archive", ~one_of(F.col("archive"), cfg.archives)))
    checks.append(("proxy", ~one_of(F.col("proxy"), cfg.proxies)))
    if cfg.climate_variables:
        checks.append(("climate_variable", ~one_of(F.element_at("metadata", F.lit("climateInterpretation_variable")), cfg.climate_variables)))
    reasons = F.array_compact(F.array(*[F.when(F.coalesce(bad, F.lit(False)), F.lit(name)) for name, bad in checks]))
    return records.withColumn("reasons", F.array_join(reasons, "|")).withColumn("included", F.size(reasons) == 0)


def filter_records(records: DataFrame, cfg: FilterConfig = FilterConfig()) -> DataFrame:
    return filter_decisions(records, cfg).where("included").drop("reasons", "included")


def calibration_years(target: DataFrame, period: tuple[int, int] | None) -> DataFrame:
    rows = target.where("y is not null")
    return (rows.where(F.col("year").between(*period)) if period else rows).select("year", "y")


def passes_gate(ce: Column, re: Column, min_ce: float, min_re: float, comparison: str = "gt") -> Column:
    ok = (ce > min_ce) & (re > min_re) if comparison == "gt" else (ce >= min_ce) & (re >= min_re)
    return F.coalesce(ok & ~F.isnan(ce) & ~F.isnan(re), F.lit(False))


def resolution_band(resolution: Column, cfg: NestConfig = NestConfig()) -> Column:
    """The smallest declared window that holds the resolution, for series between the limits; else NULL."""
    bins = F.array(*[F.lit(b) for b in cfg.bins])
    inside = (resolution > cfg.direct_resolution) & (resolution <= cfg.subnest_max_resolution)
    return F.when(inside, F.array_min(F.filter(bins, lambda b: b >= resolution)))


def reconstruction_role(resolution: Column, cfg: NestConfig = NestConfig(), slow_layer: bool = False) -> Column:
    """What a selected series does: annual layer, window layer, low-pass layer, or nothing."""
    slow = F.lit("low_pass" if slow_layer else "excluded")
    return F.when(resolution.isNull() | (resolution <= cfg.direct_resolution), "annual").when(resolution <= cfg.subnest_max_resolution, "window" if cfg.subnests else "annual").otherwise(slow)


def core_roles(records: DataFrame, limit: float, least: int, keys: Sequence[str] = (), fall_back: bool = True) -> DataFrame:
    """Adds is_core: resolution up to the limit (or unknown); all are core where fewer than ``least`` would be, if falling back."""
    fine = F.coalesce(F.col("resolution") <= limit, F.lit(True))
    rows = records.withColumn("is_core", fine)
    if fall_back:
        n = F.sum(F.col("is_core").cast("int")).over(Window.partitionBy(*keys))
        rows = rows.withColumn("__n", n).withColumn("is_core", F.col("is_core") | (F.col("__n") < least)).drop("__n")
    return rows


def subset(df: DataFrame, pids: DataFrame) -> DataFrame:
    return df.join(pids.select("pid").distinct(), "pid", "left_semi")
