"""Aggregation of series in time: seasons, windows, matrices, gaps, support and runs.

Observations are rows (pid, time, value) with fractional calendar years; annual series are rows
(pid, year, value). Each operator groups by pid, so that series spread over the cluster.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.stats import finite_columns

ALL_MONTHS = tuple(range(1, 13))


def clean_observations(obs: DataFrame) -> DataFrame:
    """Finite samples; those of one time are averaged."""
    return finite_columns(obs.select("pid", "time", "value"), ["time", "value"]).dropna().groupBy("pid", "time").agg(F.avg("value").alias("value"))


def native_resolution(obs: DataFrame) -> DataFrame:
    """(pid, resolution): the median gap between distinct times; NULL for a single time."""
    gap = F.col("time") - F.lag("time").over(Window.partitionBy("pid").orderBy("time"))
    return obs.select("pid", "time").distinct().withColumn("gap", gap).groupBy("pid").agg(F.median(F.when(F.col("gap") > 0, F.col("gap"))).alias("resolution"))


def record_metadata(obs: DataFrame) -> DataFrame:
    """(pid, start, end, samples, resolution)."""
    sides = obs.groupBy("pid").agg(F.min("time").alias("start"), F.max("time").alias("end"), F.count(F.lit(1)).alias("samples"))
    return sides.join(native_resolution(obs), "pid")


def season_year(year: Column, month: Column, months: Sequence[int], anchor: str) -> Column:
    """The year that a month's season belongs to."""
    if anchor == "calendar" or len(months) == 12:
        return year
    if anchor == "end":
        return year + (month > months[-1]).cast("int")
    if anchor == "start":
        return year - (month < months[0]).cast("int")
    raise ValueError(f"unknown anchor: {anchor}")


def required_months(months: Sequence[int], fraction: float) -> int:
    return max(1, math.ceil(len(set(months)) * fraction))


def annualize(obs: DataFrame, months: Sequence[int] = ALL_MONTHS, anchor: str = "end", fraction: float = 0.75, resolution: DataFrame | None = None) -> DataFrame:
    """(pid, year, value): means by year; of series finer than 0.75 years, means over the season's samples where enough months have any."""
    resolution = native_resolution(obs) if resolution is None else resolution
    rows = obs.join(resolution, "pid")
    coarse = F.coalesce(F.col("resolution") >= 0.75, F.lit(True))
    year = F.floor("time").cast("int")
    month = F.least(F.lit(12), F.greatest(F.lit(1), F.floor((F.col("time") - F.floor("time")) * 12 + 1e-7).cast("int") + 1))
    rows = rows.withColumns({"coarse": coarse, "month": month})
    rows = rows.where(F.col("coarse") | F.col("month").isin(*months))
    rows = rows.withColumn("year", F.when(F.col("coarse"), F.floor(F.col("time") + 1e-7).cast("int")).otherwise(season_year(year, F.col("month"), tuple(months), anchor)))
    out = rows.groupBy("pid", "year").agg(F.avg("value").alias("value"), F.count_distinct("month").alias("months"), F.max("coarse").alias("coarse"))
    return out.where(F.col("coarse") | (F.col("months") >= required_months(months, fraction))).select("pid", "year", "value")


def window_table(spark: SparkSession, start: int, end: int, width: int) -> DataFrame:
    """Tumbling windows of calendar years; the last may be cut short."""
    return spark.range(1).select(F.explode(F.sequence(F.lit(start), F.lit(end), F.lit(width))).alias("window_id")).select(
        "window_id",
        F.col("window_id").alias("window_start"),
        F.least(F.col("window_id") + width - 1, F.lit(end)).alias("window_end"),
        ((F.col("window_id") + F.least(F.col("window_id") + width - 1, F.lit(end))) / 2.0).alias("window_center"),
        (F.least(F.col("window_id") + width - 1, F.lit(end)) - F.col("window_id") + 1).alias("window_year_count"),
    )


def window_of(time: Column, start: int, width: int) -> Column:
    """Window id of a sample: windows reach half a year beyond their first and last year."""
    return (F.lit(start) + F.floor((time + 0.5 - start) / width) * width).cast("int")


def native_window_means(obs: DataFrame, start: int, end: int, width: int) -> DataFrame:
    """(pid, window_id, value): means of the samples in each window; an equi-bucket, no range join."""
    inside = obs.where((F.col("time") >= start - 0.5) & (F.col("time") < end + 0.5))
    return inside.groupBy("pid", window_of(F.col("time"), start, width).alias("window_id")).agg(F.avg("value").alias("value"))


def annual_window_means(annual: DataFrame, start: int, end: int, width: int) -> DataFrame:
    """(pid, window_id, value, years) of annual series."""
    key = (F.lit(start) + F.floor((F.col("year") - start) / width) * width).cast("int")
    return annual.where(F.col("year").between(start, end)).groupBy("pid", key.alias("window_id")).agg(F.avg("value").alias("value"), F.count("value").alias("years"))


def complete_window_pairs(obs: DataFrame, target: DataFrame, start: int, end: int, width: int) -> DataFrame:
    """(pid, window_id, x, y): native window means against the target's, in windows that are whole and fully observed."""
    rows = obs.where((F.col("time") >= start) & (F.col("time") < end + 1))
    means = native_window_means(rows, start, end, width)
    whole = annual_window_means(target.select(F.lit("target").alias("pid"), "year", F.col("y").alias("value")), start, end, width)
    whole = whole.where((F.col("years") == width) & (F.col("window_id") + width - 1 <= end)).select("window_id", F.col("value").alias("y"))
    return means.join(whole, "window_id").select("pid", "window_id", F.col("value").alias("x"), "y")


def dense_matrix(annual: DataFrame, start: int, end: int, pids: DataFrame | None = None) -> DataFrame:
    """(pid, year, value) with a row for every year, NULL where there is no value."""
    pids = annual.select("pid").distinct() if pids is None else pids.select("pid").distinct()
    grid = pids.select("pid", F.explode(F.sequence(F.lit(start), F.lit(end))).alias("year"))
    return grid.join(annual.where(F.col("year").between(start, end)).select("pid", "year", "value"), ["pid", "year"], "left")


def fill_short_gaps(dense: DataFrame, longest: int, eligible: Column | None = None) -> DataFrame:
    """Linear values in interior gaps of at most ``longest`` years; adds is_native and is_interpolated."""
    order = Window.partitionBy("pid").orderBy("year")
    before, after = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(1, Window.unboundedFollowing)
    known = F.when(F.col("value").isNotNull(), F.col("year"))
    rows = dense.withColumns({
        "y0": F.last(known, True).over(before), "v0": F.last("value", True).over(before),
        "y1": F.first(known, True).over(after), "v1": F.first("value", True).over(after),
    })
    fits = F.col("value").isNull() & ((F.col("y1") - F.col("y0") - 1) <= longest)
    fits = F.coalesce(fits if eligible is None else fits & eligible, F.lit(False))
    line = F.col("v0") + (F.col("v1") - F.col("v0")) * (F.col("year") - F.col("y0")) / (F.col("y1") - F.col("y0"))
    return rows.withColumns({"is_native": F.col("value").isNotNull(), "is_interpolated": fits, "value": F.when(fits, line).otherwise(F.col("value"))}).drop("y0", "v0", "y1", "v1")


def gap_audit(filled: DataFrame) -> DataFrame:
    return filled.groupBy("pid").agg(F.sum(F.col("is_native").cast("long")).alias("native_years"), F.sum(F.col("is_interpolated").cast("long")).alias("interpolated_years"))


def reference_zscore(annual: DataFrame, start: int, end: int, allowed: DataFrame | None = None) -> DataFrame:
    """(pid, year, value, reference_mean, reference_sd, reference_n): scaled over the reference period and allowed years, which have a pid where series differ in them.

    A series with fewer than two reference values, or without variation there, has a NULL value.
    """
    reference = annual.where(F.col("year").between(start, end) & F.col("value").isNotNull())
    if allowed is not None:
        reference = reference.join(allowed, [c for c in ("pid", "year") if c in allowed.columns], "left_semi")
    facts = reference.groupBy("pid").agg(F.avg("value").alias("reference_mean"), F.stddev_samp("value").alias("reference_sd"), F.count("value").alias("reference_n"))
    rows = annual.join(facts, "pid", "left")
    scaled = F.when((F.col("reference_n") >= 2) & (F.col("reference_sd") > 0), (F.col("value") - F.col("reference_mean")) / F.col("reference_sd"))
    return rows.select("pid", "year", scaled.alias("value"), "reference_mean", "reference_sd", "reference_n")


def native_zscore(obs: DataFrame, start: float, end: float, allowed: DataFrame | None = None) -> DataFrame:
    """Samples scaled over those within the period whose nearest year (half to even) is allowed."""
    reference = obs.where(F.col("time").between(start, end))
    if allowed is not None:
        reference = reference.withColumn("year", F.rint("time").cast("int")).join(allowed.select("year").distinct(), "year", "left_semi")
    facts = reference.groupBy("pid").agg(F.avg("value").alias("m"), F.stddev_samp("value").alias("s"), F.count("value").alias("k"))
    scaled = F.when((F.col("k") >= 2) & (F.col("s") > 0), (F.col("value") - F.col("m")) / F.col("s"))
    return obs.join(facts, "pid", "left").select("pid", "time", scaled.alias("value"))


def linear_detrend(annual: DataFrame) -> DataFrame:
    """Residuals of each series' line over the years; series of fewer than three values stay."""
    facts = annual.groupBy("pid").agg(F.regr_slope("value", "year").alias("slope"), F.regr_intercept("value", "year").alias("intercept"), F.count("value").alias("k"))
    residual = F.when(F.col("k") >= 3, F.col("value") - F.col("intercept") - F.col("slope") * F.col("year")).otherwise(F.col("value"))
    return annual.join(facts, "pid").select("pid", "year", residual.alias("value"))


def support_widths(obs: DataFrame, multiplier: float | None = 3.0) -> DataFrame:
    """(pid, time, value, width): years each sample stands for, from the midpoints to its neighbours, at least one."""
    order = Window.partitionBy("pid").orderBy("time")
    before, after = F.col("time") - F.lag("time").over(order), F.lead("time").over(order) - F.col("time")
    rows = obs.withColumns({"g0": before, "g1": after}).join(native_resolution(obs), "pid")
    width = F.when(F.col("g0").isNull() & F.col("g1").isNull(), F.lit(1.0)).otherwise((F.coalesce("g0", "g1") + F.coalesce("g1", "g0")) / 2)
    width = F.greatest(width, F.lit(1.0))
    if multiplier is not None:
        width = F.when(F.col("resolution").isNotNull(), F.least(width, F.greatest(F.lit(1.0), F.lit(multiplier) * F.col("resolution")))).otherwise(width)
    return rows.select("pid", "time", "value", width.alias("width"))


def covered_years(obs: DataFrame, multiplier: float | None = 3.0) -> DataFrame:
    """(pid, lo, hi): the runs of years that samples' supports cover, those that touch or overlap joined."""
    wide = support_widths(obs, multiplier)
    rows = wide.select("pid", F.ceil(F.col("time") - F.col("width") / 2).cast("int").alias("lo"), (F.ceil(F.col("time") + F.col("width") / 2) - 1).cast("int").alias("hi")).where("lo <= hi")
    order = Window.partitionBy("pid").orderBy("lo", "hi")
    reached = F.max("hi").over(order.rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumn("new", F.coalesce(F.col("lo") > reached + 1, F.lit(True)).cast("int"))
    rows = rows.withColumn("run", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    return rows.groupBy("pid", "run").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).select("pid", "lo", "hi")


def counts_by_difference(spans: DataFrame, years: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """(keys, year, support): how many spans (keys, lo, hi) hold a year of years (keys, year).

    A span adds one where it begins and takes one off after its end; these are summed by year before they
    are summed up over years, so that a span costs two rows however long it is.
    """
    steps = spans.select(*keys, F.explode(F.array(F.struct(F.col("lo").alias("year"), F.lit(1).alias("d")), F.struct((F.col("hi") + 1).alias("year"), F.lit(-1).alias("d")))).alias("s")).select(*keys, "s.year", "s.d")
    both = steps.unionByName(years.select(*keys, "year", F.lit(0).alias("d"))).groupBy(*keys, "year").agg(F.sum("d").alias("d"), F.max((F.col("d") == 0).cast("int")).alias("asked"))
    up_to = Window.partitionBy(*keys).orderBy("year")
    return both.withColumn("support", F.sum("d").over(up_to)).where("asked = 1").select(*keys, "year", F.col("support").cast("long").alias("support"))


def support_counts(obs: DataFrame, start: int, end: int, multiplier: float | None = 3.0) -> DataFrame:
    """(year, support): how many series have a sample whose support covers the year."""
    years = obs.sparkSession.range(start, end + 1).select(F.col("id").cast("int").alias("year"))
    return counts_by_difference(covered_years(obs, multiplier), years)


def labelled_availability(filled: DataFrame, member: DataFrame, model: DataFrame, low: DataFrame, obs: DataFrame, least: int, multiplier: float | None = 3.0) -> DataFrame:
    """Counts by run and year, and what supports the state there.

    filled: pid, year, value, is_native, is_interpolated; member: the series of a run (run, pid); model: those
    that its model uses, with weights (run, pid, weight); low: its slow series (run, pid), whose samples are
    in obs. A year is ``annual_core`` where at least ``least`` series of the model have a value, else
    ``low_frequency_only`` where a slow sample stands for it, else ``unconstrained``.
    """
    rows = filled.join(member, "pid").join(model.withColumn("used", F.lit(True)), ["run", "pid"], "left")
    has = F.col("value").isNotNull()
    used = has & F.coalesce("used", F.lit(False))
    counts = rows.groupBy("run", "year").agg(
        F.count_if(has).alias("available_proxy_count"), F.count_if(used).alias("model_proxy_count"), F.count_if(used & F.col("is_native")).alias("native_model_proxy_count"),
        F.count_if(used & F.col("is_interpolated")).alias("interpolated_model_proxy_count"), F.coalesce(F.sum(F.when(used, F.col("weight"))), F.lit(0.0)).alias("effective_model_proxy_count"),
    )
    spans = covered_years(obs.join(low.select("pid").distinct(), "pid", "left_semi"), multiplier).join(low, "pid")
    slow = counts_by_difference(spans, counts.select("run", "year"), ["run"]).withColumnRenamed("support", "low_resolution_support_count")
    state = F.when(F.col("model_proxy_count") >= least, "annual_core").when(F.col("low_resolution_support_count") > 0, "low_frequency_only").otherwise("unconstrained")
    got = counts.join(slow, ["run", "year"]).withColumns({"uses_interpolated_proxy": F.col("interpolated_model_proxy_count") > 0, "state_support": state})
    return got.select("run", "year", "available_proxy_count", "model_proxy_count", "native_model_proxy_count", "interpolated_model_proxy_count", "uses_interpolated_proxy", "effective_model_proxy_count", "low_resolution_support_count", "state_support")


def availability(filled: DataFrame, weights: DataFrame | None = None) -> DataFrame:
    """Counts by year: available, native, interpolated, effective (weights summed), and a label."""
    rows = filled.where("value is not null")
    rows = rows.withColumn("weight", F.lit(1.0)) if weights is None else rows.join(weights.select("pid", "weight"), "pid")
    years = filled.select("year").distinct()
    counts = rows.groupBy("year").agg(F.count(F.lit(1)).alias("available"), F.sum(F.col("is_native").cast("long")).alias("native"), F.sum(F.col("is_interpolated").cast("long")).alias("interpolated"), F.sum("weight").alias("effective"))
    out = years.join(counts, "year", "left").na.fill(0, ["available", "native", "interpolated"]).na.fill(0.0, ["effective"])
    label = F.when(F.col("native") > 0, "native").when(F.col("interpolated") > 0, "interpolated_only").otherwise("unconstrained")
    return out.withColumn("label", label)


def longest_run(series: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """(keys, start, end, years): the longest stretch of consecutive years with a value, the earliest of ties."""
    rows = series.where("value is not null").select(*keys, "year").distinct()
    island = F.col("year") - F.row_number().over(Window.partitionBy(*keys).orderBy("year"))
    runs = rows.withColumn("island", island).groupBy(*keys, "island").agg(F.min("year").alias("start"), F.max("year").alias("end"), F.count(F.lit(1)).alias("years"))
    best = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("years"), "start"))
    return runs.withColumn("place", best).where("place = 1").select(*keys, "start", "end", "years")
