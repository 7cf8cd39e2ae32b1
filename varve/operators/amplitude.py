"""Amplitude maps as grouped aggregates; the kernels use the same rules on arrays."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import AmplitudeConfig


def affine_maps(rows: DataFrame, keys: Sequence[str], method: str, cfg: AmplitudeConfig = AmplitudeConfig()) -> DataFrame:
    """(keys, n, slope, intercept, unclipped): predicted to observed by least squares or by equal variance; 1 and 0 where they can't be told."""
    both = rows.where("observed is not null and predicted is not null")
    facts = both.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.avg("predicted").alias("mx"), F.avg("observed").alias("my"), F.stddev_samp("predicted").alias("sx"), F.stddev_samp("observed").alias("sy"), F.covar_samp("predicted", "observed").alias("c"),
    )
    raw = F.try_divide("c", F.col("sx") * F.col("sx")) if method == "ols" else F.try_divide("sy", "sx")
    usable = (F.col("n") >= cfg.minimum_overlap) & (F.col("sx") > 0) & (F.lit(method == "ols") | (F.col("sy") > 0))
    low, high = cfg.slope_bounds
    facts = facts.withColumn("unclipped", F.when(usable, raw))
    slope = F.greatest(F.lit(low), F.least(F.lit(high), F.col("unclipped")))
    facts = facts.withColumn("slope", F.when(F.col("unclipped").isNotNull(), slope).otherwise(1.0))
    return facts.select(*keys, "n", "slope", F.when(F.col("unclipped").isNotNull(), F.col("my") - F.col("slope") * F.col("mx")).otherwise(0.0).alias("intercept"), "unclipped")


def densest_tier(rows: DataFrame, keys: Sequence[str], least: int) -> DataFrame:
    """(keys, tier, n, mean, sd) of the predictions where at least ``tier`` series are available: the highest tier with enough years."""
    rows = rows.where("predicted is not null and availability is not null")
    down = Window.partitionBy(*keys).orderBy(F.desc("availability")).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    tiers = rows.withColumn("reached", F.count(F.lit(1)).over(down)).where(F.col("reached") >= least).groupBy(*keys).agg(F.max("availability").cast("int").alias("tier"))
    return rows.join(tiers, list(keys)).where(F.col("availability") >= F.col("tier")).groupBy(*keys, "tier").agg(F.count(F.lit(1)).alias("n"), F.avg("predicted").alias("mean"), F.stddev_samp("predicted").alias("sd"))


def apply_affine(predictions: DataFrame, maps: DataFrame, keys: Sequence[str]) -> DataFrame:
    return predictions.join(maps.select(*keys, "slope", "intercept"), list(keys)).withColumn("value", F.col("intercept") + F.col("slope") * F.col("value")).drop("slope", "intercept")


def apply_knots(rows: DataFrame, availability: Sequence[float], slopes: Sequence[float], source_center: float, target_center: float) -> DataFrame:
    """A slope that depends on availability: linear between knots, constant beyond them."""
    a, s = list(availability), list(slopes)
    slope = F.when(F.col("availability") <= a[0], F.lit(s[0]))
    for x0, x1, y0, y1 in zip(a, a[1:], s, s[1:]):
        slope = slope.when(F.col("availability") <= x1, F.lit(y0) + (F.col("availability") - x0) * ((y1 - y0) / (x1 - x0)))
    return rows.withColumn("value", F.lit(target_center) + slope.otherwise(F.lit(s[-1])) * (F.col("value") - F.lit(source_center)))
