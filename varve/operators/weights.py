"""Weights of series: reliability against measurement error, and redundancy of neighbours."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import WeightConfig
from ..functions.stats import correlation, haversine_km, number
from .graph import component_labels


def error_sd(records: DataFrame, cfg: WeightConfig) -> DataFrame:
    """records with error_sd: an explicit one, else the first positive metadata field, whatever its case."""
    low = F.transform_keys("metadata", lambda k, _: F.lower(k))
    fields = [number(F.element_at(F.col("__low"), F.lit(f.lower()))) for f in cfg.error_fields]
    first = F.coalesce(*[F.when(c > 0, c) for c in fields]) if fields else F.lit(None).cast("double")
    explicit = F.element_at(F.create_map(*[F.lit(x) for kv in cfg.explicit_error_sd for x in kv]), F.col("pid")) if cfg.explicit_error_sd else F.lit(None).cast("double")
    return records.withColumn("__low", low).withColumn("error_sd", F.coalesce(explicit, first)).drop("__low")


def reliability(records: DataFrame, annual: DataFrame) -> DataFrame:
    """Adds calibration_sd and error_weight = s^2 / (s^2 + e^2), 1 without an error."""
    sd = annual.groupBy("pid").agg(F.stddev_samp("value").alias("calibration_sd"))
    s2, e2 = F.col("calibration_sd") * F.col("calibration_sd"), F.col("error_sd") * F.col("error_sd")
    return records.join(sd, "pid", "left").withColumn("error_weight", F.when(F.col("error_sd") > 0, F.coalesce(s2 / (s2 + e2), F.lit(1.0))).otherwise(F.lit(1.0)))


EARTH_KM = 6371.0088


def sphere_cells(lat: Column, lon: Column, radius_km: float, around: bool = False) -> Column:
    """Array of (band, cell) that a place lies in or, with ``around``, where all places within the radius lie.

    Bands of latitude are as high as the radius. A band is cut along its longitudes into cells at least as
    wide as two places within the radius can be apart there, so cells grow in number towards the equator,
    meet across the date line, and a band that comes near a pole is one cell.
    """
    reach = min(math.pi, radius_km / EARTH_KM)
    height = max(math.degrees(reach), 1e-6)
    band = F.floor((lat + 90.0) / height).cast("long")

    def cells(k: Column) -> Column:
        most = F.radians(F.greatest(F.abs(k * height - 90.0), F.abs((k + 1) * height - 90.0)))
        width = F.degrees(F.asin(F.least(F.lit(1.0), math.sin(reach) / F.cos(most))))
        # beside a pole, and where three cells would not differ, the band is whole
        n = F.when(most + reach < math.pi / 2, F.floor(360.0 / width)).otherwise(F.lit(1)).cast("long")
        n = F.when(n < 3, F.lit(1).cast("long")).otherwise(n)
        own = F.least(F.floor(F.pmod(lon, F.lit(360.0)) / (360.0 / n)).cast("long"), n - 1)
        at = F.array_distinct(F.array(F.pmod(own - 1, n), own, F.pmod(own + 1, n))) if around else F.array(own)
        return F.transform(at, lambda c: F.struct(k.alias("band"), c.alias("cell")))

    return F.flatten(F.transform(F.array(band - 1, band, band + 1) if around else F.array(band), cells))


def cell_pairs(a: DataFrame, b: DataFrame, radius_km: float, kind: Column) -> DataFrame:
    """Rows of a (lat_a, lon_a, ..) beside rows of b (lat_b, lon_b, ..) in cells around; all pairs within the radius are among them, once."""
    x = a.where("lat_a is not null and lon_a is not null").withColumn("at", F.explode(sphere_cells(F.col("lat_a"), F.col("lon_a"), radius_km)))
    y = b.where("lat_b is not null and lon_b is not null").withColumn("at", F.explode(sphere_cells(F.col("lat_b"), F.col("lon_b"), radius_km, around=True)))
    return x.join(y, kind & (x["at"] == y["at"])).drop("at")


def near_pairs(records: DataFrame, cfg: WeightConfig) -> DataFrame:
    """(a, b): pairs of series that are alike in kind and near, or of one site or source.

    Sites and sources are met by equality; neighbours by cells on the sphere, so that no series is compared
    with all others.
    """
    archive, proxy = (F.lower(F.trim(F.col(c))) if on else F.lit("") for c, on in (("archive", cfg.same_archive_only), ("proxy", cfg.same_proxy_only)))
    text = lambda k: F.nullif(F.lower(F.trim(F.element_at("metadata", F.lit(k)))), F.lit(""))
    rows = records.select("pid", "lat", "lon", archive.alias("archive"), proxy.alias("proxy"), text("geo_siteName").alias("site"), text("dataSetName").alias("source"))
    a, b = (rows.select(*[F.col(c).alias(f"{c}_{side}") for c in rows.columns]) for side in "ab")
    kind = (F.col("archive_a") == F.col("archive_b")) & (F.col("proxy_a") == F.col("proxy_b")) & (F.col("pid_a") < F.col("pid_b"))
    near = cell_pairs(a, b, cfg.radius_km, kind).where(haversine_km(F.col("lat_a"), F.col("lon_a"), F.col("lat_b"), F.col("lon_b")) <= cfg.radius_km)
    out = near.select(F.col("pid_a").alias("a"), F.col("pid_b").alias("b"))
    for c in ("site", "source"):
        out = out.unionByName(a.join(b, kind & (F.col(f"{c}_a") == F.col(f"{c}_b"))).select(F.col("pid_a").alias("a"), F.col("pid_b").alias("b")))
    return out.distinct()


def redundancy_edges(records: DataFrame, annual: DataFrame, cfg: WeightConfig) -> DataFrame:
    """(a, b, n, r) of near pairs that overlap and correlate enough."""
    pairs = near_pairs(records, cfg)
    x = annual.where("value is not null").select(F.col("pid").alias("a"), "year", F.col("value").alias("x"))
    y = annual.where("value is not null").select(F.col("pid").alias("b"), "year", F.col("value").alias("y"))
    got = pairs.join(x, "a").join(y, ["b", "year"]).groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"), correlation(F.col("x"), F.col("y")).alias("r"))
    return got.where((F.col("n") >= cfg.min_overlap) & (F.abs("r") >= cfg.correlation))


def series_weights(records: DataFrame, annual: DataFrame, cfg: WeightConfig = WeightConfig()) -> DataFrame:
    """(pid, error_sd, calibration_sd, error_weight, redundancy_group, redundancy_group_size, redundancy_weight, weight, ...).

    The parts are reported also when weighting is off; the weight itself is 1 then.
    """
    rows = reliability(error_sd(records, cfg), annual)
    if cfg.enabled and cfg.radius_km > 0:
        edges = redundancy_edges(records, annual, cfg)
        labels = component_labels(records.select(F.col("pid").alias("node")), edges).select(F.col("node").alias("pid"), "label")
        links = edges.agg(F.count(F.lit(1)).alias("pair_links"))
        rows = rows.join(labels, "pid").crossJoin(links)
    else:
        rows = rows.withColumns({"label": F.col("pid"), "pair_links": F.lit(0).cast("long")})
    rows = rows.withColumns({"redundancy_group": F.dense_rank().over(Window.orderBy("label")), "redundancy_group_size": F.count(F.lit(1)).over(Window.partitionBy("label"))})
    rows = rows.withColumn("redundancy_weight", 1.0 / F.col("redundancy_group_size"))
    joint = F.col("error_weight") * F.col("redundancy_weight")
    weight = F.least(F.lit(1.0), F.greatest(F.lit(cfg.minimum_weight), joint)) if cfg.enabled else F.lit(1.0)
    rows = rows.withColumn("weight", weight)
    return rows.select("pid", "error_sd", "calibration_sd", "error_weight", "redundancy_group", "redundancy_group_size", "redundancy_weight", "weight", F.sqrt("weight").alias("sqrt_weight"), "pair_links", F.lit(cfg.enabled).alias("enabled"))


def pair_correlations(annual: DataFrame, min_overlap: int) -> DataFrame:
    """(a, b, n, r) of every two series that share years, from sums over the shared years; 0 where they overlap too little or do not vary."""
    x = annual.where("value is not null").select(F.col("pid").alias("a"), "year", F.col("value").alias("x"))
    y = annual.where("value is not null").select(F.col("pid").alias("b"), "year", F.col("value").alias("y"))
    got = x.join(y, "year").where("a < b").groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"), correlation(F.col("x"), F.col("y")).alias("r"))
    return got.select("a", "b", "n", F.when(F.col("n") >= min_overlap, F.coalesce("r", F.lit(0.0))).otherwise(F.lit(0.0)).alias("r"))
