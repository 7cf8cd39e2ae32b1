"""The supplied star-schema tables as series, targets and records.

Sales become series by brand: ``weekly`` counts weeks since 1995-01-01 as years, ``calendar`` has
fractional calendar years. Brand numbers give the records' places and archives.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .series import Series

ORIGIN = "1995-01-01"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def sales(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(pid, day, value): brand, ship date, quantity."""
    part = table(spark, sf_dir, "part").select("p_partkey", F.col("p_brand").alias("pid"))
    lines = table(spark, sf_dir, "lineitem").select("l_partkey", F.to_date("l_shipdate").alias("day"), F.col("l_quantity").cast("double").alias("value"))
    return lines.join(part, lines["l_partkey"] == part["p_partkey"]).select("pid", "day", "value")


def weekly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(pid, time, value): mean quantity by brand and whole week."""
    week = F.floor(F.datediff("day", F.lit(ORIGIN).cast("date")) / 7.0).cast("double")
    return sales(spark, sf_dir).groupBy("pid", week.alias("time")).agg(F.avg("value").alias("value"))


def calendar(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(pid, time, value): mean quantity by brand and day, times as fractional years."""
    time = F.year("day") + (F.dayofyear("day") - 1) / 366.0
    return sales(spark, sf_dir).groupBy("pid", time.alias("time")).agg(F.avg("value").alias("value"))


def supplier_weeks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(pid, time, value): mean quantity by supplier and whole week; many weeks lack a sale."""
    week = F.floor(F.datediff(F.to_date("l_shipdate"), F.lit(ORIGIN).cast("date")) / 7.0).cast("double")
    pid = F.concat(F.lit("s"), F.col("l_suppkey").cast("string"))
    return table(spark, sf_dir, "lineitem").groupBy(pid.alias("pid"), week.alias("time")).agg(F.avg("l_quantity").cast("double").alias("value"))


def weekly_target(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(year, y): mean quantity of all brands by week."""
    week = F.floor(F.datediff("day", F.lit(ORIGIN).cast("date")) / 7.0).cast("int")
    return sales(spark, sf_dir).groupBy(week.alias("year")).agg(F.avg("value").alias("y"))


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(pid, lat, lon, elev, archive, proxy, metadata) of the brands."""
    brand = table(spark, sf_dir, "part").select(F.col("p_brand").alias("pid")).distinct()
    k = F.regexp_extract("pid", r"([0-9]+)", 1).cast("int")
    names = F.array(*[F.lit(x) for x in ("Wood", "Coral", "GlacierIce", "Speleothem")])
    return brand.select(
        "pid", (k * 3 - 90).cast("double").alias("lat"), ((k * 17) % 360).cast("double").alias("lon"), (k * 10).cast("double").alias("elev"),
        F.element_at(names, (k % 4 + 1).cast("int")).alias("archive"), F.lit("width").alias("proxy"),
        F.create_map(F.lit("dataSetName"), F.concat(F.lit("set"), (k % 5).cast("string")), F.lit("measurement_error"), F.when(k % 3 == 0, F.lit("2.5")).otherwise(F.lit("n/a"))).alias("metadata"),
    )


def _by_hour(spark: SparkSession, sf_dir: str, user: Column) -> DataFrame:
    hour = F.floor((F.unix_timestamp("ts") - 1704067200) / 3600.0).cast("double")
    return table(spark, sf_dir, "events").select(F.concat(F.lit("u"), user.cast("string")).alias("pid"), hour.alias("time"), F.col("value").cast("double").alias("value")).groupBy("pid", "time").agg(F.avg("value").alias("value"))


def event_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(pid, time, value): events as twenty series by user, hours since the first day as years."""
    return _by_hour(spark, sf_dir, F.col("user_id") % 20)


def user_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(pid, time, value): events as a series for each user, with gaps of many hours."""
    return _by_hour(spark, sf_dir, F.col("user_id"))


def brands(spark: SparkSession, sf_dir: str) -> Series:
    obs = weekly(spark, sf_dir)
    rec = records(spark, sf_dir)
    return Series(rec, obs, rec.join(obs.select("pid").distinct(), "pid", "left_anti"))
