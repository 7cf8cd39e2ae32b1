"""Coverage nests: intervals with the same set of covering series, and the combination of their predictions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import NestConfig


def envelopes(annual: DataFrame) -> DataFrame:
    """(pid, start, end) of annual series."""
    return annual.where("value is not null").groupBy("pid").agg(F.min("year").alias("start"), F.max("year").alias("end"))


def coverage_nests(bounds: DataFrame, cfg: NestConfig = NestConfig(), first: int | None = None, last: int | None = None, keys: Sequence[str] = ()) -> DataFrame:
    """(keys, nest_id, start, end, pids): for each set of series, the longest interval that exactly these cover.

    Candidate starts are the series' starts from ``minimum_start`` on and the latest before it; candidate
    ends are their ends; both are clipped to the requested period, while covering is judged by the
    whole envelopes (which comes to the same within the period).

    Series that have begun by a start are swept from the latest end back: the set that covers up to an end
    grows there and nowhere else, so running sums of the series' hashes tell sets apart, and an end where
    no such series ends would only be a shorter interval of a known set. Members are gathered for the
    longest interval of each set alone. ``keys`` (such as a run) have nests of their own.
    """
    keys = list(keys)
    start = F.greatest(F.col("start"), F.lit(first)) if first is not None else F.col("start")
    end = F.least(F.col("end"), F.lit(last)) if last is not None else F.col("end")
    rows = bounds.select(*keys, "pid", start.alias("from"), end.alias("to"))
    starts = rows.select(*keys, F.col("from").alias("s"))
    early = starts.where(F.col("s") < cfg.minimum_start).groupBy(*keys).agg(F.max("s").alias("s")).where("s is not null")
    starts = starts.where(F.col("s") >= cfg.minimum_start).unionByName(early).distinct()
    begun = rows.join(starts, [*keys]) if keys else rows.crossJoin(starts)
    begun = begun.where((F.col("from") <= F.col("s")) & (F.col("to") - F.col("s") >= cfg.span))
    ends = begun.groupBy(*keys, "s", F.col("to").alias("e")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("pid").cast("decimal(38,0)")).alias("h"), F.sum(F.hash("pid").cast("long")).alias("g"))
    back = Window.partitionBy(*keys, "s").orderBy(F.desc("e"))
    sets = ends.select(*keys, "s", "e", *[F.sum(c).over(back).alias(c) for c in ("n", "h", "g")]).where(F.col("n") >= cfg.minimum_members)
    longest = F.row_number().over(Window.partitionBy(*keys, "n", "h", "g").orderBy(F.desc(F.col("e") - F.col("s")), "s", "e"))
    chosen = sets.withColumn("place", longest).where("place = 1").select(*keys, "s", "e")
    found = begun.join(chosen, [*keys, "s"]).where(F.col("to") >= F.col("e")).groupBy(*keys, "s", "e").agg(F.array_sort(F.collect_set("pid")).alias("pids"))
    number = F.row_number().over(Window.partitionBy(*keys).orderBy("s", "e", "pids"))
    return found.select(*keys, F.concat(F.lit("nest_"), F.lpad(number.cast("string"), 3, "0")).alias("nest_id"), F.col("s").alias("start"), F.col("e").alias("end"), "pids")


def nest_slices(nests: DataFrame, annual: DataFrame) -> DataFrame:
    """(nest_id, pid, year, value): each nest's part of the matrix; an equi-join on pid, years bounded beside it."""
    members = nests.select("nest_id", "start", "end", F.explode("pids").alias("pid"))
    return members.join(annual, "pid").where(F.col("year").between(F.col("start"), F.col("end"))).select("nest_id", "pid", "year", "value")


def combine_median(predictions: DataFrame) -> DataFrame:
    """(year, point, nests): the median over the nests that predict a year."""
    rows = predictions.where("value is not null")
    return rows.groupBy("year").agg(F.median("value").alias("point"), F.count(F.lit(1)).alias("nests"))


def combine_densest(predictions: DataFrame) -> DataFrame:
    """(year, point, nests): the prediction of the nest with the most core series; earlier starts, then later ends, break ties. Rows need core_count, start, end."""
    order = Window.partitionBy("year").orderBy(F.desc("core_count"), "start", F.desc("end"), "nest_id")
    rows = predictions.where("value is not null").withColumns({"place": F.row_number().over(order), "nests": F.count(F.lit(1)).over(Window.partitionBy("year"))})
    return rows.where("place = 1").select("year", F.col("value").alias("point"), "nests")


QUANTILES = {"q05": 0.05, "q25": 0.25, "median": 0.5, "q75": 0.75, "q95": 0.95}


def sorted_quantile(values: Column, q: float) -> Column:
    """Linear quantile of a sorted array without missing elements."""
    place = F.lit(q) * (F.size(values) - 1)
    low = F.floor(place).cast("int")
    x, y = F.get(values, low), F.get(values, F.least(low + 1, F.size(values) - 1))
    return x + (y - x) * (place - low)


def pool_members(members: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """(keys, year, q05 ... q95, ensemble_n): exact quantiles over all finite values of all nests and runs.

    members: (keys, nest_id, year, runs). A year's values move once, as arrays, and are as many as nests
    times runs at most.
    """
    clean = F.filter("runs", lambda v: v.isNotNull() & ~F.isnan(v))
    pooled = members.select(*keys, "year", clean.alias("runs")).groupBy(*keys, "year").agg(F.sort_array(F.flatten(F.collect_list("runs"))).alias("v"))
    pooled = pooled.where(F.size("v") > 0)
    return pooled.select(*keys, "year", *[sorted_quantile(F.col("v"), q).alias(n) for n, q in QUANTILES.items()], F.size("v").cast("long").alias("ensemble_n"))


def within_replicates(members: DataFrame, combination: str, keys: Sequence[str] = ()) -> DataFrame:
    """(keys, year, runs): each replicate's nests combined, by median or by taking the densest nest that has the year.

    members: (keys, nest_id, year, runs, core_count, start, end) where place k of ``runs`` is replicate k, missing where its fit failed.
    """
    one = members.select(*keys, "year", "nest_id", "core_count", "start", "end", F.posexplode("runs").alias("replicate", "v")).where("v is not null and not isnan(v)")
    first = F.struct(-F.col("core_count"), F.col("start"), -F.col("end"), F.col("nest_id"))
    value = F.median("v") if combination == "median" else F.min_by("v", first)
    return one.groupBy(*keys, "year", "replicate").agg(value.alias("v")).groupBy(*keys, "year").agg(F.collect_list("v").alias("runs"))


def pool_densest(members: DataFrame) -> DataFrame:
    """As ``pool_members``, each year from its densest nest only. members need core_count, start, end."""
    order = Window.partitionBy("year").orderBy(F.desc("core_count"), "start", F.desc("end"), "nest_id")
    return pool_members(members.withColumn("place", F.row_number().over(order)).where("place = 1"))


def contribution(predictions: DataFrame) -> DataFrame:
    """(year, contributing_nests, maximum_core_count): who supports a year. Rows need core_count."""
    return predictions.where("value is not null").groupBy("year").agg(F.count(F.lit(1)).alias("contributing_nests"), F.max("core_count").alias("maximum_core_count"))
